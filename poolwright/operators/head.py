"""A classifier head with one hidden layer and dropout, trained by seeded mini-batches over distributed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import seeded
from .clustering import cut
from .scorers import Scorer


class HeadScorer(Scorer):
    """Vector -> hidden units (rectified) -> dropout -> class scores, by stochastic gradient descent with momentum.

    An epoch goes through ``batches`` mini-batches; a row's batch is its seeded hash, its dropped units are those of a
    hash of seed, step, id and unit, so training gives the same model wherever rows lie. Each step sums gradients by
    task and updates once; rows never come to the driver, parameters are checked for their size.
    """

    def __init__(
        self,
        hidden: int = 50,
        epochs: int = 10,
        batches: int = 8,
        rate: float = 0.05,
        momentum: float = 0.3,
        drop: float = 0.5,
        seed: int = 1,
    ):
        self.settings = {"hidden": hidden, "epochs": epochs, "batches": batches, "rate": rate, "momentum": momentum, "drop": drop, "seed": seed}
        self.classes: list[int] = []
        self.weights: list[np.ndarray] = []
        self.history: list[tuple[int, float, float]] = []

    def start(self, features: int) -> list[np.ndarray]:
        """Weights and offsets of both layers, even draws within 1 over the root of what feeds a unit."""
        rng, hidden = np.random.default_rng(self.settings["seed"]), self.settings["hidden"]
        shapes = ((features, hidden), (hidden,)), ((hidden, len(self.classes)), (len(self.classes),))
        sizes = (features, hidden)
        return [kernels.checked(rng.uniform(-1, 1, s) / np.sqrt(max(1, n))) for pair, n in zip(shapes, sizes, strict=True) for s in pair]

    def kept(self, ids: np.ndarray, seed: int, step: int) -> np.ndarray:
        """What dropout multiplies the hidden units of rows by: 0, or what makes up for those dropped."""
        drop = self.settings["drop"]
        return (kernels.hashed_uniform(seed, step, ids, self.settings["hidden"]) >= drop) / (1.0 - drop)

    def fit(self, labeled: DataFrame) -> HeadScorer:
        """No labelled rows give no classes."""
        settings = self.settings
        labeled = labeled.where("label IS NOT NULL")
        self.classes, self.history, self.weights = sorted(r[0] for r in labeled.select("label").distinct().collect()), [], []
        if not self.classes:
            return self
        index = F.array(*[F.lit(c) for c in self.classes])
        rows = cut(labeled.select("id", (F.array_position(index, F.col("label")) - 1).cast("long").alias("cls"), "vec"))
        self.weights = self.start(rows.select(F.size("vec")).first()[0])
        speed = [np.zeros_like(w) for w in self.weights]
        for epoch in range(settings["epochs"]):
            losses, hits = [], []
            batch = F.conv(F.substring(seeded(settings["seed"], F.lit(epoch), F.col("id")), 1, 8), 16, 10).cast("long")
            for k in range(settings["batches"]):
                n, loss, right, gradient = self._step(rows.where(batch % settings["batches"] == k), epoch)
                if not n:
                    continue
                losses.append(loss / n)
                hits.append(right / n)
                for w, v, g in zip(self.weights, speed, gradient, strict=True):
                    v *= settings["momentum"]
                    v += g / n
                    w -= settings["rate"] * v
            self.history.append((epoch + 1, float(np.mean(losses)), float(np.mean(hits))))
        return self

    def gradients(self, ids: np.ndarray, cls: np.ndarray, x: np.ndarray, step: int) -> tuple[float, int, list[np.ndarray]]:
        """(sum of losses, hits, sums of gradients) of some rows."""
        w1, b1, w2, b2 = self.weights
        before = x @ w1 + b1
        kept = self.kept(ids, self.settings["seed"], step)
        units = np.maximum(before, 0) * kept
        z = units @ w2 + b2
        top = z.max(axis=1, keepdims=True)
        p = np.exp(z - top)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(len(x))
        loss = -np.log(np.maximum(p[at, cls], 1e-300)).sum()
        hits = int((z.argmax(axis=1) == cls).sum())
        p[at, cls] -= 1
        back = (p @ w2.T) * kept * (before > 0)
        return float(loss), hits, [x.T @ back, back.sum(axis=0), units.T @ p, p.sum(axis=0)]

    def _step(self, rows: DataFrame, step: int) -> tuple[int, float, int, list[np.ndarray]]:
        head, size = self, sum(w.size for w in self.weights)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(3 + size)
            for batch in batches:
                if batch.num_rows:
                    ids, cls, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), kernels.matrix_of(batch.column(2))
                    loss, hits, parts = head.gradients(ids, cls, x, step)
                    total += np.concatenate([[len(x), loss, hits], *(p.ravel() for p in parts)])
            if total[0]:
                yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], names=["s"])

        parts = rows.mapInArrow(sums, "s array<double>").select(array_to_vector("s").alias("v"))
        found = parts.agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("v"))).alias("s")).first()
        if not found["n"]:
            return 0, 0.0, 0, []
        flat = np.array(found["s"])
        parts, at = [], 3
        for w in self.weights:
            parts.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        return int(flat[0]), float(flat[1]), int(flat[2]), parts

    def summary(self, spark: SparkSession) -> DataFrame:
        """(epoch, loss, accuracy): means over the epoch's mini-batches, as they were met in training."""
        return spark.createDataFrame(self.history, "epoch int, loss double, accuracy double")

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.weights[0] + self.weights[1], 0)

    def scores(self, vector: Column) -> Column:
        head = self

        @F.pandas_udf("array<double>")
        def scored(vectors):  # noqa: ANN001, ANN202
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            units = head.hidden(np.stack(vectors.to_numpy()).astype(np.float64))
            return pd.Series(list(units @ head.weights[2] + head.weights[3]))

        return scored(vector)

    def predict_prob_passes(self, rows: DataFrame, passes: int, seed: int) -> DataFrame:
        """(id, pass, p): passes with dropout of hidden units; a mask is a function of seed, pass, id and unit."""
        head = self

        def thrown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, units = batch.column(0).to_numpy(), head.hidden(kernels.matrix_of(batch.column(1)))
                for k in range(passes):
                    z = (units * head.kept(ids, seed, k)) @ head.weights[2] + head.weights[3]
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    yield pa.record_batch(
                        [batch.column(0), pa.array(np.full(len(p), k, np.int32)), pa.array(list(p), pa.list_(pa.float64()))],
                        names=["id", "pass", "p"],
                    )

        return rows.select("id", "vec").mapInArrow(thrown, "id long, pass int, p array<double>")

    def embeddings(self, rows: DataFrame) -> DataFrame:
        """(id, vec): the hidden units."""
        head = self

        def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    out = head.hidden(kernels.matrix_of(batch.column(1)))
                    yield pa.record_batch([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "vec"])

        return rows.select("id", "vec").mapInArrow(units, "id long, vec array<double>")

    def state(self) -> tuple[dict, dict[str, np.ndarray]]:
        said = {"settings": self.settings, "classes": self.classes, "history": self.history}
        return said, {f"w{i}": w for i, w in enumerate(self.weights)}

    def restore(self, said: dict, arrays: dict[str, np.ndarray]) -> HeadScorer:
        self.settings, self.classes = said["settings"], said["classes"]
        self.history = [tuple(x) for x in said["history"]]
        self.weights = [arrays[f"w{i}"] for i in range(len(arrays))]
        return self
