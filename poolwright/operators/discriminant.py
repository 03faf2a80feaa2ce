"""Linear discriminant analysis, and how well it tells classes apart on held-out folds: a check of features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import seeded


@dataclass
class ClassSums:
    """What a discriminant needs of some rows: of each class the count and the sum, of all the sum of outer products."""

    n: np.ndarray
    sums: np.ndarray
    outer: np.ndarray

    def __sub__(self, other: ClassSums) -> ClassSums:
        return ClassSums(self.n - other.n, self.sums - other.sums, self.outer - other.outer)

    def discriminant(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, offsets) of the class scores; classes without rows score minus infinity.

        The covariance within classes is pooled; where features depend on each other its pseudo-inverse is taken.
        """
        some = self.n > 0
        means = np.zeros_like(self.sums)
        means[some] = self.sums[some] / self.n[some, None]
        within = self.outer - (means * self.n[:, None]).T @ means
        inverse = np.linalg.pinv(within / max(1, int(self.n.sum()) - int(some.sum())), hermitian=True)
        weights = means @ inverse
        prior = np.log(np.where(some, self.n, 1) / max(1, self.n.sum()))
        return weights, np.where(some, prior - (weights * means).sum(axis=1) / 2, -np.inf)


def fold_of(folds: int, seed: int, key: Column) -> Column:
    """The fold of a row, by its seeded hash."""
    return (F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("long") % folds).cast("int")


def class_sums(rows: DataFrame, classes: int, features: int) -> dict[int, ClassSums]:
    """The sums of each fold of (fold, cls, vec) in one pass. A task gives one row a fold, whatever it reads."""
    size = classes + classes * features + features * features
    kernels.checked(np.broadcast_to(np.float64(0), size))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, cls, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), kernels.matrix_of(batch.column(2))
            for f in np.unique(fold):
                own, of = x[fold == f], cls[fold == f]
                s = np.zeros((classes, features))
                np.add.at(s, of, own)
                part = np.concatenate([np.bincount(of, minlength=classes), s.ravel(), (own.T @ own).ravel()])
                total[int(f)] = total.get(int(f), 0) + part
        if total:
            yield pa.record_batch(
                [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["fold", "s"]
            )

    parts = rows.select("fold", "cls", "vec").mapInArrow(sums, "fold int, s array<double>")
    parts = parts.select("fold", array_to_vector("s").alias("v")).groupBy("fold")
    out = {}
    for row in parts.agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s")).collect():  # a row for each fold
        s = np.array(row["s"])
        n, each, outer = s[:classes], s[classes : classes * (1 + features)], s[classes * (1 + features) :]
        out[row["fold"]] = ClassSums(n, each.reshape(classes, features), outer.reshape(features, features))
    return out


def cross_validated(rows: DataFrame, folds: int = 10, seed: int = 1) -> DataFrame:
    """(fold, n, hits, accuracy) of (id, vec, label): each fold called by the discriminant of all other folds.

    Two passes, whatever the number of folds: one sums every fold's classes, from which the sums without a fold follow
    by subtraction; the other calls each row by its own fold's model. Only sums, of folds x features^2 numbers, and
    hits come to the driver. Rows without label or vector are left out; a fold without rows has none here; a class that
    all other folds lack is never called. No rows give no folds. Vectors have one length.
    """
    rows = rows.where("label IS NOT NULL AND vec IS NOT NULL")
    names = sorted(r[0] for r in rows.select("label").distinct().collect())
    head = rows.select(F.size("vec")).limit(1).collect()
    schema = "fold int, n long, hits long, accuracy double"
    if not head:
        return rows.sparkSession.createDataFrame([], schema)
    index = F.array(*[F.lit(c) for c in names])
    cls = (F.array_position(index, F.col("label")) - 1).cast("long").alias("cls")
    rows = rows.select(fold_of(folds, seed, F.col("id")).alias("fold"), cls, "vec")
    sums = class_sums(rows, len(names), head[0][0])
    total = ClassSums(*(sum(getattr(s, part) for s in sums.values()) for part in ("n", "sums", "outer")))
    models = {f: (total - own).discriminant() for f, own in sums.items()}

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, cls, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), kernels.matrix_of(batch.column(2))
            some = np.unique(fold)
            hits = [int(((x[fold == f] @ models[f][0].T + models[f][1]).argmax(axis=1) == cls[fold == f]).sum()) for f in some]
            yield pa.record_batch(
                [pa.array(some, pa.int32()), pa.array([int((fold == f).sum()) for f in some], pa.int64()), pa.array(hits, pa.int64())],
                names=["fold", "n", "hits"],
            )

    counted = rows.mapInArrow(called, "fold int, n long, hits long").groupBy("fold")
    counted = counted.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return counted.withColumn("accuracy", F.col("hits") / F.col("n"))
