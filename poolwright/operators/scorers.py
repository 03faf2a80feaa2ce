"""Scoring backends: fit on labelled rows, then class scores, probabilities, passes with dropout, embeddings."""

from __future__ import annotations

import importlib
import io
import json
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.kernels import checked
from ..functions.vectors import dot, first_argmax, literal, seeded, squared_distance, total
from ..sources import files

TEMPERATURE = 0.1


def with_softmax(df: DataFrame, scores: str, out: str) -> DataFrame:
    """Add the softmax of an array of scores, shifted by its greatest."""
    top = F.array_max(scores)
    df = df.withColumn("__e", F.transform(F.col(scores), lambda z: F.exp(z - top)))
    df = df.withColumn("__sum", total(F.col("__e")))
    return df.withColumn(out, F.transform("__e", lambda e: e / F.col("__sum"))).drop("__e", "__sum")


def prototypes(labeled: DataFrame) -> DataFrame:
    """(cls, mean): the mean vector of each class. Means are aggregated as vectors, before the shuffle in part."""
    mean = vector_to_array(Summarizer.mean(F.col("v")))
    rows = labeled.select(F.col("label").alias("cls"), array_to_vector("vec").alias("v"))
    return rows.groupBy("cls").agg(mean.alias("mean"))


class Scorer(ABC):
    """What a strategy asks of a model. ``fit`` trains from scratch; class order is that of ``classes``."""

    classes: list[int]

    @abstractmethod
    def fit(self, labeled: DataFrame) -> Scorer: ...

    @abstractmethod
    def scores(self, vector: Column) -> Column:
        """Class scores (logits) of a vector column."""

    def linear(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, offsets) of class scores up to a term common to all classes, for the adversarial strategies."""
        raise NotImplementedError(f"{type(self).__name__} is not linear")

    def predict_prob(self, rows: DataFrame) -> DataFrame:
        """(id, p): class probabilities."""
        scored = rows.select("id", self.scores(F.col("vec")).alias("z"))
        return with_softmax(scored, "z", "p").select("id", "p")

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, predicted): the class of the greatest probability, the first of equal ones."""
        names = F.array(*[F.lit(c) for c in self.classes])
        return self.predict_prob(rows).select("id", F.get(names, first_argmax(F.col("p"))).alias("predicted"))

    def predict_prob_passes(self, rows: DataFrame, passes: int, seed: int) -> DataFrame:
        """(id, pass, p): probabilities of passes with dropout of half the inputs, the others doubled.

        The mask is a function of seed, pass, id and element, so passes can be repeated and recomputed anywhere.
        """
        masked = F.transform(
            "vec",
            lambda x, j: F.when(
                F.substring(seeded(seed, F.col("pass"), F.col("id"), j), 1, 1) < "8", F.lit(0.0)
            ).otherwise(2 * x),
        )
        thrown = rows.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
        scored = thrown.select("id", "pass", masked.alias("vec")).select(
            "id", "pass", self.scores(F.col("vec")).alias("z")
        )
        return with_softmax(scored, "z", "p").select("id", "pass", "p")

    def predict_prob_dropout(self, rows: DataFrame, passes: int, seed: int) -> DataFrame:
        """(id, p): the mean of the passes."""
        return mean_of_passes(self.predict_prob_passes(rows, passes, seed))

    def embeddings(self, rows: DataFrame) -> DataFrame:
        """(id, vec): the representation that geometric strategies work on; here the input."""
        return rows.select("id", "vec")

    def state(self) -> tuple[dict, dict[str, np.ndarray]]:
        """What a saved scorer is made of: plain values and arrays."""
        raise NotImplementedError(f"{type(self).__name__} cannot be saved")

    def restore(self, said: dict, arrays: dict[str, np.ndarray]) -> Scorer:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the fitted scorer to a folder, replacing what is there. A model of pyspark.ml is saved beside by itself."""
        said, arrays = self.state()
        model = getattr(self, "model", None)
        if model is not None:
            model.write().overwrite().save(f"{path}/model")
            said = {**said, "model": f"{type(model).__module__}.{type(model).__name__}"}
        out = io.BytesIO()
        np.savez(out, said=np.frombuffer(json.dumps(said).encode(), np.uint8), **{f"a_{k}": v for k, v in arrays.items()})
        files.write_bytes(spark, f"{path}/scorer", files.sealed(out.getvalue()))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        """A saved scorer of this class, with its class order, in any session. ValueError if its file is damaged."""
        with np.load(io.BytesIO(files.opened(files.read_bytes(spark, f"{path}/scorer")))) as state:
            said = json.loads(state["said"].tobytes())
            arrays = {k.removeprefix("a_"): state[k] for k in state.files if k != "said"}
        scorer = cls().restore(said, arrays)
        if "model" in said:
            module, _, name = said["model"].rpartition(".")
            if not module.startswith("pyspark.ml."):
                raise ValueError(f"{said['model']} is no model of pyspark.ml")
            scorer.model = getattr(importlib.import_module(module), name).load(f"{path}/model")
        return scorer


def mean_of_passes(passes: DataFrame) -> DataFrame:
    mean = vector_to_array(Summarizer.mean(F.col("v")))
    return passes.select("id", array_to_vector("p").alias("v")).groupBy("id").agg(mean.alias("p"))


class PrototypeScorer(Scorer):
    """Scores are minus the squared distance to the class means over a temperature: linear up to a common term."""

    def __init__(self, temperature: float = TEMPERATURE):
        self.temperature = temperature
        self.classes: list[int] = []
        self.means = np.zeros((0, 0))

    def fit(self, labeled: DataFrame) -> PrototypeScorer:
        rows = sorted(prototypes(labeled.where("label IS NOT NULL")).collect())
        self.classes = [r["cls"] for r in rows]
        self.means = checked(np.array([r["mean"] for r in rows], dtype=np.float64))
        return self

    def scores(self, vector: Column) -> Column:
        def score(mean: np.ndarray) -> Column:
            return -squared_distance(vector, literal(mean)) / F.lit(self.temperature)

        return F.array(*[score(mean) for mean in self.means])

    def state(self) -> tuple[dict, dict[str, np.ndarray]]:
        return {"temperature": self.temperature, "classes": self.classes}, {"means": self.means}

    def restore(self, said: dict, arrays: dict[str, np.ndarray]) -> PrototypeScorer:
        self.temperature, self.classes, self.means = said["temperature"], said["classes"], arrays["means"]
        return self

    def linear(self) -> tuple[np.ndarray, np.ndarray]:
        return 2 * self.means / self.temperature, -(self.means**2).sum(axis=1) / self.temperature


class MLScorer(Scorer):
    """A pyspark.ml classifier (logistic regression by default) as a scoring backend."""

    def __init__(self, estimator=None):  # noqa: ANN001
        self.estimator, self.model = estimator, None

    def fit(self, labeled: DataFrame) -> MLScorer:
        from pyspark.ml.classification import LogisticRegression

        self.classes = sorted(r[0] for r in labeled.select("label").where("label IS NOT NULL").distinct().collect())
        index = F.array(*[F.lit(c) for c in self.classes])
        rows = labeled.where("label IS NOT NULL").select(
            array_to_vector("vec").alias("features"),
            (F.array_position(index, F.col("label")) - 1).cast("double").alias("label"),
        )
        self.model = (self.estimator or LogisticRegression(maxIter=50, regParam=1e-3)).fit(rows)
        return self

    def scores(self, vector: Column) -> Column:
        weights, offsets = self.linear()
        return F.array(
            *[dot(vector, literal(w)) + F.lit(float(b)) for w, b in zip(weights, offsets, strict=True)]
        )

    def state(self) -> tuple[dict, dict[str, np.ndarray]]:
        return {"classes": self.classes}, {}

    def restore(self, said: dict, arrays: dict[str, np.ndarray]) -> MLScorer:
        self.classes = said["classes"]
        return self

    def linear(self) -> tuple[np.ndarray, np.ndarray]:
        weights = self.model.coefficientMatrix.toArray()
        offsets = self.model.interceptVector.toArray()
        if len(weights) == 1:  # two classes share one row
            weights, offsets = np.vstack([0 * weights, weights]), np.array([0.0, offsets[0]])
        return weights, offsets


class UDFScorer(Scorer):
    """Any model as a function from a matrix of vectors to a matrix of class scores, applied to Arrow batches."""

    def __init__(self, train: Callable[[DataFrame], tuple[list[int], Callable[[np.ndarray], np.ndarray]]]):
        self.train = train

    def fit(self, labeled: DataFrame) -> UDFScorer:
        self.classes, self.function = self.train(labeled)
        return self

    def scores(self, vector: Column) -> Column:
        function = self.function

        @F.pandas_udf("array<double>")
        def scored(vectors):  # noqa: ANN001, ANN202
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(function(np.stack(vectors.to_numpy()).astype(np.float64))))

        return scored(vector)


class BatchModelScorer(Scorer):
    """A trained model of the user's, loaded where the rows are: once for each Python worker, not for each batch.

    ``load`` is called on the executors and gives an object with ``scores(x)``, class scores of a matrix of vectors, and
    ``embeddings(x)`` if geometric strategies are to work on its representation. It reads the model from wherever executors
    can, such as a file that was given to ``SparkContext.addFile``; nothing large goes with the tasks.
    """

    def __init__(self, load: Callable[[], object], classes: list[int], features: int, batch_size: int = 1024):
        self.load, self.classes, self.features, self.batch_size = load, classes, features, batch_size

    def fit(self, labeled: DataFrame) -> BatchModelScorer:
        """The model is trained already."""
        return self

    def _applied(self, name: str, vector: Column) -> Column:
        load = self.load

        def make() -> Callable[[np.ndarray], np.ndarray]:
            model = load()
            return lambda x: np.asarray(getattr(model, name)(np.asarray(x, dtype=np.float64)), dtype=np.float64)

        udf = predict_batch_udf(
            make, return_type=ArrayType(DoubleType()), batch_size=self.batch_size, input_tensor_shapes=[[self.features]]
        )
        return udf(vector)

    def scores(self, vector: Column) -> Column:
        return self._applied("scores", vector)

    def embeddings(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", self._applied("embeddings", F.col("vec")).alias("vec"))
