"""Query strategies: which unlabelled rows to label next.

Every strategy gives (id, score) of the n chosen rows. Scores are arranged so that the least comes first. Ties go to the
lesser id. If fewer than n rows are unlabelled, all of them are chosen; random sampling raises instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.kernels import matrix_of, squared_distances
from ..functions.vectors import literal, negative_entropy, rounded, seeded, squared_distance
from . import clustering, hierarchy
from .pool import unlabeled
from .scorers import Scorer

PASSES = 10
#: Places that scores are ranked by: beyond them engines differ.
PLACES = 6


def take_least(scored: DataFrame, n: int, places: int = PLACES) -> DataFrame:
    """The n rows of least score; a top-n per task and then of those, never a full sort."""
    return scored.select("id", rounded(F.col("score"), places).alias("score")).orderBy("score", "id").limit(n)


# Scores of class probabilities.
def confidence(p: Column) -> Column:
    return F.array_max(p)


def margin(p: Column) -> Column:
    down = F.sort_array(p, False)
    return F.get(down, 0) - F.get(down, 1)


SCORES: dict[str, Callable[[Column], Column]] = {
    "LeastConfidence": confidence,
    "MarginSampling": margin,
    "EntropySampling": negative_entropy,
}


def random_sampling(pool: DataFrame, labels: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows in seeded random order; ValueError if there are fewer. The score is the row's place."""
    rows = unlabeled(pool, labels).select("id", seeded(seed, F.col("id")).alias("key"))
    chosen = rows.orderBy("key", "id").limit(n)
    if chosen.count() < n:
        raise ValueError(f"fewer than {n} rows are unlabelled")
    return chosen.select("id", F.lit(0.0).alias("score"))


def uncertainty(pool: DataFrame, labels: DataFrame, n: int, scorer: Scorer, score: str) -> DataFrame:
    """LeastConfidence, MarginSampling or EntropySampling on the scorer's probabilities."""
    p = scorer.predict_prob(unlabeled(pool, labels))
    return take_least(p.select("id", SCORES[score](F.col("p")).alias("score")), n)


def uncertainty_dropout(
    pool: DataFrame, labels: DataFrame, n: int, scorer: Scorer, score: str, passes: int = PASSES, seed: int = 1
) -> DataFrame:
    """The same on the mean of passes with dropout."""
    p = scorer.predict_prob_dropout(unlabeled(pool, labels), passes, seed)
    return take_least(p.select("id", SCORES[score](F.col("p")).alias("score")), n)


def disagreement(passes: DataFrame) -> DataFrame:
    """(id, score): mean entropy of the passes less the entropy of their mean, which is minus mutual information."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("p")))
    both = passes.groupBy("id").agg(F.avg(-negative_entropy(F.col("p"))).alias("h2"), mean.alias("p"))
    return both.select("id", (F.col("h2") + negative_entropy(F.col("p"))).alias("score"))


def bald(pool: DataFrame, labels: DataFrame, n: int, scorer: Scorer, passes: int = PASSES, seed: int = 1) -> DataFrame:
    return take_least(disagreement(scorer.predict_prob_passes(unlabeled(pool, labels), passes, seed)), n)


def kmeans_sampling(
    pool: DataFrame, labels: DataFrame, n: int, rounds: int = 10, seed: int = 1, scorer: Scorer | None = None
) -> DataFrame:
    """Of n clusters of the unlabelled rows the member nearest to each centre. An empty cluster gives none."""
    rows = unlabeled(pool, labels)
    rows = rows if scorer is None else scorer.embeddings(rows)
    centroids = clustering.kmeans(rows, n, rounds, seed)
    members = clustering.assign_clusters(rows, centroids)
    near = members.groupBy("cid").agg(F.min(F.struct(F.round("d2", PLACES).alias("score"), "id")).alias("near"))
    return near.select("near.id", "near.score").orderBy("score", "id")


def feature_kmeans_sampling(features: DataFrame, n: int, rounds: int = 10, seed: int = 3, tries: int = 1) -> DataFrame:
    """For each of n centres of a feature table the nearest row of all; rows found twice count once. Of several tries,
    each from its own seeded start, the centres of least potential are taken.

    Feature tables hold only rows still to be chosen: evict the chosen ones with :func:`pool.evict`.
    """
    centroids = clustering.kmeans(features, n, rounds, seed, tries=tries)
    return clustering.nearest_rows(features, centroids)


def kcenter_greedy(pool: DataFrame, labels: DataFrame, n: int, materialize_every: int = 8) -> DataFrame:
    """n times the unlabelled row farthest from all labelled and chosen ones; the score is minus that distance, in
    order of choice.

    Each unlabelled row carries its squared distance to the nearest centre, first against the labelled ones in Arrow
    batches, then lowered by each pick; distances are cut from their lineage every few picks.
    """
    every = pool.select("id", "vec")
    state = _to_nearest(unlabeled(every, labels), every.join(labels.select("id"), "id", "left_semi"))
    picked: list[tuple[int, float]] = []
    for i in range(n):
        far = state.agg(F.max(F.struct(F.round("d2", PLACES).alias("d2"), (-F.col("id")).alias("neg"))).alias("m"))
        row = state.join(F.broadcast(far), (F.round("d2", PLACES) == F.col("m.d2")) & (-F.col("id") == F.col("m.neg")))
        found = row.select("id", "d2", "vec").take(1)
        if not found:
            break
        picked.append((found[0]["id"], -float(np.sqrt(max(found[0]["d2"], 0.0)))))
        last = literal(found[0]["vec"])
        state = state.where(F.col("id") != found[0]["id"]).withColumn(
            "d2", F.least("d2", squared_distance(F.col("vec"), last))
        )
        if (i + 1) % materialize_every == 0 and i + 1 < n:
            state = clustering.cut(state)
    spark = pool.sparkSession
    return spark.createDataFrame(picked, "id long, score double").select("id", rounded(F.col("score")).alias("score"))


def _to_nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, vec, d2): each row's squared distance to the nearest centre. Centres are what people have labelled so far,
    however many: they go to the tasks in blocks of bounded size, and every block lowers the distances left by those
    before it. A task holds one block and a bounded number of distances."""
    state = rows.select("id", "vec", F.lit(float("inf")).alias("d2"))
    some = False
    for matrix in clustering.blocks(centres, kernels.MAX_MATRIX_BYTES // 4):
        state, some = clustering.cut(clustering.lowered(state, matrix)), True
    return state if some else clustering.cut(state)


def _adversarial(
    rows: DataFrame, cost: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(1))
            yield pa.record_batch(
                [batch.column(0), pa.array(cost(x) if len(x) else np.zeros(0))], names=["id", "score"]
            )

    return rows.select("id", "vec").mapInArrow(scored, "id long, score double")


def adversarial_bim(
    pool: DataFrame, labels: DataFrame, n: int, scorer: Scorer, eps: float = 0.05, max_iter: int = 100
) -> DataFrame:
    """Least squared size of a perturbation by signed gradient steps that changes the predicted class.

    At most ``max_iter`` steps; a row that has not changed by then keeps what it has.
    """
    weights, offsets = scorer.linear()

    def cost(x: np.ndarray) -> np.ndarray:
        eta = np.zeros_like(x)
        start = (x @ weights.T + offsets).argmax(axis=1)
        for _ in range(max_iter):
            z = (x + eta) @ weights.T + offsets
            now = z.argmax(axis=1)
            same = now == start
            if not same.any():
                break
            e = np.exp(z - z.max(axis=1, keepdims=True))
            gradient = (e / e.sum(axis=1, keepdims=True)) @ weights - weights[now]
            eta[same] += eps * np.sign(gradient[same])
        return (eta * eta).sum(axis=1)

    return take_least(_adversarial(unlabeled(pool, labels), cost), n)


def deepfool(
    pool: DataFrame, labels: DataFrame, n: int, scorer: Scorer, max_iter: int = 50, places: int = 12
) -> DataFrame:
    """Least squared distance to a class boundary, by steps to the nearest linearised boundary until the class changes.

    Scores are small, so they are ranked by more places.
    """
    weights, offsets = scorer.linear()

    def cost(x: np.ndarray) -> np.ndarray:
        eta = np.zeros_like(x)
        start = (x @ weights.T + offsets).argmax(axis=1)
        rows = np.arange(len(x))
        if len(weights) < 2:
            return np.zeros(len(x))
        for _ in range(max_iter):
            z = (x + eta) @ weights.T + offsets
            same = z.argmax(axis=1) == start
            if not same.any():
                break
            w = weights[None, :, :] - weights[start][:, None, :]
            f = z - z[rows, start][:, None]
            norm = np.sqrt((w * w).sum(axis=2))
            norm[rows, start] = np.inf
            value = np.abs(f) / np.where(norm > 0, norm, np.inf)
            value[rows, start] = np.inf
            to = value.argmin(axis=1)
            step = (value[rows, to] / norm[rows, to])[:, None] * w[rows, to]
            eta[same] += step[same]
            if not np.abs(step[same]).max() > 1e-15:  # on the boundary: only rounding keeps the class
                break
        return (eta * eta).sum(axis=1)

    return take_least(_adversarial(unlabeled(pool, labels), cost), n, places)


def deepfool_linear(pool: DataFrame, labels: DataFrame, n: int, scorer: Scorer, places: int = 12) -> DataFrame:
    """The closed form for a linear scorer: least f² / |w|² over the other classes, one step."""
    weights, offsets = scorer.linear()

    def cost(x: np.ndarray) -> np.ndarray:
        z = x @ weights.T + offsets
        start = z.argmax(axis=1)
        f = z - z[np.arange(len(x)), start][:, None]
        norm = squared_distances(weights, weights)[start]
        return np.where(norm > 1e-12, f * f / np.where(norm > 1e-12, norm, 1.0), np.inf).min(axis=1)

    return take_least(_adversarial(unlabeled(pool, labels), cost), n, places)


def hierarchical_sampling(
    features: DataFrame,
    n: int,
    n_clusters: tuple[int, ...] = (500, 200),
    sample_sizes: tuple[int, ...] = (15, 2),
    resamples: int = 10,
    rounds: int = 50,
    seed: int = 1,
    how: str = "r",
) -> DataFrame:
    """n rows balanced over a hierarchy of clusters. Ids are ids, n is honoured, k is clamped to the rows there are."""
    levels = hierarchy.hierarchical_kmeans(features, n_clusters, rounds, seed, sample_sizes, resamples)
    chosen = hierarchy.sample(levels, n, how=how, seed=seed)
    return chosen.groupBy("id").agg(F.lit(0.0).alias("score")).orderBy("id")
