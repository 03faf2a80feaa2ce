"""The registered queries: each operator on the driver's tables.

The pool is ``embeddings``; rows whose id is a multiple of five are labelled and the others are the unlabelled pool.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import clustering as c
from ..operators import hierarchy as h
from ..operators import discriminant, draws, head, metrics, pool, reports, resume, strategies, textures
from ..operators.scorers import BatchModelScorer, PrototypeScorer, mean_of_passes
from ..sources import files, results, tables
from ..sources.features import FeatureTable
from . import loop, registry

N, K, ROUNDS, SEED, PASSES = 10, 5, 3, 1, 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return pool.pool_of(tables.table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).where("id % 5 = 0").select("id", F.lit(0).alias("round"))


def _unlabeled(spark: SparkSession, sf: str) -> DataFrame:
    return pool.unlabeled(_pool(spark, sf), _labels(spark, sf))


def _scorer(spark: SparkSession, sf: str) -> PrototypeScorer:
    return PrototypeScorer().fit(pool.labeled(_pool(spark, sf), _labels(spark, sf)))


def _start(spark: SparkSession, sf: str) -> np.ndarray:
    return c.first_centroids(_unlabeled(spark, sf), K, SEED)


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return c.assign_clusters(_unlabeled(spark, sf), _start(spark, sf))


@query
def pool_state_counts(spark, sf):  # noqa: ANN001, ANN201
    p = _pool(spark, sf)
    return pool.counts(p, _labels(spark, sf), p.where("label = 0"))


@query
def labeled_split(spark, sf):  # noqa: ANN001, ANN201
    return pool.labeled(_pool(spark, sf), _labels(spark, sf)).select("id", "label")


@query
def unlabeled_split(spark, sf):  # noqa: ANN001, ANN201
    return _unlabeled(spark, sf).select("id", "label")


@query
def pool_with_mask(spark, sf):  # noqa: ANN001, ANN201
    return pool.with_mask(_pool(spark, sf), _labels(spark, sf)).select("id", "is_labeled")


@query
def initial_labels_seeded(spark, sf):  # noqa: ANN001, ANN201
    return pool.initial_labels(_pool(spark, sf), 100, SEED)


@query
def label_update_union(spark, sf):  # noqa: ANN001, ANN201
    new = _pool(spark, sf).where("id % 3 = 0")
    return pool.update(_labels(spark, sf), new, 1)


@query
def label_update_negatives(spark, sf):  # noqa: ANN001, ANN201
    p = _pool(spark, sf)
    return pool.update(_labels(spark, sf), p.where("id % 3 = 0"), 1, p.where("id % 2 = 0"))


@query
def class_dictionary(spark, sf):  # noqa: ANN001, ANN201
    return pool.class_dictionary(tables.table(spark, sf, "documents"), "source")


@query
def feature_eviction(spark, sf):  # noqa: ANN001, ANN201
    chosen = strategies.random_sampling(_pool(spark, sf), _labels(spark, sf), N, SEED)
    return pool.evict(_unlabeled(spark, sf), chosen).select("id")


def _pixels(spark: SparkSession, sf: str, vec: Column) -> DataFrame:
    pixels = F.transform(vec, lambda x: F.floor((x + 1) * 100))
    values = pool.normalized_pixels(pixels, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    at = _pool(spark, sf).select("id", F.posexplode(values).alias("pos", "value"))
    return at.select("id", "pos", rounded(F.col("value")).alias("value"))


@query
def pixel_normalization_whole(spark, sf):  # noqa: ANN001, ANN201
    return _pixels(spark, sf, F.col("vec"))


@query
def class_prototypes(spark, sf):  # noqa: ANN001, ANN201
    from ..operators.scorers import prototypes

    rows = prototypes(pool.labeled(_pool(spark, sf), _labels(spark, sf)))
    return rows.select("cls", F.posexplode_outer("mean").alias("dim", "v")).select("cls", "dim", rounded(F.col("v")).alias("v"))


@query
def predict_prob(spark, sf):  # noqa: ANN001, ANN201
    p = _scorer(spark, sf).predict_prob(_unlabeled(spark, sf))
    return p.select("id", F.posexplode_outer("p").alias("cls", "p")).select("id", "cls", rounded(F.col("p")).alias("p"))


@query
def predict_class(spark, sf):  # noqa: ANN001, ANN201
    return _scorer(spark, sf).predict(_unlabeled(spark, sf))


@query
def random_sampling(spark, sf):  # noqa: ANN001, ANN201
    return strategies.random_sampling(_pool(spark, sf), _labels(spark, sf), N, SEED).select("id")


def _uncertainty(name: str) -> Query:
    return lambda spark, sf: strategies.uncertainty(
        _pool(spark, sf), _labels(spark, sf), N, _scorer(spark, sf), name
    )


def _uncertainty_dropout(name: str) -> Query:
    return lambda spark, sf: strategies.uncertainty_dropout(
        _pool(spark, sf), _labels(spark, sf), N, _scorer(spark, sf), name, PASSES, SEED
    )


for _query, _name in (("least_confidence", "LeastConfidence"), ("margin_sampling", "MarginSampling"), ("entropy_sampling", "EntropySampling")):
    QUERIES[_query] = _uncertainty(_name)
    QUERIES[f"{_query}_dropout"] = _uncertainty_dropout(_name)


@query
def mc_dropout_split_prob(spark, sf):  # noqa: ANN001, ANN201
    p = _scorer(spark, sf).predict_prob_passes(_unlabeled(spark, sf), PASSES, SEED)
    p = p.select("id", "pass", F.posexplode_outer("p").alias("cls", "p"))
    return p.select("id", F.col("pass").alias("pass_no"), "cls", rounded(F.col("p")).alias("p"))


@query
def mc_dropout_mean_prob(spark, sf):  # noqa: ANN001, ANN201
    p = mean_of_passes(_scorer(spark, sf).predict_prob_passes(_unlabeled(spark, sf), PASSES, SEED))
    return p.select("id", F.posexplode_outer("p").alias("cls", "p")).select("id", "cls", rounded(F.col("p")).alias("p"))


@query
def bald_dropout(spark, sf):  # noqa: ANN001, ANN201
    return strategies.bald(_pool(spark, sf), _labels(spark, sf), N, _scorer(spark, sf), PASSES, SEED)


def _pairs_whole(distance: str) -> Query:
    """Every row against every row whose id is divisible by 20: that set grows with the table."""

    def pairs(spark: SparkSession, sf: str) -> DataFrame:
        p = _pool(spark, sf)
        return c.pairwise_rounded(p, p.where("id % 20 = 0"), distance)

    return pairs


QUERIES["pairwise_l2_whole"] = _pairs_whole("l2")
QUERIES["pairwise_cosine_whole"] = _pairs_whole("cos")


@query
def assign_clusters(spark, sf):  # noqa: ANN001, ANN201
    return _assigned(spark, sf).select("id", "cid", rounded(F.col("d2")).alias("d2"))


@query
def compute_centroids(spark, sf):  # noqa: ANN001, ANN201
    means = c.member_means(_unlabeled(spark, sf), _assigned(spark, sf))
    means = means.select("cid", F.posexplode_outer("mean").alias("dim", "v"))
    return means.select("cid", "dim", rounded(F.col("v")).alias("v"))


@query
def sort_cluster_by_distance(spark, sf):  # noqa: ANN001, ANN201
    return c.sorted_by_distance(_assigned(spark, sf))


@query
def cluster_members(spark, sf):  # noqa: ANN001, ANN201
    members = c.cluster_members(_assigned(spark, sf))
    return members.select("cid", F.posexplode("members").alias("nth", "id"))


@query
def kmeans_potential(spark, sf):  # noqa: ANN001, ANN201
    out = c.potential(_unlabeled(spark, sf), _assigned(spark, sf))
    return out.select("cid", "n", rounded(F.col("potential"), 5).alias("potential"))


@query
def kmeans_fixed_iters(spark, sf):  # noqa: ANN001, ANN201
    centroids = c.kmeans(_unlabeled(spark, sf), K, ROUNDS, SEED)
    return c.assign_clusters(_unlabeled(spark, sf), centroids).select("id", "cid", rounded(F.col("d2"), 5).alias("d2"))


@query
def kmeans_plus_plus(spark, sf):  # noqa: ANN001, ANN201
    centroids = c.kmeans(_unlabeled(spark, sf), K, ROUNDS, SEED, start="kmeans++")
    return c.assign_clusters(_unlabeled(spark, sf), centroids).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@query
def saved_scorer_predict_prob(spark, sf):  # noqa: ANN001, ANN201
    """Probabilities of a scorer that was saved and loaded again."""
    path = c.shared_path(spark, "scorer")
    _scorer(spark, sf).save(spark, path)
    scored = PrototypeScorer.load(spark, path).predict_prob(_unlabeled(spark, sf))
    return scored.select("id", F.posexplode("p").alias("cls", "p")).select("id", "cls", rounded(F.col("p")).alias("p"))


@query
def kmeans_parallel(spark, sf):  # noqa: ANN001, ANN201
    centroids = c.kmeans(_unlabeled(spark, sf), K, ROUNDS, SEED, start="kmeans||")
    return c.assign_clusters(_unlabeled(spark, sf), centroids).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


class _Stopped(Exception):
    pass


@query
def kmeans_resumed(spark, sf):  # noqa: ANN001, ANN201
    """A run that is stopped at its third centre, again after its first round, and then goes on to the end."""
    path, rows = c.shared_path(spark, "kmeans-states"), c.cut(_unlabeled(spark, sf).select("id", "vec"))

    def stop_at(*place):  # noqa: ANN002, ANN202
        def after(phase, step):  # noqa: ANN001, ANN202
            if (phase, step) == place:
                raise _Stopped

        return after

    for place in (("start", 3), ("round", 1)):
        try:
            resume.resumable_kmeans(rows, K, ROUNDS, SEED, path, after=stop_at(*place))
        except _Stopped:
            continue
    centroids = resume.resumable_kmeans(rows, K, ROUNDS, SEED, path)
    return c.assign_clusters(rows, centroids).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@query
def kmeans_sampling(spark, sf):  # noqa: ANN001, ANN201
    out = strategies.kmeans_sampling(_pool(spark, sf), _labels(spark, sf), K, ROUNDS, SEED)
    return out.select("id", rounded(F.col("score"), 5).alias("score"))


@query
def feature_kmeans_sampling(spark, sf):  # noqa: ANN001, ANN201
    out = strategies.feature_kmeans_sampling(_unlabeled(spark, sf), K, ROUNDS, SEED)
    return out.select("id", rounded(F.col("score"), 5).alias("score"))


@query
def kcenter_greedy(spark, sf):  # noqa: ANN001, ANN201
    return strategies.kcenter_greedy(_pool(spark, sf), _labels(spark, sf), 3)


@query
def kcenter_greedy_whole(spark, sf):  # noqa: ANN001, ANN201
    return strategies.kcenter_greedy(_pool(spark, sf), _labels(spark, sf), N)


@query
def deepfool_linear(spark, sf):  # noqa: ANN001, ANN201
    out = strategies.deepfool_linear(_pool(spark, sf), _labels(spark, sf), N, _scorer(spark, sf), 10)
    return out


@query
def deepfool_iterative(spark, sf):  # noqa: ANN001, ANN201
    return strategies.deepfool(_pool(spark, sf), _labels(spark, sf), N, _scorer(spark, sf))


@query
def adversarial_bim(spark, sf):  # noqa: ANN001, ANN201
    return strategies.adversarial_bim(_pool(spark, sf), _labels(spark, sf), N, _scorer(spark, sf))


def _levels(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two levels that SQL can say too: clusters by the first centroids, and their numbers modulo 2."""
    low = _assigned(spark, sf).withColumnRenamed("id", "child")
    up = spark.range(K).select(F.col("id").alias("child"), (F.col("id") % 2).alias("cid"), F.lit(0.0).alias("d2"))
    return [low, up]


@query
def hierarchy_flat_sizes(spark, sf):  # noqa: ANN001, ANN201
    return h.flat_sizes(_levels(spark, sf))


@query
def random_selection(spark, sf):  # noqa: ANN001, ANN201
    return h.random_selection(_assigned(spark, sf), 3, SEED)


@query
def closest_selection(spark, sf):  # noqa: ANN001, ANN201
    return h.closest_selection(_assigned(spark, sf), 3)


@query
def subcluster_targets(spark, sf):  # noqa: ANN001, ANN201
    sizes = _assigned(spark, sf).groupBy(F.col("cid").alias("child")).agg(F.count(F.lit(1)).alias("size"))
    children = sizes.select((F.col("child") % 2).alias("parent"), "child", "size")
    targets = spark.createDataFrame([(0, 37), (1, 1000000)], "parent long, target long")
    return h.allocate(children, targets, SEED)


@query
def hierarchical_sampling(spark, sf):  # noqa: ANN001, ANN201
    return h.sample(_levels(spark, sf), 20, how="c", seed=SEED)


@query
def hierarchical_kmeans(spark, sf):  # noqa: ANN001, ANN201
    levels = h.hierarchical_kmeans(_unlabeled(spark, sf), (20, 5), 5, SEED)
    return h.flat_sizes(levels)


@query
def hierarchical_kmeans_resampled(spark, sf):  # noqa: ANN001, ANN201
    levels = h.hierarchical_kmeans(_unlabeled(spark, sf), (20, 5), 5, SEED, (5, 2), 2)
    return h.flat_sizes(levels)


@query
def hierarchical_kmeans_first(spark, sf):  # noqa: ANN001, ANN201
    levels = h.hierarchical_kmeans(_unlabeled(spark, sf), (20, 5), 5, SEED, start="first")
    return h.flat_sizes(levels)


@query
def hierarchical_kmeans_seeded(spark, sf):  # noqa: ANN001, ANN201
    """All levels and their resampling over tables, from seeded starts."""
    levels = h.hierarchical_kmeans(_unlabeled(spark, sf), (12, 4), 3, SEED, (5, 2), 2, start="seeded")
    return h.flat_sizes(levels)


@query
def weighted_draws(spark, sf):  # noqa: ANN001, ANN201
    """Rows drawn by their squared distance to the first centroid."""
    at = c.assign_clusters(_unlabeled(spark, sf), c.first_centroids(_unlabeled(spark, sf), 1, SEED))
    return draws.weighted_draws(at.select("id", F.col("d2").alias("weight")), 1000, SEED)


@query
def feature_table_refreshed(spark, sf):  # noqa: ANN001, ANN201
    """Features of half of the images, then of all, then again of all: how many were extracted each time, and stand then."""
    table = FeatureTable(spark, c.shared_path(spark, "features"), "embeddings", "ssrae", key=textures.feature_key("ssrae"))
    images, found = _images(spark, sf), []
    for step, rows in enumerate((images.where("id % 2 = 0"), images, images)):
        features, fresh = table.refresh(rows, textures.extract_features)
        found.append((step, fresh, features.count(), features.select("id").distinct().count()))
    return spark.createDataFrame(found, "step int, extracted long, n_rows long, n_ids long")


@query
def hc_sampling(spark, sf):  # noqa: ANN001, ANN201
    return strategies.hierarchical_sampling(_unlabeled(spark, sf), N, (20, 5), (5, 2), 2, 5, SEED)


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _unlabeled(spark, sf)
    return rows.select("id", "label").join(_scorer(spark, sf).predict(rows), "id")


@query
def accuracy(spark, sf):  # noqa: ANN001, ANN201
    return metrics.accuracy(_predictions(spark, sf)).select(rounded(F.col("acc")).alias("acc"))


@query
def lda_cross_validation(spark, sf):  # noqa: ANN001, ANN201
    out = discriminant.cross_validated(_pool(spark, sf), 10, SEED)
    return out.select("fold", "n", "hits", rounded(F.col("accuracy")).alias("accuracy"))


def _head(spark: SparkSession, sf: str) -> head.HeadScorer:
    return head.HeadScorer(hidden=16, epochs=4, batches=3, seed=SEED).fit(pool.labeled(_pool(spark, sf), _labels(spark, sf)))


@query
def head_training_summary(spark, sf):  # noqa: ANN001, ANN201
    out = _head(spark, sf).summary(spark)
    return out.select("epoch", rounded(F.col("loss")).alias("loss"), rounded(F.col("accuracy")).alias("accuracy"))


@query
def head_predict_prob(spark, sf):  # noqa: ANN001, ANN201
    out = _head(spark, sf).predict_prob(_unlabeled(spark, sf)).select("id", F.posexplode("p").alias("cls", "p"))
    return out.select("id", "cls", rounded(F.col("p")).alias("p"))


@query
def bald_dropout_head(spark, sf):  # noqa: ANN001, ANN201
    out = strategies.bald(_pool(spark, sf), _labels(spark, sf), N, _head(spark, sf), PASSES, SEED)
    return out.select("id", rounded(F.col("score")).alias("score"))


class _TwoLayers:
    """A model of plain numpy, read from the file that went to the executors."""

    def __init__(self, name: str):
        with np.load(SparkFiles.get(name)) as file:
            self.w1, self.b1, self.w2, self.b2 = (file[f"w{i}"] for i in range(4))

    def embeddings(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.embeddings(x) @ self.w2 + self.b2


@query
def user_model_kmeans_sampling(spark, sf):  # noqa: ANN001, ANN201
    """A model that was trained elsewhere, as a file; k-means works on its hidden units."""
    trained, name = _head(spark, sf), f"two-layers-{uuid.uuid4().hex[:8]}.npz"
    out = io.BytesIO()
    np.savez(out, **{f"w{i}": w for i, w in enumerate(trained.weights)})
    path = f"{c.shared_path(spark, 'model')}/{name}"
    files.write_bytes(spark, path, out.getvalue())
    spark.sparkContext.addFile(path)
    scorer = BatchModelScorer(lambda: _TwoLayers(name), trained.classes, len(trained.weights[0]))
    picked = strategies.kmeans_sampling(_pool(spark, sf), _labels(spark, sf), K, ROUNDS, SEED, scorer)
    return picked.select("id", rounded(F.col("score"), 5).alias("score"))


@query
def weighted_prf(spark, sf):  # noqa: ANN001, ANN201
    out = metrics.weighted_scores(_predictions(spark, sf))
    return out.select(*[rounded(F.col(m)).alias(m) for m in pool.METRICS])


@query
def confusion_matrix(spark, sf):  # noqa: ANN001, ANN201
    return metrics.confusion(_predictions(spark, sf))


@query
def prediction_report(spark, sf):  # noqa: ANN001, ANN201
    classes = spark.range(10).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("class"), F.col("id")).alias("name"))
    return metrics.prediction_report(_predictions(spark, sf), classes)


@query
def active_learning_curve(spark, sf):  # noqa: ANN001, ANN201
    p = _pool(spark, sf)
    test = p.where("id % 10 = 1")
    run = loop.learn(p.where("id % 10 <> 1"), test, "EntropySampling", PrototypeScorer(), _labels(spark, sf), N, ROUNDS)
    rows = [(r, m, round(v, 6)) for m, values in run.curve.items() for r, v in enumerate(values)]
    return spark.createDataFrame(rows, "round int, metric string, value double")


#: Runs of the experiment: strategy, n_query, seed.
EXPERIMENT = (("EntropySampling", 10, 1), ("EntropySampling", 5, 1), ("RandomSampling", 10, 1), ("RandomSampling", 10, 2), ("RandomSampling", 5, 2))


@query
def experiment_rolled_up(spark, sf):  # noqa: ANN001, ANN201
    """Runs of the loop, written as it writes them, read back and rolled up."""
    p, root = c.cut(_pool(spark, sf)), c.shared_path(spark, "experiment")
    train, test = p.where("id % 10 <> 1"), p.where("id % 10 = 1")
    for name, n, seed in EXPERIMENT:
        run = loop.learn(train, test, name, PrototypeScorer(), _labels(spark, sf), n, 1, seed, "pool")
        results.write_run(run.result(), f"{root}/SEED_{seed}/NQ_{n}/{name}")
    out = reports.rolled_up(reports.curves(results.read_runs(spark, root, strict=True)))
    figures = [rounded(F.col(x)).alias(x) for x in ("mean", "std", "least", "greatest")]
    return out.select("over", "seed", "n_query", "strategy", "metric", "runs", *figures)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose values follow from region keys, seeds and rounds, so that SQL can say them."""
    base = tables.table(spark, sf, "region").select("r_name", "r_regionkey").crossJoin(
        spark.range(1, 4).select(F.col("id").cast("int").alias("seed"))
    )
    value = lambda shift: F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda r: ((F.col("r_regionkey") * 7 + F.col("seed") * 3 + r * 5 + shift) % 11).cast("double") / 11.0,
    )
    runs = base.select(
        F.lit("pool").alias("dataset"),
        F.col("r_name").alias("strategy"),
        "seed",
        F.lit(10).alias("n_query"),
        value(0).alias("all_acc"),
        value(1).alias("all_precision"),
        value(2).alias("all_recall"),
        value(3).alias("all_f1_score"),
    )
    return reports.curves(runs)


@query
def report_last_round(spark, sf):  # noqa: ANN001, ANN201
    out = reports.last_round(_runs(spark, sf))
    return out.select("strategy", "seed", "metric", rounded(F.col("value")).alias("value"))


@query
def report_mean_std(spark, sf):  # noqa: ANN001, ANN201
    out = reports.mean_std(_runs(spark, sf))
    return out.select("strategy", "metric", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "shown")


@query
def report_pivot(spark, sf):  # noqa: ANN001, ANN201
    out = reports.strategy_table(_runs(spark, sf))
    return out.select("strategy", "seed", *[rounded(F.col(m)).alias(m) for m in reports.METRICS])


@query
def report_curves(spark, sf):  # noqa: ANN001, ANN201
    out = reports.strategy_curves(_runs(spark, sf))
    return out.select("metric", "strategy", "round", rounded(F.col("mean")).alias("mean"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).withColumn("path", F.concat(F.lit("vec/"), F.col("id")))


@query
def index_export_whole(spark, sf):  # noqa: ANN001, ANN201
    rows = _paths(spark, sf)
    return results.index_export(rows.where("id % 10 <> 1"), rows.where("id % 10 = 1"))


@query
def texture_lcg_weights(spark, sf):  # noqa: ANN001, ANN201
    rows = [(q, p, i, float(v)) for q, p in ((13, 9), (5, 27), (17, 27)) for i, v in enumerate(textures.hidden_weights(q, p).ravel())]
    rows = spark.createDataFrame(rows, "q int, p int, pos int, v double")
    return rows.select("q", "p", "pos", rounded(F.col("v"), 4).alias("v"))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """64 numbers of each unlabelled vector as a picture of 8 x 8, in three shades."""
    shades = F.flatten(F.transform("vec", lambda x: F.array(*[F.floor((x + 1) * s).cast("int") for s in (127, 100, 60)])))
    hexes = F.array_join(F.transform(shades, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    rows = _unlabeled(spark, sf)
    return rows.select("id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexes).alias("pixels"))


@query
def ssrae_features(spark, sf):  # noqa: ANN001, ANN201
    return textures.extract_features(_images(spark, sf), "ssrae")


@query
def vctex_features(spark, sf):  # noqa: ANN001, ANN201
    return textures.extract_features(_images(spark, sf), "vctex")


def _texture_sampling(strategy: str) -> Query:
    """Features of every unlabelled image, written once for the extractor and its parameters, and rows chosen by them."""

    def chosen(spark: SparkSession, sf: str) -> DataFrame:
        features = registry.features_for(strategy, _images(spark, sf), c.shared_path(spark, "features"))
        return registry.strategy(strategy)(None, None, N, None, features, SEED)

    return chosen


QUERIES["ssrae_kmeans_sampling"] = _texture_sampling("SSRAEKmeansSampling")
QUERIES["vctex_kmeans_sampling"] = _texture_sampling("VCTexKmeansSampling")
QUERIES["ssrae_kmeans_hc_sampling"] = _texture_sampling("SSRAEKmeansHCSampling")
