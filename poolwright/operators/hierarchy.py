"""Hierarchies of clusters and balanced sampling from them.

A hierarchy is a list of levels. Level 0 is a table (child, cid, d2): which cluster a row is in; level l > 0 the same for
the clusters of the level below. Sampling goes top down: each parent's target is spread evenly over its children.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import seeded
from . import clustering


def hierarchical_kmeans(
    features: DataFrame,
    n_clusters: tuple[int, ...],
    rounds: int = 50,
    seed: int = 1,
    sample_sizes: tuple[int, ...] | None = None,
    resamples: int = 10,
    start: str = "kmeans++",
) -> list[DataFrame]:
    """Levels by k-means of the rows, then of the centroids of the level below.

    With ``sample_sizes``, a level whose size is above 1 is refined: so often the nearest members of each cluster are
    taken, k-means is run on these, and all points are assigned again. ValueError if lengths differ. k is clamped to
    what there is to cluster. ``start`` is that of all k-means but the lowest one, which starts from the first rows in
    seeded order: greedy k-means++, or the first points there are (first). ValueError for another.

    With start "seeded" or "parallel" points, samples and the centroids of every level are tables, and all k-means run
    over them, from the first rows in seeded order or from :func:`clustering.kmeans_parallel`; the driver has no more
    than the centroids of a level. Samples too large for a driver's matrix go that way in any case.
    """
    if start not in ("kmeans++", "first", "seeded", "parallel"):
        raise ValueError(f"unknown start {start!r}")
    if sample_sizes is not None and len(sample_sizes) != len(n_clusters):
        raise ValueError("one sample size for each level is needed")
    if start not in ("seeded", "parallel"):
        head = features.select(F.size("vec")).limit(1).collect()
        largest = max(k * s for k, s in zip(n_clusters, sample_sizes, strict=True)) if sample_sizes else 0
        if head and 8 * largest * head[0][0] > kernels.MAX_MATRIX_BYTES:
            start = "seeded" if start == "first" else "parallel"
    if start in ("seeded", "parallel"):
        how = "first" if start == "seeded" else "kmeans||"
        return _levels_of_tables(features, n_clusters, rounds, seed, sample_sizes, resamples, how)
    rng = np.random.default_rng(seed)
    spark, levels = features.sparkSession, []

    def clustered(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(k, len(x))
        first = np.arange(k) if start == "first" else kernels.greedy_kmeans_plus_plus(x, k, rng)
        return kernels.lloyd(x, x[first], rounds)[:2]

    rows = clustering.cut(features.select("id", "vec"))
    centroids = np.zeros((0, 0))
    for level, k in enumerate(n_clusters):
        size = sample_sizes[level] if sample_sizes else 0
        if level == 0:
            centroids = clustering.lloyd(rows, clustering.first_centroids(rows, k, seed), rounds)
            for _ in range(resamples if size > 1 else 0):
                nearest = clustering.sorted_by_distance(clustering.assign_clusters(rows, centroids), 12)
                ids = F.broadcast(nearest.where(F.col("nth") <= size).select("id"))  # at most k * size: rows stay where they are
                sample = rows.join(ids, "id").orderBy("id").select("vec").collect()
                x = kernels.checked(np.array([r["vec"] for r in sample]))
                centroids, _ = clustered(x, k)
            assigned = clustering.cut(clustering.assign_clusters(rows, centroids))
            levels.append(assigned.withColumnRenamed("id", "child"))
            continue
        x = centroids  # the centroids below are few by their check
        k = min(k, len(x))
        centroids, which = clustered(x, k)
        for _ in range(resamples if size > 1 else 0):
            d2 = kernels.squared_distances(x, centroids)
            take = [i for c in range(len(centroids)) for i in np.flatnonzero(which == c)[np.argsort(d2[which == c, c], kind="stable")][:size]]
            centroids, _ = clustered(x[take], k)
            which, _ = kernels.nearest(x, centroids)
        which, d2 = kernels.nearest(x, centroids)
        rows_of_level = list(zip(range(len(x)), which.tolist(), d2.tolist(), strict=True))
        levels.append(spark.createDataFrame(rows_of_level, "child long, cid long, d2 double"))
    return levels


def _levels_of_tables(
    features: DataFrame, n_clusters: tuple[int, ...], rounds: int, seed: int, sample_sizes: tuple[int, ...] | None, resamples: int, start: str
) -> list[DataFrame]:
    spark, levels = features.sparkSession, []
    points = clustering.cut(features.select("id", "vec"))
    for level, k in enumerate(n_clusters):
        size = sample_sizes[level] if sample_sizes else 0
        centroids = clustering.kmeans(points, k, rounds, seed, start)
        for _ in range(resamples if size > 1 else 0):
            nearest = clustering.sorted_by_distance(clustering.assign_clusters(points, centroids), 12)
            sample = nearest.where(F.col("nth") <= size).join(points, "id").select("id", "vec")
            centroids = clustering.kmeans(sample, k, rounds, seed, start)
        assigned = clustering.cut(clustering.assign_clusters(points, centroids))
        levels.append(assigned.withColumnRenamed("id", "child"))
        # as many rows as clusters, whose matrix has been checked
        points = clustering.cut(spark.createDataFrame(list(enumerate(centroids.tolist())), "id long, vec array<double>"))
    return levels


def flat_members(levels: list[DataFrame]) -> DataFrame:
    """(level, cid, id): the rows below each cluster of each level."""
    below = levels[0].select(F.col("child").alias("id"), "cid")
    out = below.select(F.lit(1).alias("level"), "cid", "id")
    for number, level in enumerate(levels[1:], start=2):
        parent = level.select(F.col("child").alias("below"), F.col("cid").alias("parent"))
        below = below.join(parent, below["cid"] == parent["below"]).select("id", F.col("parent").alias("cid"))
        out = out.unionByName(below.select(F.lit(number).alias("level"), "cid", "id"))
    return out


def flat_sizes(levels: list[DataFrame]) -> DataFrame:
    """(level, cid, size, place): sizes and their order within the level, the largest first."""
    sizes = flat_members(levels).groupBy("level", "cid").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("size"), "cid"))
    return sizes.withColumn("place", place.cast("long"))


def random_selection(assignment: DataFrame, m: int, seed: int) -> DataFrame:
    """(cid, id): m members of each cluster in seeded random order."""
    nth = F.row_number().over(Window.partitionBy("cid").orderBy(seeded(seed, F.col("id")), "id"))
    return assignment.select("cid", "id", nth.alias("nth")).where(F.col("nth") <= m).drop("nth")


def closest_selection(assignment: DataFrame, m: int) -> DataFrame:
    """(cid, id): the m members nearest to the centre."""
    return clustering.sorted_by_distance(assignment).where(F.col("nth") <= m).select("cid", "id")


def best_cut(sizes: list[int], target: int) -> int:
    """The greatest x with sum(min(x, size)) at most target; the greatest size if all fit. ValueError if negative."""
    if target < 0 or any(s < 0 for s in sizes):
        raise ValueError("sizes and target must not be negative")
    left, order = target, sorted(sizes)
    for i, size in enumerate(order):
        x = left // (len(order) - i)
        if x < size:
            return x
        left -= size
    return order[-1] if order else 0


def allocate(children: DataFrame, targets: DataFrame, seed: int, multiplier: int = 1) -> DataFrame:
    """(parent, child, target): each parent's target spread over its children as evenly as their sizes allow.

    ``children`` is (parent, child, size), ``targets`` (parent, target). The cut follows from running sums of the sizes
    in order; what is left of the target goes one each to children above the cut, in seeded random order. No child gets
    more than its size (times ``multiplier``), and an empty one nothing.
    """
    rows = children.join(targets, "parent").withColumn("size", F.col("size") * F.lit(multiplier))
    of_parent = Window.partitionBy("parent")
    by_size = of_parent.orderBy("size", "child")
    smaller = F.coalesce(F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count(F.lit(1)).over(of_parent) - F.row_number().over(by_size) + 1
    rows = rows.withColumns({"x": F.floor((F.col("target") - smaller) / left), "at": F.row_number().over(by_size)})
    # the first child, by size, that does not fit whole sets the cut
    first = F.min(F.when(F.col("x") < F.col("size"), F.struct("at", "x"))).over(of_parent)
    rows = rows.withColumn("first", first)
    rows = rows.withColumn("cut", F.coalesce("first.x", F.max("size").over(of_parent)))
    rows = rows.withColumn("share", F.least("cut", "size"))
    rest = F.least(F.col("target"), F.sum("size").over(of_parent)) - F.sum("share").over(of_parent)
    above = F.col("size") > F.col("cut")
    order = of_parent.orderBy(above.desc(), seeded(seed, F.col("child")), "child")
    rows = rows.withColumns({"rest": rest, "nth": F.row_number().over(order)})
    more = (above & (F.col("nth") <= F.col("rest"))).cast("long")
    return rows.select("parent", "child", (F.col("share") + more).cast("long").alias("target"))


def sample(levels: list[DataFrame], target: int, multiplier: int = 1, how: str = "r", seed: int = 1) -> DataFrame:
    """(id): target rows, balanced over the hierarchy; a row up to ``multiplier`` times.

    ``how``: within a bottom cluster rows come in seeded random order (r) or by distance (c). All members are taken as
    often as the cluster's target allows, the first ones once more. ValueError for another ``how`` or a negative target.
    """
    if how not in ("r", "c") or target < 0:
        raise ValueError("how must be r or c, and target not negative")
    sizes = flat_sizes(levels).select("level", "cid", "size")
    spark = levels[0].sparkSession
    top = sizes.where(F.col("level") == len(levels)).select(
        F.lit(0).cast("long").alias("parent"), F.col("cid").alias("child"), "size"
    )
    whole = spark.createDataFrame([(0, target)], "parent long, target long")
    targets = allocate(top, whole, seed, multiplier).select(F.col("child").alias("parent"), "target")
    for number in range(len(levels) - 1, 0, -1):
        below = sizes.where(F.col("level") == number).select(F.col("cid").alias("child"), "size")
        children = levels[number].select(F.col("cid").alias("parent"), "child").join(below, "child")
        shares = allocate(children.select("parent", "child", "size"), targets, seed + number, multiplier)
        targets = shares.select(F.col("child").alias("parent"), "target")
    rows = levels[0].select(F.col("child").alias("id"), "cid", "d2")
    order = [seeded(seed, F.col("id")), F.col("id")] if how == "r" else [F.round("d2", 6), F.col("id")]
    placed = rows.join(targets.withColumnRenamed("parent", "cid"), "cid").withColumns(
        {
            "nth": F.row_number().over(Window.partitionBy("cid").orderBy(*order)),
            "n": F.count(F.lit(1)).over(Window.partitionBy("cid")),
        }
    )
    times = F.floor(F.col("target") / F.col("n")) + (F.col("nth") <= F.col("target") % F.col("n")).cast("long")
    placed = placed.withColumn("times", times.cast("int")).where("times > 0")
    return placed.select("id", F.explode(F.sequence(F.lit(1), F.col("times")))).select("id")
