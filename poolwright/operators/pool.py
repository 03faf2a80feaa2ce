"""The pool and its labelled state: a table of rows, and a table (id, round) of which are labelled since when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, seeded

METRICS = ("acc", "precision", "recall", "f1")


def pool_of(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec) with elements as doubles."""
    return table.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), doubles(F.col(vector_col)).alias("vec")
    )


def initial_labels(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, round 0) of n rows in seeded random order."""
    chosen = pool.select("id").orderBy(seeded(seed, F.col("id")), "id").limit(n)
    return chosen.withColumn("round", F.lit(0))


def labeled(pool: DataFrame, labels: DataFrame) -> DataFrame:
    return pool.join(labels.select("id"), "id", "left_semi")


def unlabeled(pool: DataFrame, labels: DataFrame) -> DataFrame:
    return pool.join(labels.select("id"), "id", "left_anti")


def with_mask(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole pool with a column is_labeled."""
    mask = labels.select("id").distinct().withColumn("is_labeled", F.lit(True))
    return pool.join(mask, "id", "left").withColumn("is_labeled", F.coalesce("is_labeled", F.lit(False)))


def counts(pool: DataFrame, labels: DataFrame, test: DataFrame) -> DataFrame:
    """n_labeled, n_unlabeled, n_train, n_test in one row."""
    state = with_mask(pool, labels).agg(
        F.count_if("is_labeled").alias("n_labeled"),
        F.count_if(~F.col("is_labeled")).alias("n_unlabeled"),
        F.count(F.lit(1)).alias("n_train"),
    )
    return state.crossJoin(test.agg(F.count(F.lit(1)).alias("n_test")))


def update(labels: DataFrame, positive: DataFrame, round_no: int, negative: DataFrame | None = None) -> DataFrame:
    """Mark ids labelled; ids marked before keep their round. Then mark the negative ones unlabelled again."""
    new = positive.select("id").distinct().withColumn("round", F.lit(round_no))
    out = labels.unionByName(new).groupBy("id").agg(F.min("round").alias("round"))
    return out if negative is None else out.join(negative.select("id"), "id", "left_anti")


def as_of(labels: DataFrame, round_no: int) -> DataFrame:
    """The labelled state after a round."""
    return labels.where(F.col("round") <= round_no)


def row_by_id(pool: DataFrame, row_id: int) -> DataFrame:
    """One row; IndexError if there is none."""
    found = pool.where(F.col("id") == row_id)
    if not found.limit(1).count():
        raise IndexError(f"no row has id {row_id}")
    return found


def class_dictionary(names: DataFrame, name_col: str) -> DataFrame:
    """(idx, name): class names in order, numbered from 0. Numbering is over distinct names only."""
    distinct = names.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct()
    order = F.array_sort(F.collect_list("name"))
    return distinct.agg(order.alias("names")).select(F.posexplode("names").alias("idx", "name"))


def normalized_pixels(pixels: Column, mean: tuple[float, ...], std: tuple[float, ...]) -> Column:
    """Interleaved 0-255 channel values as (x / 255 - mean) / std of their channel."""
    means, stds = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, std))
    channel = lambda i: i % F.lit(len(mean))
    return F.transform(
        pixels, lambda x, i: (x.cast("double") / 255.0 - F.get(means, channel(i))) / F.get(stds, channel(i))
    )


def evict(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Features of all but the given ids."""
    return features.join(ids.select("id"), "id", "left_anti")
