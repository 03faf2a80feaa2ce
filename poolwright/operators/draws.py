"""Draws in proportion to weights: many positions looked up in a distributed running sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import seeded
from .clustering import cut

#: Most range partitions, of which one number each goes to all tasks.
MAX_RANGES = 10_000


def running_sums(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """(id, weight, range, low, high): each row's interval in the running sum of weights by id; written.

    Ids are dealt to ranges, each range sums its own rows in order, and what all ranges before it sum to, one number for
    each, is added. No task sees more than its range. Rows with a null id or weight, or a weight of 0 or less, have no
    interval; rows that repeat an id have one each, one behind the other.
    """
    spark = rows.sparkSession
    ranges = min(MAX_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.where("id IS NOT NULL AND weight > 0").select("id", F.col("weight").cast("double").alias("weight"))
    dealt = cut(rows.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()))
    in_range = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut(dealt.withColumn("own", F.sum("weight").over(in_range)))
    so_far, offsets = 0.0, []
    for r in summed.groupBy("range").agg(F.max("own").alias("s")).orderBy("range").collect():  # a number for each range
        offsets.append((r["range"], so_far))
        so_far += r["s"]
    before = spark.createDataFrame(offsets, "range int, before double")
    placed = summed.join(F.broadcast(before), "range").withColumn("high", F.col("before") + F.col("own"))
    low = F.coalesce(F.lag("high").over(Window.partitionBy("range").orderBy("id", "own")), F.col("before"))
    return cut(placed.withColumn("low", low).select("id", "weight", "range", "low", "high"))


def look_up(sums: DataFrame, places: DataFrame) -> DataFrame:
    """(draw, place, id): for each (draw, place) the row whose interval [low, high) has the place; null beyond the last.

    Places go to the range that has them, by the ranges' bounds, and are sorted in among its intervals: one pass,
    however many places there are, and no pairs. A place below 0 belongs to the first row.
    """
    bounds = sums.groupBy("range").agg(F.max("high").alias("high")).orderBy("range").collect()  # a number for each range
    if not bounds:
        return places.select("draw", "place", F.lit(None).cast("long").alias("id"))
    names = F.array(*[F.lit(r["range"]) for r in bounds])
    highs = F.array(*[F.lit(r["high"]) for r in bounds])
    below = F.size(F.filter(highs, lambda h: h <= F.col("place")))
    asked = places.withColumn("range", F.coalesce(F.get(names, below), F.lit(bounds[-1]["range"])))
    marks = asked.select("range", F.col("place").alias("at"), F.lit(0).alias("kind"), "draw", F.lit(None).cast("long").alias("id"))
    ends = sums.select("range", F.col("high").alias("at"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("draw"), "id")
    # an interval ends before a place at its end
    ahead = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    found = marks.unionByName(ends).withColumn("found", F.first("id", ignorenulls=True).over(ahead))
    return found.where("draw IS NOT NULL").select("draw", F.col("at").alias("place"), F.col("found").alias("id"))


def weighted_draws(rows: DataFrame, n: int, seed: int, ranges: int | None = None) -> DataFrame:
    """(draw, id): n rows of (id, weight), with repetition, each in proportion to its weight.

    Draw k stands at u * total, with u from the seeded hash of k, so reruns agree. No weights give no draws.
    """
    sums = running_sums(rows, ranges)
    total = sums.agg(F.max("high")).first()[0] or 0.0
    u = F.conv(F.substring(seeded(seed, F.col("id")), 1, 12), 16, 10).cast("double") / 2.0**48
    places = rows.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), (u * F.lit(total)).alias("place"))
    return look_up(sums, places).select("draw", "id")
