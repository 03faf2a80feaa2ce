"""Reports over runs: long tables (dataset, strategy, seed, n_query, round, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("acc", "precision", "recall", "f1")
RUN = ("dataset", "strategy", "seed", "n_query")


def curves(runs: DataFrame) -> DataFrame:
    """Run results with an array all_<metric> each, as a long table; rounds count from 0."""
    names = {"acc": "all_acc", "precision": "all_precision", "recall": "all_recall", "f1": "all_f1_score"}
    arrays = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("values")) for m, c in names.items()])
    rows = runs.select(*RUN, F.explode(arrays).alias("a")).select(*RUN, "a.metric", F.posexplode("a.values"))
    return rows.select(*RUN, F.col("pos").alias("round"), "metric", F.col("col").alias("value"))


def last_round(long: DataFrame) -> DataFrame:
    """The value of each run's last round."""
    return long.groupBy(*RUN, "metric").agg(F.max_by("value", "round").alias("value"))


def mean_std(long: DataFrame, plus_minus: str = "%.4f (±%.4f)") -> DataFrame:
    """Mean and population deviation over seeds of the last rounds, and both as text."""
    out = last_round(long).groupBy("n_query", "strategy", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    return out.withColumn("shown", F.format_string(plus_minus, "mean", "std"))


#: What the roll-up is taken over; metrics are never mixed.
ROLLED = (("seed", "n_query", "strategy"), ("n_query", "strategy"), ("seed", "strategy"), ("strategy",), ("n_query",), ())


def rolled_up(long: DataFrame) -> DataFrame:
    """Runs, mean, population deviation, least and greatest of the last rounds, by each of ``ROLLED`` and metric.

    One pass by grouping sets: ``over`` names what a row is grouped by, joined by commas, and what it is not grouped by
    is null. A run without rounds or with a null last value counts in no figure. No runs, no rows.
    """
    columns = ("seed", "n_query", "strategy")
    last = last_round(long).where("value IS NOT NULL")
    sets = [[F.col(c) for c in (*names, "metric")] for names in ROLLED]
    out = last.groupingSets(sets, *columns, "metric").agg(
        F.count("value").alias("runs"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        *[F.grouping(c).alias(f"__{c}") for c in columns],
    )
    over = F.concat_ws(",", *[F.when(F.col(f"__{c}") == 0, F.lit(c)) for c in columns])
    return out.select(over.alias("over"), *columns, "metric", "runs", "mean", "std", "least", "greatest")


def strategy_table(long: DataFrame) -> DataFrame:
    """A row for each strategy, seed and n_query with a column for each metric."""
    return last_round(long).groupBy("strategy", "seed", "n_query").pivot("metric", list(METRICS)).agg(F.first("value"))


def strategy_curves(long: DataFrame) -> DataFrame:
    """(n_query, metric, strategy, round, mean): what a comparison plot shows."""
    return long.groupBy("n_query", "metric", "strategy", "round").agg(F.avg("value").alias("mean"))


def nested(long: DataFrame) -> DataFrame:
    """(seed, by_n_query): the last values as nested maps n_query -> strategy -> metric -> value."""
    by_strategy = last_round(long).groupBy("seed", "n_query", "strategy").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m")
    )
    by_n = by_strategy.groupBy("seed", "n_query").agg(
        F.map_from_entries(F.collect_list(F.struct("strategy", "m"))).alias("m")
    )
    return by_n.groupBy("seed").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("n_query").cast("string"), "m"))).alias("by_n_query")
    )
