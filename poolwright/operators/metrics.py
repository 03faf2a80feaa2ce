"""Evaluation of predictions: tables (id, label, predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("acc"))


def per_class(predictions: DataFrame) -> DataFrame:
    """(cls, hits, called, support): one aggregate over each row's two classes."""
    both = F.array(
        F.struct(F.col("label").alias("cls"), F.lit(1).alias("is_true"), F.lit(0).alias("is_called")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).alias("is_true"), F.lit(1).alias("is_called")),
    )
    hit = (F.col("label") == F.col("predicted")).cast("int").alias("hit")
    rows = predictions.select(hit, F.explode(both).alias("s")).select("hit", "s.*")
    return rows.groupBy("cls").agg(
        F.sum(F.col("hit") * F.col("is_true")).alias("hits"),
        F.sum("is_called").alias("called"),
        F.sum("is_true").alias("support"),
    )


def weighted_scores(predictions: DataFrame) -> DataFrame:
    """acc, precision, recall, f1, weighted by support; a ratio without a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    hits, called, support = F.col("hits"), F.col("called"), F.col("support")
    classes = per_class(predictions).withColumns({"p": ratio(hits, called), "r": ratio(hits, support)})
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    mean = lambda x: F.sum(support * x) / F.sum(support)
    return classes.agg(
        (F.sum(hits) / F.sum(support)).alias("acc"),
        mean(F.col("p")).alias("precision"),
        mean(F.col("r")).alias("recall"),
        mean(f1).alias("f1"),
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """(label, predicted, n) for all pairs of classes that occur, zeros too."""
    labels = predictions.select(F.col("label").alias("c"))
    names = labels.union(predictions.select("predicted")).distinct()
    every = names.select(F.col("c").alias("label")).crossJoin(names.select(F.col("c").alias("predicted")))
    n = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def prediction_report(predictions: DataFrame, classes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Index, names of the true and the predicted class, whether they agree (1 or 0), and the path."""
    name = lambda c, out: classes.select(F.col("idx").alias(c), F.col("name").alias(out))
    rows = predictions.join(name("label", "real_class"), "label", "left").join(
        name("predicted", "predicted_class"), "predicted", "left"
    )
    rows = rows.join(paths, "id", "left") if paths is not None else rows.withColumn("path", F.lit(""))
    hit = (F.col("label") == F.col("predicted")).cast("int")
    return rows.select(F.col("id").alias("image_index"), "real_class", "predicted_class", hit.alias("correct"), "path")
