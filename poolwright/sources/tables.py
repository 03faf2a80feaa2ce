"""Parquet tables, feature caches, cluster levels and row slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A Parquet table; ValueError if one of the columns is missing."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def cached_features(features: DataFrame, path: str, labels: DataFrame | None = None) -> DataFrame:
    """Features written once and read from then on; rows labelled meanwhile are left out."""
    if not exists(features.sparkSession, path):
        features.write.mode("ignore").parquet(path)
    out = features.sparkSession.read.parquet(path)
    return out if labels is None else out.join(labels.select("id"), "id", "left_anti")


def write_levels(levels: list[DataFrame], path: str) -> None:
    """A cluster hierarchy, partitioned by level."""
    out = levels[0].withColumn("level", F.lit(1))
    for number, level in enumerate(levels[1:], start=2):
        out = out.unionByName(level.withColumn("level", F.lit(number)))
    out.write.mode("overwrite").partitionBy("level").parquet(path)


def read_levels(spark: SparkSession, path: str) -> list[DataFrame]:
    rows = spark.read.parquet(path)
    top = rows.agg(F.max("level")).first()[0] or 0
    return [rows.where(F.col("level") == n).drop("level") for n in range(1, top + 1)]


def row_slice(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_semi")


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of least id."""
    return rows.orderBy("id").limit(n)
