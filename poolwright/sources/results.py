"""Run results and exports: JSON and CSV in the layouts that reports expect."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

SCHEMA = (
    "dataset_name string, strategy_name string, n_init_labeled int, n_query int, n_round int, seed int, "
    "all_acc array<double>, all_precision array<double>, all_recall array<double>, all_f1_score array<double>, "
    "rounds array<int>"
)


def hyper_parameters(path: str, dataset: str) -> dict:
    """The parameters of one dataset from a JSON file keyed by dataset; KeyError if it has none."""
    return json.loads(files.read_bytes(SparkSession.active(), path))[dataset]


def run_folder(root: str, dataset: str, seed: int, n_query: int, n_init: int, n_round: int, n_epoch: int, strategy: str) -> str:
    return f"{root}/{dataset}/SEED_{seed}/NQ_{n_query}_NIL_{n_init}_NR_{n_round}_NE_{n_epoch}/{strategy}"


def read_runs(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """All results.json under root/SEED_*/NQ_*/strategy, with where they came from.

    ``strict`` raises ValueError if a strategy folder has none; else such folders are skipped.
    """
    if strict:
        for folder in files.matching(spark, f"{root}/SEED_*/NQ_*/*"):
            if "results.json" not in files.names(spark, folder):
                raise ValueError(f"{folder} has no results.json")
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(f"{root}/SEED_*/NQ_*/*/results.json")
    path = F.input_file_name()
    return rows.select(
        F.col("dataset_name").alias("dataset"),
        F.col("strategy_name").alias("strategy"),
        "seed",
        "n_query",
        "n_init_labeled",
        "n_round",
        "all_acc",
        "all_precision",
        "all_recall",
        "all_f1_score",
        "rounds",
        F.regexp_extract(path, r"(NQ_[^/]+)", 1).alias("config"),
    )


def write_run(result: dict, folder: str) -> None:
    files.write_bytes(SparkSession.active(), f"{folder}/results.json", json.dumps(result, indent=4).encode())


def write_experiment(runs: DataFrame, path: str) -> None:
    """What an experiment found, in a folder for each seed and n_query: the curves of each strategy as JSON, and their last
    values as CSV with semicolons, one file each; what is there is replaced.

    ``runs`` are those of :func:`read_runs`. Runs of one strategy are rows of one file, in order of the strategy.
    """
    runs = runs.repartition("seed", "n_query").sortWithinPartitions("seed", "n_query", "strategy")
    curves = ("all_acc", "all_precision", "all_recall", "all_f1_score")
    kept = runs.select("dataset", "strategy", "seed", "n_query", "n_init_labeled", "n_round", "rounds", *curves)
    kept.write.mode("overwrite").partitionBy("seed", "n_query").json(f"{path}/data_experiment_json")
    last = runs.select("strategy", "seed", "n_query", *[F.element_at(F.col(c), -1).alias(c) for c in curves])
    last.write.mode("overwrite").partitionBy("seed", "n_query").option("header", True).option("sep", ";").csv(f"{path}/data_experiment_csv")


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def index_export(train: DataFrame, test: DataFrame) -> DataFrame:
    """(split, id, class_name, path) of both splits; class_name is the class index, as readers of the file expect."""
    one = lambda df, split: df.select(
        F.lit(split).alias("split"), "id", F.col("label").alias("class_name"), F.col("path")
    )
    return one(train, "train").unionByName(one(test, "test"))
