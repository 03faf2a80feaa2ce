"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents, in their order, whatever their names.

Null and empty texts have too few words for the quality rules, so only a stage that is called alone sees them: they are
kept as one empty line, are nobody's near copies, weigh nothing in the mix, so it takes none, and have no pieces. Rows that
repeat are near copies, of which one stays; null ids and null sources are ids and a source like any other. An empty table
gives an empty table at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.llm.line_dedup import dedup_lines
from poolwright.llm.mixing import mix_sources
from poolwright.llm.near_dedup import near_dedup
from poolwright.llm.quality_rules import quality_filter
from poolwright.llm.runtime import drop_path, work_path
from poolwright.llm.sentencepiece_codec import encode_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars follows the text. No document goes, not even an emptied one."""
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least id."""
    return near_dedup(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows that share an id are taken alike."""
    mix = mix_sources(docs).where("taken > 0")
    times = mix.groupBy(F.col("doc_id").alias("taken_id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(times, F.col("id").eqNullSafe(F.col("taken_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document: doc_id, n_ids, ids, round_trip."""
    return encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", tokenize_stage),
]

#: Neither near-duplicate classes, the budget fit nor the pieces can be said in SQL; tests hold the rows against brute
#: force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
