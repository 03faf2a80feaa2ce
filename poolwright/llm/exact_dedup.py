"""Exact deduplication with the frequent digests split off before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, materialize

#: A digest that more than this share of the rows carry is certain to be split off.
SUPPORT = 1 / 1000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: its digest, the id that stays for its text, and the size of its group.

    Texts are equal when they are identical after lower-casing A-Z. The largest id of a group stays.

    1. One scan turns each text into its SHA-256; only (id, digest) goes on, written once.
    2. A Misra-Gries summary (``freqItems``: at most 1/support counters per task, merged) names every digest with
       more than ``support`` of the rows, and perhaps some others. Counting those exactly gives the verified
       winners: at most 1/support rows, whatever the input, so they may be broadcast.
    3. Rows of those digests are resolved on the map side and never shuffled. No other digest has more than
       ``support`` of the rows; these go through an ordinary shuffle, aggregated before it.

    Result: ``id_col``, keep_id, group_size long, kept boolean, text_sha256 (lowercase hex).
    Null text counts as empty. A null id is below every other id; if a group has only null ids, keep_id is null and
    its rows are kept. Rows that repeat an id and a text are the same document and get the same verdict, each counting
    in group_size. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    digests = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256).alias("digest"),
        ),
        "digests",
    )
    summary = digests.stat.freqItems(["digest"], support)
    candidates = summary.select(F.explode("digest_freqItems").alias("digest"))
    winner = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # bounded by the summary: at most 1/support rows
    winners = materialize(digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*winner), "winners")

    frequent = digests.join(F.broadcast(winners), "digest")
    others = digests.join(F.broadcast(winners), "digest", "left_anti")
    resolved = others.join(others.groupBy("digest").agg(*winner), "digest")
    return frequent.unionByName(resolved).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
