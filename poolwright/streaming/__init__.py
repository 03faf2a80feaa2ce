"""Scoring a pool that grows: rows of a stream against a fitted scorer, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.scorers import Scorer
from ..operators.strategies import SCORES


def score_stream(rows: DataFrame, scorer: Scorer, score: str = "EntropySampling") -> DataFrame:
    """(id, score) for each row (id, vec) of a streaming or batch table; the least score is the most uncertain."""
    from pyspark.sql import functions as F

    return scorer.predict_prob(rows).select("id", SCORES[score](F.col("p")).alias("score"))
