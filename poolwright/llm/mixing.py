"""Mixing sources to target weights by fitting each source's word budget exactly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import count_words, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Words that the dynamic programme covers: so many, and at least so many lengths of the longest document.
WINDOW_WORDS, WINDOW_LENGTHS = 1 << 20, 12
#: Rows of a plan, one for each source and length, up to which it is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 50_000
#: Parts that a source's documents of one length are dealt to where the plan is shuffled.
SALTS = 16
#: Documents of one source and length that are ranked together.
RANKED_TOGETHER = 4096


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(source_key, source_size, target) from rows (source_key, source, size); one row per source.

    Sources in code point order, null last, take ``weights`` in turn and split ``share`` of all words by weight. A
    target stops at ``max_epochs`` times its source's size; the excess goes to the others by weight until none is
    above. That fixed point is least(cap, level * weight) for one common level. With the sources ordered by
    cap / weight, the capped ones are a prefix, and the level follows from running sums.
    """
    by_source = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % F.lit(len(weights))
    ranked = (
        by_source.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = W.partitionBy()
    so_far = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "budget_left": F.sum(F.col("source_size").cast("double")).over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)),
        }
    )
    uncapped = F.col("budget_left") * F.col("weight") <= F.col("cap") * F.col("weight_left")
    first = F.min(F.when(uncapped, F.struct("ratio", "source_key", "budget_left", "weight_left"))).over(everything)
    ranked = ranked.withColumn("first", first)
    level = F.col("first.budget_left") * F.col("weight") / F.col("first.weight_left")
    return ranked.select(
        "source_key", "source_size", F.least(F.col("cap"), F.coalesce(level, F.col("cap"))).alias("target")
    )


def _spread(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, left: float, window: int) -> float:
    """Adds single documents, evenly spread over the lengths, until at most ``window`` words are left; gives what is."""
    order = np.argsort(-lengths, kind="stable")
    while left > window:
        # one document of each length that has some left, or of as many as make up the share of their words that is wanted
        single = order[take[order] < counts[order]]
        of_all, wanted = int(lengths[single].sum()), left - window // 2
        chosen, passed, taken = [], 0, 0
        for i in single.tolist():
            length = int(lengths[i])
            passed += length
            if of_all <= wanted or (2 * taken + length) * of_all <= 2 * passed * wanted:
                chosen.append(i)
                taken += length
        take[chosen] += 1
        left -= taken
    return left


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float, window: int | None = None) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be.

    ``lengths`` are distinct and positive, ``counts`` bound the answer. A bounded subset sum, solved exactly: dynamic
    programming over attainable sums, kept as the bits of a number, each length's count split into powers of two. Of
    sums equally near the lesser one is taken. It ends as soon as no sum can be nearer.

    The programme covers ``window`` words, by default ``WINDOW_WORDS`` and at least ``WINDOW_LENGTHS`` times the longest
    length, at a few bytes a word. Of a larger budget only what passes the window is given away before, as a
    proportional share of every length and single documents evenly spread over them; all others are free to choose from.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    longest, unit = int(lengths.max()), int(np.gcd.reduce(lengths))
    window = max(window or WINDOW_WORDS, WINDOW_LENGTHS * longest)
    # integer arithmetic: counts * budget may pass 2**63
    beyond = max(0, int(budget) - window)
    take[:] = [int(c) * beyond // total for c in counts]
    left = _spread(lengths, counts, take, budget - int((lengths * take).sum()), window)

    # sums in units of what divides all lengths; a document more than needed is never nearer than a longest length above
    below, size = int(left // unit), int(left // unit) + longest // unit + 1
    nearest = min((abs(left - k * unit), k) for k in (below, below + 1))[1]
    came, whole, reached = np.full(size, -1, dtype=np.int32), (1 << size) - 1, 1
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, many = int(lengths[i]) // unit, 1
        spare = min(int(counts[i] - take[i]), size // length)
        while spare > 0 and not reached >> nearest & 1:
            some = min(many, spare)
            fresh = (reached << some * length) & whole & ~reached
            if fresh:
                words = np.frombuffer(fresh.to_bytes(-(-size // 64) * 8, "little"), dtype="<u8")
                at = np.flatnonzero(words)
                bit = np.unpackbits(words[at].view(np.uint8), bitorder="little").reshape(len(at), 64)
                row, column = np.nonzero(bit)
                came[at[row] * 64 + column] = len(parts)
                parts.append((int(i), some))
                reached |= fresh
            spare, many = spare - some, many * 2
    found = np.flatnonzero(came >= 0)
    found = np.concatenate([[0], found[found > 0]])
    at = int(found[np.argmin(np.abs(left - found * float(unit)))])
    while at:
        i, some = parts[came[at]]
        take[i] += some
        at -= some * (int(lengths[i]) // unit)
    return take


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target (its source's) and taken, in words.

    Every source takes floor(target / source_size) whole passes over its documents, and for the budget that remains a
    subset of them, fitted by :func:`fit_budget` to its counts of documents by exact length. Within a length the
    documents with the least seeded hash of their id are taken, so reruns agree. A document is taken at most
    ``max_epochs`` times; taken / size says how often.

    Only (id, source, size) leaves the first scan. Counts by source and length are aggregated before they are
    shuffled, and a source's fit sees at most one row per distinct length. The plan goes to all tasks only after its
    rows were counted (``BROADCAST_ROWS``); a longer one is joined by shuffles, each length dealt to ``SALTS`` parts. A source and length with many documents is
    cut into ranges of the hash, so no ranking sees more than about ``RANKED_TOGETHER`` documents.

    Null text has size 0 and taken 0. Null sources are one source, the last. Rows that repeat an id count as separate
    documents; those of the same size are interchangeable. An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("source_key"),
            count_words(F.col(text_col)).alias("size"),
        ).withColumn("rank_hash", F.xxhash64(F.lit(seed), F.col("id"))),
        "sizes",
    )
    targets = source_targets(sizes, weights, share, max_epochs)
    lengths = sizes.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        size, n = group["size"].to_numpy(), group["n"].to_numpy()
        source_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = int(target // source_size) if source_size else 0
        extra = np.zeros(len(group), dtype=np.int64)
        some = size > 0
        extra[some] = fit_budget(size[some], n[some], target - passes * source_size)
        return group.assign(passes=passes, extra=extra)

    plan = materialize(
        lengths.join(targets, "source_key")
        .groupBy("source_key")
        .applyInPandas(
            fit,
            "source_key string, size long, n long, source_size long, target double, passes long, extra long",
        ),
        "mix-plan",
    )
    # the plan, one row per source and length, is broadcast only while it is short; else hot lengths are dealt to parts
    on, left, right = ["source_key", "size"], sizes, plan
    if plan.count() <= BROADCAST_ROWS:
        right = F.broadcast(plan)
    else:
        left = sizes.withColumn("part", F.pmod("rank_hash", F.lit(SALTS)).cast("int"))
        right = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        on = [*on, "part"]
    ranges = F.ceil(F.col("n") / F.lit(RANKED_TOGETHER))
    # the hash as a share of its whole range, so ranges follow the hash's order
    place = F.col("rank_hash").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    placed = left.join(right, on).withColumn(
        "range", F.least(F.floor(place * ranges), ranges - 1).cast("long")
    )
    key = ["source_key", "size", "range"]
    partly = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    per_range = placed.where(partly).groupBy(*key, "extra").agg(F.count(F.lit(1)).alias("here"))
    before = F.coalesce(
        F.sum("here").over(W.partitionBy("source_key", "size").orderBy("range").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0),
    )
    quota = per_range.select(*key, F.greatest(F.col("extra") - before, F.lit(0)).alias("quota"))
    ranked = placed.where(partly).withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("rank_hash", "id")))
    chosen = ranked.join(quota.hint("merge"), key).withColumn("once_more", (F.col("nth") <= F.col("quota")).cast("long"))
    whole = placed.where(~partly).withColumn("once_more", (F.col("extra") > 0).cast("long"))
    columns = ["id", "size", "source_size", "target", "passes", "once_more"]
    return (
        chosen.select(*columns)
        .unionByName(whole.select(*columns))
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("passes") + F.col("once_more"))).alias("taken"),
        )
    )
