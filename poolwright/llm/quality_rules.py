"""Quality rules as a short-circuit cascade whose order is learned from a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, words

#: Rows, on average, of the sample that costs and selectivities are estimated on, and its seed. They decide the order of
#: the rules, and so the time, but never a verdict.
SAMPLE_ROWS, SAMPLE_SEED = 500, 11
#: Nanoseconds that a feature takes a code point, as :func:`measured_costs` had them, and a feature that isn't listed;
#: nanoseconds that a rule itself takes a text. As they are written down, a cold session orders rules as a warm one does.
COSTS = {"word_chars": 12.0, "n_symbols": 32.0, "n_capitals": 28.0, "n_dup_lines": 14.0, "n_repeat_words": 300.0}
UNKNOWN_COST, RULE_COST = 64.0, 50.0

SYMBOLS = "[#*$%&|<>]"
A_WORD = r"[^\x20\x09-\x0D]"

_TEXT, _WORDS, _PACKED, _ALIKE, _PLACES = "__qr_text", "__qr_words", "__qr_packed", "__qr_alike", "__qr_places"


def _place_bits(n_words: Column) -> Column:
    return F.length(F.bin(n_words))


def _packed_windows(n_words: Column) -> Column:
    """Each 3-word window's hash in the high bits, its position in the low ones, sorted: equal windows are neighbours."""
    bits = _place_bits(n_words)
    w = F.col(_WORDS)
    window = lambda i: F.call_function(
        "shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits
    ).bitwiseOR(i.cast("long"))
    return F.when(
        n_words >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), (n_words - 3).cast("int")), window))
    ).otherwise(F.array().cast("array<long>"))


def _hash(packed: Column, n_words: Column) -> Column:
    return F.call_function("shiftright", packed, _place_bits(n_words))


def _alike(n_words: Column) -> Column:
    """Of the packed windows those that share their hash with a neighbour, and so with any other."""
    packed = F.col(_PACKED)
    alike = lambda x, i: _hash(x, n_words) == _hash(F.get(packed, i), n_words)
    return F.filter(packed, lambda x, i: alike(x, i - 1) | alike(x, i + 1))


def _repeated_places(n_words: Column) -> Column:
    """Positions of the windows that occur twice or more. Windows of one hash are compared word by word.

    Where two different ones have one hash, the windows themselves are sorted instead.
    """
    w, alike = F.col(_WORDS), F.col(_ALIKE)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), _place_bits(n_words)) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")

    def differ(x: Column, y: Column) -> Column:
        words_equal = F.lit(True)
        for k in range(3):
            words_equal = words_equal & (F.get(w, place(x) + k) == F.get(w, place(y) + k))
        return (_hash(x, n_words) == _hash(y, n_words)) & ~words_equal

    following = F.slice(alike, 2, F.greatest(F.size(alike), F.lit(1)))
    clash = F.exists(F.zip_with(alike, following, differ), lambda x: x)
    windows = F.sort_array(
        F.transform(alike, lambda x: F.struct(*[F.get(w, place(x) + k).alias(f"w{k}") for k in range(3)], place(x).alias("at")))
    )
    one = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    exact = F.filter(windows, lambda x, i: one(x, F.get(windows, i - 1)) | one(x, F.get(windows, i + 1)))
    return F.sort_array(
        F.when(clash, F.transform(exact, lambda x: x["at"].cast("long"))).otherwise(
            F.transform(alike, lambda x: x.bitwiseAND(mask))
        )
    )


def _covered() -> Column:
    """Words covered by windows of three that start at the given positions."""
    places = F.col(_PLACES)
    following = F.slice(places, 2, F.greatest(F.size(places), F.lit(1)))
    gains = F.zip_with(places, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("long"))
    return F.aggregate(gains, F.lit(0).cast("long"), lambda total, x: total + x)


def _lines() -> Column:
    return F.filter(F.split(F.col(_TEXT), "\n"), lambda line: line.rlike(A_WORD))


#: What rules look at: for each name the columns to add in order. Each is native and of one text.
FEATURES: dict[str, list[tuple[str, Callable[[], Column]]]] = {
    "n_words": [("n_words", lambda: F.size(_WORDS).cast("long"))],
    "word_chars": [("word_chars", lambda: F.length(F.array_join(_WORDS, "")).cast("long"))],
    "n_symbols": [
        ("n_symbols", lambda: (F.length(_TEXT) - F.length(F.regexp_replace(_TEXT, SYMBOLS, ""))).cast("long"))
    ],
    "n_capitals": [
        ("n_capitals", lambda: (F.length(_TEXT) - F.length(F.regexp_replace(_TEXT, r"\p{Lu}", ""))).cast("long"))
    ],
    "n_dup_lines": [
        ("__qr_lines", _lines),
        ("n_lines", lambda: F.size("__qr_lines").cast("long")),
        ("n_dup_lines", lambda: (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long")),
    ],
    "n_repeat_words": [
        (_PACKED, lambda: _packed_windows(F.col("n_words"))),
        (_ALIKE, lambda: _alike(F.col("n_words"))),
        (_PLACES, lambda: _repeated_places(F.col("n_words"))),
        ("n_repeat_words", _covered),
    ],
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which ``rejects`` holds; null counts as false. ``needs`` names features, n_words aside."""

    name: str
    rejects: Callable[[], Column]
    needs: tuple[str, ...] = ()


BASE_RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeats", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("n_repeat_words",)),
)
METHOD_RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"), ("n_symbols",)),
    Rule("same_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"), ("n_dup_lines",)),
    Rule("capitals", lambda: 100 * F.col("n_capitals") > 40 * F.col("word_chars"), ("n_capitals", "word_chars")),
    Rule(
        "word_length",
        lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words")),
        ("word_chars",),
    ),
)


def prepared(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """id, text, words and n_words under names of our own; with ``carry`` the whole row as a struct beside them."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__qr_row")] if carry else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("__qr_id"), text.alias(_TEXT), *rest)
        .withColumn(_WORDS, words(F.col(_TEXT)))
        .withColumn("n_words", F.size(_WORDS).cast("long"))
    )


def add_features(df: DataFrame, names: Sequence[str], alive: Column | None = None) -> DataFrame:
    """Add what of the named features is missing, computed only where ``alive`` holds, null elsewhere."""
    for name in names:
        for column, make in FEATURES[name]:
            if column not in df.columns:
                df = df.withColumn(column, make() if alive is None else F.when(alive, make()))
    return df


def cascade(df: DataFrame, rules: Sequence[Rule], alive: Column | None = None) -> DataFrame:
    """Add __qr_alive: no rule rejects the text. A rule and its features are evaluated only where all before passed."""
    df = df.withColumn("__qr_alive", F.lit(True) if alive is None else alive)
    for rule in rules:
        df = add_features(df, rule.needs, F.col("__qr_alive"))
        df = df.withColumn("__qr_alive", F.col("__qr_alive") & ~F.coalesce(rule.rejects(), F.lit(False)))
    return df


def measured_costs(
    docs: DataFrame, names: Sequence[str] = tuple(FEATURES), text_col: str = "text", repeats: int = 3
) -> dict[str, float]:
    """Nanoseconds of one core that each feature takes a code point: what :data:`COSTS` was written down from.

    The table is written once as one partition, so it should be a small one. A feature's time is the least of some jobs
    that compute it, less that of jobs that only read the rows.
    """
    rows = prepared(docs.select(text_col).repartition(1), text_col, text_col).drop("__qr_id")
    rows = materialize(rows, "quality-costs")
    chars = rows.agg(F.sum(F.length(_TEXT))).first()[0] or 1

    def least(name: str | None) -> float:
        df = rows if name is None else add_features(rows, [name])
        reads = (F.octet_length(_TEXT) < 0) | (F.size(_WORDS) < -1)
        job = df.agg(F.count_if(reads if name is None else reads | (F.col(name) < 0)))
        job.first()
        took = []
        for _ in range(repeats):
            began = time.monotonic()
            job.first()
            took.append(time.monotonic() - began)
        return min(took)

    idle = least(None)
    return {name: max(least(name) - idle, 0.0) * 1e9 / chars for name in names}


def learn_order(
    docs: DataFrame,
    rules: Sequence[Rule],
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    have: Sequence[str] = (),
    costs: Mapping[str, float] = COSTS,
) -> list[Rule]:
    """The rules by rejections per cost, best first, both estimated on a sample of about ``sample_rows`` rows.

    Every row of every partition is as likely to be sampled, whatever its length. One job counts the sampled texts, their
    code points and each rule's rejections. A rule costs ``RULE_COST`` a text and, for each of its features that ``have``
    doesn't name, the feature's cost a code point; so the order depends on rules, costs and rows, not on how warm or busy
    a session is. A rule that rejects nothing there goes last, the cheaper the sooner; rules of equal rank go by name. An
    empty sample leaves the rules as they are.
    """
    n = docs.count() if sample_rows else 0
    if not n or not rules:
        return list(rules)
    texts = docs.select(text_col).sample(min(1.0, sample_rows / n), SAMPLE_SEED)
    df = add_features(prepared(texts, text_col, text_col), [name for rule in rules for name in rule.needs])
    rejected = [F.count_if(F.coalesce(rule.rejects(), F.lit(False))) for rule in rules]
    rows, chars, *counts = df.agg(F.count(F.lit(1)), F.sum(F.length(_TEXT)), *rejected).first()
    if not rows:
        return list(rules)
    score = {}
    for rule, count in zip(rules, counts):
        unit = sum(costs.get(name, UNKNOWN_COST) for name in {*rule.needs} - {*have})
        cost = RULE_COST * rows + unit * chars
        score[rule.name] = (-count / cost, cost, rule.name)
    return sorted(rules, key=lambda rule: score[rule.name])


def _held_up(verdict: Column) -> Column:
    """The verdict, such that no filter is pushed below the projection that has it.

    The optimiser would put what the verdict is made of into the filter, features into one another as often as they are
    used. A column that it takes for non-deterministic, here one that is always true, holds filters up.
    """
    return verdict & (F.spark_partition_id() >= 0)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict for every document.

    Result: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept
    boolean. base_failed says that a base rule rejects; kept that neither a base rule nor the cascade of the other
    rules does. The base statistics are wanted for every row; what the cascade needs beyond them is computed only for
    rows still in it. Every step is an expression on one row: no shuffle.

    Null and empty texts have no words and fail. Rows that repeat are judged alike. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    wanted = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = learn_order(docs, METHOD_RULES, text_col, have=wanted)
    df = add_features(prepared(docs, id_col, text_col), wanted)
    base_failed = F.lit(False)
    for rule in BASE_RULES:
        base_failed = base_failed | rule.rejects()
    df = cascade(df.withColumn("base_failed", base_failed), order, ~F.col("base_failed"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select(F.col("__qr_id").alias(id_col), *stats, _held_up(F.col("__qr_alive")).alias("kept"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    Base and other rules are one cascade in learned order, and each computes its features only for rows still in it.
    Nulls, empty texts, repeated rows and empty tables as in :func:`quality_report`.
    """
    order = learn_order(docs, [*BASE_RULES, *METHOD_RULES], text_col)
    df = cascade(prepared(docs, id_col, text_col, carry=True), order)
    verdict = _held_up(F.col("__qr_alive")).alias("__qr_kept")
    return df.select("__qr_row", verdict).where("__qr_kept").select("__qr_row.*")
