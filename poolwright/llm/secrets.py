"""Secrets in texts: fixed patterns, and strings whose sliding windows have a high entropy for their characters."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in the order in which spans of one start are listed. The least length stands in a pattern where a
#: shorter match could only be dropped; a match of "assign" stays if its value has ``VALUE_CHARS``.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"[0-9a-f]{32,}+",
}
VALUE_CHARS = 8
FOUND = "entropy"
KINDS = (*BASE, FOUND)

#: Characters that a window has.
WINDOW = 20
#: Characters of a candidate, by class; a window is of the class that its characters say.
DIGITS, HEX_LETTERS, LETTERS, MARKS = "0123456789", "abcdefABCDEF", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "+/_=-"
ALPHABET = DIGITS + HEX_LETTERS + LETTERS + MARKS
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Bits a character from which a window is hot: of digits and hexadecimal letters; without a digit, as words are; others.
#: A window without a letter is a number and never hot.
HEX_BITS, WORD_BITS, MIXED_BITS = 3.0, 4.1, 3.7
#: Candidates that are no secrets: UUIDs, placeholders, and rows of the alphabet or the keyboard.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|[Cc]hange_?[Mm]e|[Yy]our[_-]|[Xx]{4}",
    r"abcdefgh|ABCDEFGH|01234567|12345678|qwertyui|QWERTYUI",
)
#: Candidates that a base kind has in any case.
OF_BASE = r"^[0-9a-f]{32,}$|^AKIA[A-Z0-9]{12,}$"
#: Windows that are scored in one go; a longer candidate is taken in pieces, so that a step never handles a long list.
PIECE = 1024

#: Counts stand side by side in numbers: so many in each, of so many bits.
_PER_NUMBER, _BITS = 12, 5
_NUMBERS = -(-len(ALPHABET) // _PER_NUMBER)


def weight(count: int) -> int:
    """1000 * count * log2(count): a window's entropy is log2(WINDOW) less the sum of these over 1000 * WINDOW."""
    return round(1000 * count * math.log2(count)) if count else 0


#: What one character more adds to the sum of weights, by its count before.
STEPS = tuple(weight(c + 1) - weight(c) for c in range(WINDOW))


def most_weight(bits: float) -> int:
    """The sum of weights up to which a window has so many bits a character."""
    return math.floor(1000 * WINDOW * (math.log2(WINDOW) - bits))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Spans (start, kind, end, text) of the leftmost matches of a pattern, in order; offsets in code points.

    The text between matches comes from splitting by the same pattern, so gaps and matches together are the text.
    """
    number = KINDS.index(kind)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == "assign" else 0))
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        value,
        lambda m, v: F.struct(m.alias("text"), (F.length(v) >= VALUE_CHARS).alias("keep")),
    )
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    rows = F.filter(F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"))), lambda x: x["m"].isNotNull())
    none = F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"]["text"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["m"]["text"].alias("text"))
        return F.struct(
            end.alias("at"), F.when(x["m"]["keep"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans")
        )

    spans = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _hot(piece: Column) -> Column:
    """Stretches (s, e) of a string that its hot windows cover, joined where they touch.

    The counts of a window's characters are those of the window before, one less for the character that left and one
    more for the one that came; so is the sum of weights. Nothing is counted anew.
    """
    number = lambda c: F.call_function("div", c, F.lit(_PER_NUMBER)).cast("int")
    shift = lambda c: (c % _PER_NUMBER) * _BITS
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    steps = F.array(*[F.lit(s) for s in STEPS])
    code = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    below = [len(DIGITS), len(DIGITS + HEX_LETTERS), len(DIGITS + HEX_LETTERS + LETTERS), len(ALPHABET)]
    sort = lambda c: F.when(c < below[0], 0).when(c < below[1], 1).when(c < below[2], 2).otherwise(3)
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), _NUMBERS).alias("counts"),
        F.lit(0).alias("weight"),
        F.array_repeat(F.lit(0), 4).alias("sorts"),
        F.lit(None).cast("struct<s:int,e:int>").alias("open"),
        none.alias("done"),
    )

    def count(state: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(state["counts"], number(c)), shift(c)).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")

    def turn(state: Column, x: Column) -> Column:
        came, left = x["came"], x["left"]
        same = (came == F.coalesce(left, F.lit(-1))).cast("int")
        gone = F.when(left.isNotNull(), F.get(steps, count(state, left) - 1)).otherwise(0)
        weight = state["weight"] - gone + F.get(steps, count(state, came) - same)
        counts = F.transform(
            state["counts"],
            lambda v, k: v
            + F.when(k == number(came), one(came)).otherwise(F.lit(0).cast("long"))
            - F.when(k == number(left), one(left)).otherwise(F.lit(0).cast("long")),
        )
        sorts = F.transform(state["sorts"], lambda v, k: v + (k == sort(came)).cast("int") - (left.isNotNull() & (k == sort(left))).cast("int"))
        return _let(F.struct(counts.alias("counts"), weight.alias("weight"), sorts.alias("sorts")), lambda now: judge(state, now, x["i"]))

    def judge(state: Column, now: Column, i: Column) -> Column:
        digits, hexes, letters, marks = (now["sorts"][k] for k in range(4))
        most = (
            F.when(hexes + letters == 0, -1)
            .when(digits == 0, most_weight(WORD_BITS))
            .when(letters + marks == 0, most_weight(HEX_BITS))
            .otherwise(most_weight(MIXED_BITS))
        )
        hot = (i >= WINDOW - 1) & (now["weight"] <= most)
        begin, end, open_ = i - (WINDOW - 1), i + 1, state["open"]
        touches = hot & open_.isNotNull() & (open_["e"] >= begin)
        grown = F.struct(F.when(touches, open_["s"]).otherwise(begin).alias("s"), end.alias("e"))
        closes = hot & open_.isNotNull() & ~touches
        return F.struct(
            now["counts"].alias("counts"),
            now["weight"].alias("weight"),
            now["sorts"].alias("sorts"),
            F.when(hot, grown).otherwise(open_).alias("open"),
            F.when(closes, F.concat(state["done"], F.array(open_))).otherwise(state["done"]).alias("done"),
        )

    def walk(codes: Column) -> Column:
        rows = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("came"), F.get(codes, i - WINDOW).alias("left")))
        return F.aggregate(rows, start, turn, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))

    return _let(code, walk)


def _entropy_spans(candidate: Column) -> Column:
    """Spans of one candidate; those of its pieces are joined where they touch."""
    firsts = F.sequence(F.lit(0), F.length(candidate["text"]) - WINDOW, F.lit(PIECE))
    found = F.flatten(
        F.transform(
            firsts,
            lambda at: F.transform(
                _hot(F.substring(candidate["text"], at + 1, F.lit(PIECE + WINDOW - 1))),
                lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e")),
            ),
        )
    )
    none = F.array().cast("array<struct<s:int,e:int>>")

    def join(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["s"].alias("s"), x["e"].alias("e")))
        return F.when((F.size(done) > 0) & (last["e"] >= x["s"]), joined).otherwise(F.array_append(done, x))

    one = F.when(F.size(firsts) > 1, F.aggregate(found, none, join)).otherwise(found)
    return F.transform(
        one,
        lambda x: F.struct(
            (candidate["start"] + x["s"]).alias("start"),
            F.lit(KINDS.index(FOUND)).alias("kind"),
            (candidate["start"] + x["e"]).alias("end"),
            F.substring(candidate["text"], x["s"] + 1, x["e"] - x["s"]).alias("text"),
        ),
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """(id_col, base, found): spans struct<start, kind, end, text> of each whole text; kinds as their names, offsets in code points.

    ``base`` has the matches of the fixed patterns, by start and kind; ``found`` the stretches of high entropy, by start.
    A candidate is a longest string of letters, digits and ``+/_=-`` of ``WINDOW`` or more; its windows of ``WINDOW``
    characters are hot from as many bits as their characters call for (``HEX_BITS``, ``WORD_BITS``, ``MIXED_BITS``),
    and the stretches that hot windows cover are found. Candidates that match one of the patterns ``allowed`` are not, nor
    are stretches of which the base spans, which stand already, leave fewer than ``WINDOW`` characters.

    Null text is empty; ids may be null or repeat, a row in is a row out. An empty table gives an empty result; other
    columns are not read. Nothing is shuffled, and no Python runs.
    """
    base = {}
    text = F.col("__text")
    for kind, pattern in BASE.items():
        base[f"__{kind}"] = _matches(text, kind, pattern)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.select("__id", *[c.alias(k) for k, c in base.items()], _matches(text, FOUND, CANDIDATE).alias("__candidates"))
    rows = rows.select("__id", F.array_sort(F.concat(*base)).alias("__base"), "__candidates")
    no_secret = lambda c: F.greatest(*[c["text"].rlike(p) for p in (OF_BASE, *allowed)])
    candidates = F.filter("__candidates", lambda c: ~no_secret(c))
    found = F.flatten(F.transform(candidates, _entropy_spans))
    shared = lambda x, b: F.greatest(F.lit(0), F.least(x["end"], b["end"]) - F.greatest(x["start"], b["start"]))
    apart = lambda x: x["end"] - x["start"] - F.aggregate("__base", F.lit(0), lambda n, b: n + shared(x, b)) >= WINDOW
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda spans: F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.get(names, x["kind"]).alias("kind"), x["end"].alias("end"), x["text"].alias("text"))
    )
    return rows.select(F.col("__id").alias(id_col), named(F.col("__base")).alias("base"), named(F.filter(found, apart)).alias("found"))
