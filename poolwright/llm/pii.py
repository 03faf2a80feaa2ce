"""Personal data: fixed patterns, and identifiers found by bootstrapping from the contexts of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WHITE, dealt_join, materialize

#: What the base kinds look like, in the order in which spans of one start are listed. Possessive and anchored forms of
#: the stated patterns: they match the same, in time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FOUND = "identifier"
KINDS = (*BASE, FOUND)
#: What may turn out to be an identifier: a run of non-space with a digit in it.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: What stands before a seed within its word: the value of an assignment to one of these names is a seed, like the base
#: entities. No form of an identifier is a seed.
SEED_LEAD = r"(?i)(?:^|[^a-z0-9])(?:password|passwd|pwd)[\"']?[=:][\"']?$"
#: A candidate's lead, up to its last opening mark or just the marks before it, and what is left without the marks after it.
PARTS = r"(?s)^(.*[=:\"'<(\[{|](?=[A-Za-z0-9])|[^A-Za-z0-9]*+)(.*[A-Za-z0-9])"
#: Sides that a pattern may stand on: words before, words after, the lead within the word, and the form of the string.
SIDES = ("L", "R", "lead", "form")
#: Words that a pattern has at most.
PATTERN_WORDS = 3
ROUNDS = 6
#: How far a form is believed: less than ``CONFIDENT``, so that no string is found by its form alone.
FORM_TRUST = 0.5
#: Characters from which strings of one alphabet are alike, whatever their length.
LONG_FORM = 16
#: Confidences of different entities that a pattern needs in sum, confidence below which it says nothing, and confidence from which an
#: identifier is taken.
MIN_SEEDS = 3
MIN_WEIGHT = 0.1
CONFIDENT = 0.7
#: Patterns up to which their keys, of 8 bytes, are broadcast to the scan that counts them.
BROADCAST_PATTERNS = 1 << 20
#: Letters and digits that an identifier has at least.
MIN_IDENTIFIER_CHARS = 6


def _split(text: Column) -> Column:
    return F.split(text, WHITE, -1)


def _matches(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """All leftmost matches of a pattern, in order: (kind, nth, gap, match, left, right).

    The text between matches comes from splitting by the same pattern, so gaps and matches together are the text.
    ``left`` and ``right`` are the words before and after the match's own, up to ``PATTERN_WORDS``, the nearest first.
    """
    number = F.lit(KINDS.index(kind))
    # what touches the match belongs to its own word
    said = lambda x: F.filter(x, lambda w: w != "")
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), _split(p).alias("words")))
    ends = F.transform(
        gaps,
        lambda p: F.struct(
            p["n"].alias("n"),
            F.slice(F.reverse(said(F.slice(p["words"], 1, F.size(p["words"]) - 1))), 1, PATTERN_WORDS).alias("last"),
            F.slice(said(F.slice(p["words"], 2, F.size(p["words"]))), 1, PATTERN_WORDS).alias("first"),
        ),
    )
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(
        F.transform(found, lambda m, i: F.struct(i.alias("nth"), m.alias("match"))),
        F.transform(F.arrays_zip(ends.alias("a"), F.slice(ends, 2, F.size(ends)).alias("b")), lambda x: x),
        lambda m, x: F.struct(
            number.alias("kind"),
            m["nth"].alias("nth"),
            x["a"]["n"].alias("gap"),
            m["match"].alias("match"),
            x["a"]["last"].alias("left"),
            x["b"]["first"].alias("right"),
        ),
    )
    rows = F.filter(rows, lambda x: x["match"].isNotNull())  # one gap more than matches
    empty = "array<struct<kind:int,nth:int,gap:int,match:string,left:array<string>,right:array<string>>>"
    return F.when(guard, rows).otherwise(F.array()).cast(empty)


def _valid() -> Column:
    """Whether a match of a base kind is one: address parts to 255, 12 to 19 digits with a check digit, 9 to 15."""
    match, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == KINDS.index("ip"), match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == KINDS.index("card"), n.between(12, 19) & F.call_function("luhn_check", digits))
        .when(kind == KINDS.index("phone"), n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _occurrences(found: DataFrame) -> DataFrame:
    """(uid, kind, start, end, match, left, right); offsets are running sums over a document's gaps and matches.

    Candidates are whole words, so their contexts go on over the candidates beside them.
    """
    rows = found.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    in_order = Window.partitionBy("uid", "kind").orderBy("nth")
    length = F.length("match")
    end = F.sum(F.col("gap") + length).over(in_order.rowsBetween(Window.unboundedPreceding, 0))

    def beyond(side: str, step: int) -> Column:
        none = F.array().cast("array<string>")
        more = [F.col(side)]
        for n in range(1, PATTERN_WORDS + 1):  # each candidate on the way is a word itself
            word = F.lag("match", n * step).over(in_order)
            more += [F.array_compact(F.array(word)), F.coalesce(F.lag(side, n * step).over(in_order), none)]
        return F.when(F.col("kind") == KINDS.index(FOUND), F.slice(F.concat(*more), 1, PATTERN_WORDS)).otherwise(F.col(side))

    rows = rows.withColumns({"end": end, "before": beyond("left", 1), "after": beyond("right", -1)})
    return rows.select(
        "uid", "kind", (F.col("end") - length).alias("start"), "end", "match",
        F.col("before").alias("left"), F.col("after").alias("right"),
    )


def _apart_from_base(spans: DataFrame) -> DataFrame:
    """Candidates that no base span overlaps. One pass over a document's spans by start, no pairs."""
    base = F.col("kind") < KINDS.index(FOUND)
    by_start = Window.partitionBy("uid").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    marked = spans.withColumns({"before": before, "after": after})
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return marked.where(base | free).drop("before", "after")


def _trimmed(spans: DataFrame) -> DataFrame:
    """Candidates without their lead, which becomes a column, and the marks after them; too short ones go."""
    parts = {"lead": F.regexp_extract("match", PARTS, 1), "core": F.regexp_extract("match", PARTS, 2)}
    return (
        spans.withColumns(parts)
        .where(F.col("core").rlike("[0-9]") & (F.length(F.regexp_replace("core", "[^A-Za-z0-9]", "")) >= MIN_IDENTIFIER_CHARS))
        .withColumn("start", F.col("start") + F.length("lead"))
        .withColumns({"match": F.col("core"), "end": F.col("start") + F.length("core")})
        .drop("core")
    )


def _normal(text: Column) -> Column:
    """What patterns are made of: lower case, digits alike."""
    return F.translate(F.lower(text), "123456789", "000000000")


def _keys(mark: str, near: list[Column]) -> list[Column]:
    """The keys of the patterns of one side: of the nearest word, the two nearest and so on. Null where words are missing.

    Words come as their hashes, the nearest first.
    """
    return [F.when(near[n].isNotNull(), F.xxhash64(F.lit(mark), *near[: n + 1])) for n in range(PATTERN_WORDS)]


def _forms(instance: Column) -> list[Column]:
    """The forms of a string, from special to general: its alphabet with its length, and with whether it is long."""
    alphabet = (
        F.when(instance.rlike("^[0-9]+$"), F.lit("digits"))
        .when(instance.rlike("^[0-9a-f]+$"), F.lit("hex"))
        .when(instance.rlike("^[0-9a-z]+$"), F.lit("lower"))
        .when(instance.rlike("^[0-9A-Z]+$"), F.lit("upper"))
        .when(instance.rlike("^[0-9A-Za-z]+$"), F.lit("mixed"))
        .otherwise(F.lit("marks"))
    )
    length = F.length(instance)
    return [F.xxhash64(F.lit("form"), alphabet, length), F.xxhash64(F.lit("long form"), alphabet, length >= LONG_FORM)]


def _edges(spans: DataFrame) -> DataFrame:
    """(pattern, side, place, instance, seed, n): the edges of the pattern-instance graph, and how often each occurs.

    Patterns of one place are those with the same nearest word, the same lead, or all forms.
    """
    instance = F.lower("match")
    candidate = F.col("kind") == KINDS.index(FOUND)
    seed = ~candidate | F.col("lead").rlike(SEED_LEAD)
    none = F.array().cast("array<bigint>")

    def words_of(mark: str, words: str) -> Column:
        near = [F.get(F.transform(words, lambda w: F.xxhash64(_normal(w))), F.lit(i)) for i in range(PATTERN_WORDS)]
        return F.array_compact(F.array(*_keys(mark, near)))

    # base entities were told by their own form and check, so they say nothing of the forms and leads of candidates
    lead = F.when(candidate & (F.col("lead") != ""), F.array(F.xxhash64(F.lit("lead"), _normal("lead")))).otherwise(none)
    forms = F.when(candidate, F.array(*_forms(F.col("match")))).otherwise(none)
    keys = (words_of("L", "left"), words_of("R", "right"), lead, forms)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), k.alias("keys")) for i, k in enumerate(keys)])
    place = F.when(F.col("by.side") == SIDES.index("form"), F.lit(0).cast("long")).otherwise(F.get("by.keys", F.lit(0)))
    return (
        spans.select(F.explode(sides).alias("by"), instance.alias("instance"), seed.alias("seed"))
        .select(F.explode("by.keys").alias("pattern"), "by.side", place.alias("place"), "instance", "seed")
        .groupBy("pattern", "side", "place", "instance", "seed")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _totals(texts: DataFrame, patterns: DataFrame, broadcast: bool) -> DataFrame:
    """(pattern, total): how many words of all texts stand in a pattern's context.

    The patterns go to the tasks if they are few; otherwise the contexts of all words are counted, each once, and joined.
    Either way what is shuffled was aggregated before, so a frequent context is a row a task.
    """
    hashes = F.transform(
        F.array_remove(F.split(_normal(F.coalesce("text", F.lit(""))), WHITE), ""), lambda w: F.xxhash64(w)
    )

    def around(word: Column, i: Column) -> Column:
        left = [F.get("hashes", i - n) for n in range(1, PATTERN_WORDS + 1)]
        right = [F.get("hashes", i + n) for n in range(1, PATTERN_WORDS + 1)]
        return F.array(*_keys("L", left), *_keys("R", right))

    keys = texts.select(hashes.alias("hashes")).select(F.flatten(F.transform("hashes", around)).alias("keys"))
    # an outer explode, as a plain one makes the optimiser filter by the array's size, below both projections
    keys = keys.select(F.explode_outer("keys").alias("pattern")).where(F.col("pattern").isNotNull())
    if broadcast:
        keys = keys.join(F.broadcast(patterns.select("pattern")), "pattern", "left_semi")
    counted = keys.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    return counted if broadcast else counted.join(patterns.select("pattern").hint("merge"), "pattern", "left_semi")


def _best(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(instance, w0, p0, s0, w1, ...): for each side the best weight, its place, and the best of any other place."""
    by_place = dealt_join(edges.select("pattern", "side", "place", "instance"), weights, "pattern", F.col("instance"))
    by_place = by_place.groupBy("instance", "side", "place").agg(F.max("weight").alias("w"))
    rank = F.row_number().over(Window.partitionBy("instance", "side").orderBy(F.desc("w"), "place"))
    top = by_place.withColumn("rank", rank).where("rank <= 2").groupBy("instance")
    columns = []
    for i in range(len(SIDES)):
        first, second = (F.col("side") == i) & (F.col("rank") == 1), (F.col("side") == i) & (F.col("rank") == 2)
        columns += [F.max(F.when(first, F.col("w"))).alias(f"w{i}"), F.max(F.when(first, F.col("place"))).alias(f"p{i}")]
        columns.append(F.max(F.when(second, F.col("w"))).alias(f"s{i}"))
    return top.agg(*columns)


def _confidence(besides: bool = False) -> Column:
    """What the best patterns say together; ``besides`` leaves those of the row's own side and place out."""
    left_open = F.lit(1.0)
    for i, side in enumerate(SIDES):
        w = F.col(f"w{i}")
        if besides:
            own = (F.col("side") == i) & (F.col("place") == F.col(f"p{i}"))
            w = F.when(own, F.col(f"s{i}")).otherwise(w)
        left_open = left_open * (1 - (FORM_TRUST if side == "form" else 1.0) * F.coalesce(w, F.lit(0.0)))
    return 1 - left_open


def discover(spans: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance) of the candidates whose contexts say that they are identifiers.

    ``spans`` has base entities and candidates with the words around them and the candidates' leads, ``texts`` all texts
    in a column text. A pattern is the one to ``PATTERN_WORDS`` words on one side, the lead within the word, or a form
    (:func:`_forms`). Base entities and candidates after a ``SEED_LEAD`` are the seeds, with confidence 1; base entities
    have no lead and no form. In every round

    - a pattern's weight is the sum of its entities' confidences, each as often as it occurs there, over the number of
      all words that occur there (for leads and forms: of all candidates) plus one; none if the confidences of its
      different entities sum to less than ``MIN_SEEDS``, or if it is below ``MIN_WEIGHT``. For a form only the
      ``CONFIDENT`` count, or strings would vouch for each other by looking alike;
    - a candidate's confidence is that of its best patterns of the four sides together: 1 less the product of what each
      leaves open, where a form is believed by ``FORM_TRUST`` only;
    - a pattern hears of a candidate what patterns of other places say, so none is its own witness.

    So what looks like a seed lends some confidence to the contexts that it is found in, and contexts that only such
    strings stand in become sure of them. Words that precede anything say little, as their weight is measured against all
    that they precede.

    Edges are aggregated to distinct ones; patterns that can't reach ``MIN_WEIGHT`` go before the rounds. Joins deal
    the edges of a frequent pattern, or of a frequent string, to several parts.
    """
    edges = materialize(_edges(spans), "pii-edges")
    shown = edges.groupBy("pattern", "side").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("n_all"))
    shown = materialize(shown.where(F.col("entities") >= MIN_SEEDS), "pii-shown")
    around = shown.where(F.col("side") < SIDES.index("lead"))
    totals = _totals(texts, around, around.count() <= BROADCAST_PATTERNS)
    total = F.greatest(F.coalesce("total", "n_all"), F.col("n_all"))
    patterns = shown.join(totals.hint("merge"), "pattern", "left").select("pattern", "n_all", total.alias("total"))
    patterns = materialize(patterns.where(F.col("n_all") >= MIN_WEIGHT * (F.col("total") + 1)), "pii-patterns")
    edges = materialize(dealt_join(edges, patterns.drop("n_all"), "pattern", F.col("instance")), "pii-graph")
    seeds = edges.where("seed").groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"), F.sum("n").alias("of_seeds"))
    told = patterns.select("pattern", "total").join(seeds, "pattern", "left").fillna(0, ["seeds", "of_seeds"])
    told = materialize(told, "pii-told")
    found = None
    for _ in range(rounds):
        if found is None:
            now = told.withColumns({"more": F.lit(0.0), "others": F.lit(0.0)})
        else:
            new = dealt_join(edges.where("NOT seed"), found, "instance", F.col("pattern"))
            new = new.withColumn("confidence", _confidence(besides=True))
            new = new.where((F.col("side") < SIDES.index("form")) | (F.col("confidence") >= CONFIDENT))
            sums = new.groupBy("pattern").agg(
                F.sum(F.col("n") * F.col("confidence")).alias("more"), F.sum("confidence").alias("others")
            )
            now = told.join(sums, "pattern", "left").fillna(0, ["more", "others"])
        weight = (F.col("of_seeds") + F.col("more")) / (F.col("total") + 1)
        weights = now.where(F.col("seeds") + F.col("others") >= MIN_SEEDS).select("pattern", weight.alias("weight"))
        weights = weights.where(F.col("weight") >= MIN_WEIGHT)
        found = materialize(_best(edges, weights), "pii-round")
    return found.where(_confidence() >= CONFIDENT).select("instance")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_email, n_ip, n_card, n_phone (long), base_spans, spans, n_identifier.

    Spans are listed as kind:start:end, joined by commas, by start and then kind; offsets count code points, the end is
    exclusive. base_spans has the spans of the four base kinds, spans also the identifiers that bootstrapping adds; those
    never touch a base span.

    One scan finds what matches in each text, with the words around it; only that goes on. Offsets are running sums
    within a document. Bootstrapping (:func:`discover`) looks at distinct (context, string) pairs, and scans the texts once
    more to count what else stands in those contexts.

    Null and empty texts have no spans. Rows that repeat an id are separate documents. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = text.rlike("[0-9]")
    guards = {
        "email": F.contains(text, F.lit("@")),
        "ip": digits & F.contains(text, F.lit(".")),
        "card": digits,
        "phone": F.contains(text, F.lit("+")),
    }
    parts = [_matches(text, kind, pattern, guards[kind]) for kind, pattern in BASE.items()]
    parts.append(_matches(text, FOUND, CANDIDATE, digits))
    found = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
            F.monotonically_increasing_id().alias("uid"), "id", F.concat(*parts).alias("found")
        ),
        "pii-found",
    )
    spans = materialize(_apart_from_base(_occurrences(found).where(_valid())), "pii-spans")
    base = spans.where(F.col("kind") < KINDS.index(FOUND))
    candidates = _trimmed(spans.where(F.col("kind") == KINDS.index(FOUND)))
    identifiers = discover(base.withColumn("lead", F.lit("")).unionByName(candidates), docs.select(F.col(text_col).alias("text")))
    added = dealt_join(candidates.withColumn("instance", F.lower("match")), identifiers, "instance", F.col("uid"), "left_semi")
    columns = ["uid", "start", "kind", "end"]
    listed = base.select(*columns).unionByName(added.select(*columns))
    names = F.array(*[F.lit(kind) for kind in KINDS])
    shown = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start"), F.col("end"))
    listed = listed.withColumn("span", F.struct("start", "kind", "end", shown.alias("shown")))
    of_doc = listed.groupBy("uid").agg(
        F.sort_array(F.collect_list("span")).alias("list"),
        *[F.count_if(F.col("kind") == i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
    )
    joined = found.select("uid", "id").join(of_doc, "uid", "left")
    text_of = lambda spans: F.coalesce(F.array_join(F.transform(spans, lambda s: s["shown"]), ","), F.lit(""))
    return joined.select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        text_of(F.filter("list", lambda s: s["kind"] < KINDS.index(FOUND))).alias("base_spans"),
        text_of(F.col("list")).alias("spans"),
    )
