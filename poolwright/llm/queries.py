"""The registered queries of this subpackage, and the SQL that says what they should return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .itemsets import basket_rules
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pii import FOUND, KINDS, find_pii
from .quality_classifier import fit, score_documents
from .quality_rules import quality_report
from .runtime import words
from .secrets import ALLOWED, HEX_BITS, MIXED_BITS, WINDOW, WORD_BITS, find_secrets, most_weight, weight
from .secrets import BASE as SECRET_KINDS
from .secrets import FOUND as ENTROPY
from .sentencepiece_codec import encode_documents
from .word_runs import word_runs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_documents(spark, sf_dir))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    total = sum((F.col(f"n_{kind}") for kind in KINDS), F.lit(0).cast("long"))
    counts = [f"n_{kind}" for kind in KINDS if kind != FOUND]
    return found.select("doc_id", *counts, digest, "spans", f"n_{FOUND}", total.alias("n_spans"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of conversations is an event, a whole message; a message is a row, even if it repeats another."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        probe.alias("text"),
    )
    events = rows.unionByName(extra).select(
        "conv_id",
        F.monotonically_increasing_id().alias("message_id"),
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )
    back = read_back(format_conversations(events))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(turns).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with a null flag was not returned, and counts."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("NOT flag <=> 'returned'")
    found = basket_rules(lines, "sale_id", "item_id")
    listed = F.transform("rules", lambda r: F.concat_ws(":", *[r[k].cast("string") for k in ("item", "rest_support", "item_support")]))
    # the least support of the rest, then the least item
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["rest_support"].alias("a"), r["item"].alias("c"))))
    return found.select(
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"),
        F.size("items").cast("long").alias("n_items"),
        "support",
        F.size("rules").cast("long").alias("n_rules"),
        best["c"].alias("best_item"),
        F.sha2(F.array_join(listed, ";").cast("binary"), 256).alias("rules_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_documents(spark, sf_dir))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    kinds = F.array(*[F.lit(k) for k in (*SECRET_KINDS, ENTROPY)])
    order = lambda x: F.array_position(kinds, x["kind"]).cast("int")
    both = F.array_sort(
        F.concat("base", "found"),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order(a) - order(b)),
    )
    count = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [*(count("base", kind) for kind in SECRET_KINDS), count("found", ENTROPY)]
    digest = F.sha2(listed(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts[:-1], digest.alias("base_sha256"), listed(both).alias("spans"), counts[-1])


def _with_repeats(docs: DataFrame) -> DataFrame:
    """The texts of the run query: of every tenth document by hash, the words from some place on repeat periodically.

    h is the CRC-32 of the decimal doc_id, g = floor(h / 10). If h % 10 = 0, each word i >= a = g % n of the n words
    becomes word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). A null id has no hash and no such text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(F.col("h") / 10)
    n = F.size("w")
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    placed = chosen.withColumns({"n": n, "a": F.when(n > 0, g % n).cast("int"), "parts": (3 + g % 8).cast("int")})
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("parts"))).cast("int"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform("w", lambda _, i: F.get("w", at(i))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(_with_repeats(_documents(spark, sf_dir)))
    # the longest run, then the least start, then the least period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        digest(F.array_join(listed, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_format": op7_chat_format,
    "op8_source_mixing": op8_source_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_basket_itemsets": op11_basket_itemsets,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
l AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
b AS (
  SELECT doc_id, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_capitals,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM l),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, i + k AS at FROM r, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
s AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
         OR 100 * n_capitals > 40 * word_chars OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM f
"""

OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256 FROM documents),
g AS (
  SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text,
      '([<\[])(\\*)(\|(?:im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS\])', '\1\\\2\3', 'g')) AS body,
    length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
      '([<\[])(\\*)(\|(?:im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS\])', '\1\\\2\3', 'g')) AS head
  FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       sum(12 + head + 1 + body + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, n, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, n, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
        FROM (SELECT doc_id, row_number() OVER () AS n, string_split(coalesce(text, ''), chr(10)) AS lines
              FROM documents))),
o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key),
k AS (SELECT l.*, owner IS NULL OR owner = doc_id AS stays FROM l LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM k GROUP BY doc_id, n
"""

#: Without possessive quantifiers, which mean the same here, and with letters of either case spelled out.
_SQL_SECRETS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{32,}",
    "entropy": "[A-Za-z0-9+/_=-]{20,}",
}
_QUOTED = {k: v.replace("'", "''") for k, v in _SQL_SECRETS.items()}
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(f"SELECT n, {i} AS kind, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {2 if k == 'assign' else 0}) AS vals FROM d WHERE regexp_matches(text, '{p}')" for i, (k, p) in enumerate(_QUOTED.items()))}),
m AS (
  SELECT n, kind, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS s,
         ms[i] AS m, vals[i] AS v
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f)),
b AS (SELECT n, kind, s, s + length(m) AS e FROM m WHERE (kind = 0 AND length(v) >= 8) OR (kind = 1 AND length(m) >= 16) OR kind = 2),
c AS (
  SELECT n, s, m FROM m WHERE kind = 3 AND NOT regexp_matches(m, '^[0-9a-f]{{32,}}$|^AKIA[A-Z0-9]{{12,}}$')
    AND {" AND ".join(f"NOT regexp_matches(m, '{p}')" for p in ALLOWED)}),
w AS (SELECT n, s AS p, k, string_split(m[k + 1:k + {WINDOW}], '') AS l FROM (SELECT *, unnest(range(0, length(m) - {WINDOW - 1})) AS k FROM c)),
h AS (
  SELECT n, p, k, list_sum(list_transform(list_distinct(l), lambda x: {[weight(c) for c in range(WINDOW + 1)]}[len(list_filter(l, lambda y: y = x)) + 1])) AS weight,
         len(list_filter(l, lambda x: x BETWEEN '0' AND '9')) AS digits, len(list_filter(l, lambda x: regexp_matches(x, '[A-Fa-f]'))) AS hexes,
         len(list_filter(l, lambda x: regexp_matches(x, '[G-Zg-z]'))) AS letters
  FROM w),
o AS (
  SELECT n, p, k, coalesce(k - lag(k) OVER (PARTITION BY n, p ORDER BY k) > {WINDOW}, true) AS opens FROM h
  WHERE weight <= CASE WHEN hexes + letters = 0 THEN -1 WHEN digits = 0 THEN {most_weight(WORD_BITS)}
    WHEN digits + hexes = {WINDOW} THEN {most_weight(HEX_BITS)} ELSE {most_weight(MIXED_BITS)} END),
r AS (
  SELECT n, 3 AS kind, p + min(k) AS s, p + max(k) + {WINDOW} AS e
  FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY n, p ORDER BY k) AS g FROM o) GROUP BY n, p, g),
a AS (SELECT * FROM b UNION ALL SELECT * FROM r WHERE e - s - coalesce((SELECT sum(least(b.e, r.e) - greatest(b.s, r.s)) FROM b WHERE b.n = r.n AND b.s < r.e AND b.e > r.s), 0) >= {WINDOW}),
t AS (
  SELECT n, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         count(*) FILTER (WHERE kind = 3) AS n_entropy, string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS x FROM a) GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN t USING (n)
"""

OP11_SQL = """
WITH RECURSIVE l AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
b AS (SELECT count(DISTINCT sale_id) AS B, greatest(12, (count(DISTINCT sale_id) + 9999) // 10000) AS least FROM l),
f AS (SELECT item_id, count(*) AS s FROM l GROUP BY item_id HAVING count(*) >= (SELECT least FROM b)),
k AS (SELECT sale_id, item_id, s FROM l JOIN f USING (item_id)),
g AS (
  SELECT sale_id, [item_id] AS items, item_id AS last, s AS n FROM k
  UNION ALL
  SELECT sale_id, items, last, n FROM (
    SELECT g.sale_id, list_append(g.items, k.item_id) AS items, k.item_id AS last, count(*) OVER (PARTITION BY list_append(g.items, k.item_id)) AS n
    FROM g JOIN k ON k.sale_id = g.sale_id AND k.item_id > g.last)
  WHERE n >= (SELECT least FROM b)),
q AS (SELECT items, any_value(n) AS n FROM g GROUP BY items),
o AS (SELECT items, n, c, list_filter(items, lambda x: x <> c) AS rest FROM (SELECT items, n, unnest(items) AS c FROM q)),
m AS (SELECT rest, max(n) AS most FROM o GROUP BY rest),
x AS (SELECT q.items, q.n FROM q LEFT JOIN m ON m.rest = q.items WHERE most IS NULL OR most < q.n),
r AS (
  SELECT o.items, o.c, a.n AS a, f.s FROM o JOIN x USING (items) JOIN q AS a ON a.items = o.rest JOIN f ON f.item_id = o.c
  WHERE 100 * o.n >= 30 * a.n AND o.n * (SELECT B FROM b) > a.n * f.s),
t AS (SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS rules FROM r GROUP BY items)
SELECT array_to_string(x.items, ',') AS items, len(x.items) AS n_items, n AS support, coalesce(n_rules, 0) AS n_rules, best_item,
       sha256(coalesce(rules, '')) AS rules_sha256
FROM x LEFT JOIN t USING (items)
"""

ORACLE_SQL = {"op11_basket_itemsets": OP11_SQL, "op12_secret_scan": OP12_SQL, "op3_quality_rules": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op7_chat_format": OP7_SQL, "op9_line_dedup": OP9_SQL}
