"""Quality rules, exact dedup, line dedup, mixing, personal data and the classifier on small tables, against brute force."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwright.llm import mixing, pii, quality_classifier, quality_rules
from poolwright.llm.exact_dedup import exact_dedup
from poolwright.llm.line_dedup import dedup_lines
from poolwright.llm.runtime import count_words

SCHEMA = "doc_id long, text string, source string, n_lines int, uid string, id string, label string"
PROSE = " ".join(f"word{i} of text" for i in range(30))
TEXTS = [
    PROSE, PROSE.upper(), PROSE, None, "", " \n \n", "a b c a b c a b c", "one\ntwo words here\none\ntwo words here",
    "Shared LINE of text\nother", "  shared line of text\t\nfirst only here", "short\nshort", "#" * 300,
    "mail a.b@c.de or _x@y.org, call +1 (456) 555-2186", "ip 1.2.3.4.5 and 999.1.1.1 and 007.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "x" * 5000, "é" * 20 + "\n" + "É" * 20, PROSE + " " + "very long " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["s1", None, "s0"][i % 3], 1, "u", "i", "l") for i, t in enumerate(TEXTS)]
    rows += [(None, PROSE, "s1", 1, "u", "i", "l"), rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_counted_without_lists(spark):
    texts = [*TEXTS, " ", "\t a\x0b\x0cb\r\n", "x", " x", "x ", "a\xa0b c\u3000d\x1ce"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(count_words(F.col("text"))).collect()] == [len(words(t)) for t in texts]


def statistics(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(docs):
    rows = quality_rules.quality_report(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        want = statistics(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert {r["doc_id"] for r in rows if r["kept"]} == {None, 0, 2}  # 1 is all capitals


def test_quality_filter_agrees(docs, empty):
    kept = Counter(r["doc_id"] for r in quality_rules.quality_report(docs).where("kept").collect())
    out = quality_rules.quality_filter(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == kept
    assert quality_rules.quality_filter(empty).count() == 0 == quality_rules.quality_report(empty).count()


def test_order_follows_rejections_per_cost(docs):
    rules = quality_rules.METHOD_RULES
    learned = quality_rules.learn_order(docs, rules)
    assert sorted(r.name for r in learned) == sorted(r.name for r in rules)
    assert learned[0].name != "same_lines"


def test_costly_rules_that_reject_little_go_last(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, 400)) + " #" * int(300 * (i % 2)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    costly = lambda: F.aggregate("__qr_words", F.lit(0).cast("long"), lambda n, w: n + F.length(F.sha2(w, 512)))
    monkeypatch.setitem(quality_rules.FEATURES, "costly", [("costly", costly)])
    rare = lambda: (F.col("costly") > 0) & (F.col("__qr_words")[0] == "w7")
    rules = [
        quality_rules.Rule("costly", rare, ("costly",)),
        quality_rules.Rule("never", lambda: F.col("n_words") < 0),
        quality_rules.Rule("symbols", lambda: F.col("n_symbols") > 100, ("n_symbols",)),
        quality_rules.Rule("many_words", lambda: F.col("n_words") > 500),
    ]
    orders = [[r.name for r in quality_rules.learn_order(docs, rules)] for _ in range(2)]
    assert orders[0] == orders[1] and orders[0][0] == "many_words" and orders[0][1] == "symbols"
    assert len(quality_rules.learn_order(docs, rules, sample_rows=0)) == 4


def test_order_is_that_of_the_counts(spark, docs):
    rules = [*quality_rules.BASE_RULES, *quality_rules.METHOD_RULES]
    rejects = {rule.name: 0 for rule in rules}
    chars = 0
    frame = quality_rules.add_features(
        quality_rules.prepared(docs, "doc_id", "text"), [name for rule in rules for name in rule.needs]
    )
    for row in frame.select("__qr_text", *[F.coalesce(rule.rejects(), F.lit(False)).alias(rule.name) for rule in rules]).collect():
        chars += len(row["__qr_text"])
        for rule in rules:
            rejects[rule.name] += row[rule.name]
    rows = docs.count()
    costs = {"n_symbols": 3.0, "n_repeat_words": 0.5}
    unit = {rule.name: sum(costs.get(name, 64.0) for name in set(rule.needs) - {"word_chars"}) for rule in rules}
    cost = {name: 50.0 * rows + x * chars for name, x in unit.items()}
    want = sorted(rejects, key=lambda name: (-rejects[name] / cost[name], cost[name], name))
    learned = quality_rules.learn_order(docs, rules, sample_rows=10**6, have=["word_chars"], costs=costs)
    assert [rule.name for rule in learned] == want
    measured = quality_rules.measured_costs(docs, ["n_symbols", "n_dup_lines"], repeats=1)
    assert set(measured) == {"n_symbols", "n_dup_lines"} and min(measured.values()) >= 0


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *words: F.length(words[0]).cast("long"))
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["a", "b", "cc", "dd"], int(rng.integers(0, 40)))) for _ in range(60)]
    df = quality_rules.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    for r in quality_rules.add_features(df, ["n_repeat_words"]).collect():
        assert r["n_repeat_words"] == statistics(texts[r["__qr_id"]])[4]


def test_the_verdict_holds_filters_up(docs):
    held = quality_rules.quality_report(docs).where("kept")
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if line.strip(" +-:").startswith("Filter")]
    assert filters and all("xxhash64" not in line and "array_distinct" not in line for line in filters)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_dedup(docs, empty, support):
    rows = exact_dedup(docs, support=support).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[low(r["text"])].append(r["doc_id"])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), i == keep, sha) for i in ids)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    assert got == want
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup(docs, empty, batches):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    rows = docs.collect()
    ids = [r["doc_id"] if r["doc_id"] is not None else 1 << 62 for r in rows]
    owner = {}
    for i, r in sorted(zip(ids, rows), key=lambda x: x[0]):
        for line in (r["text"] or "").split("\n"):
            owner.setdefault(key(line), i)
    want = Counter()
    for i, r in zip(ids, rows):
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        want[r["doc_id"], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    out = dedup_lines(docs, batches=batches)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == want
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    assert dedup_lines(empty).count() == 0


def test_line_runs_leave_nothing_in_the_catalog(spark, docs):
    assert dedup_lines(docs, batches=5).count() == docs.count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def attainable(lengths, counts):
    sums = {0}
    for length, n in zip(lengths.tolist(), counts.tolist()):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return sums


def check_fit(lengths, counts, budget, **options):
    take = mixing.fit_budget(lengths, counts, budget, **options)
    assert ((0 <= take) & (take <= counts)).all()
    return int((lengths * take).sum())


def test_fit_budget_is_as_near_as_can_be():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(1, 7))
        lengths = np.sort(rng.choice(np.arange(1, 60), n, replace=False))
        counts = rng.integers(1, 5, n)
        budget = float(rng.integers(0, 2 * (lengths * counts).sum() + 6)) / 2
        best = min(abs(s - budget) for s in attainable(lengths, counts))
        assert abs(check_fit(lengths, counts, budget) - budget) == best
    for lengths, counts, budget, want in (([1, 52], [3, 1], 53, 53), ([10, 58], [3, 1], 76, 78), ([31, 52], [3, 1], 55, 52), ([40], [2], 72.5, 80), ([3], [10**6], 10**6, 999999)):
        assert check_fit(np.array(lengths), np.array(counts), budget) == want


def test_fit_budget_of_few_long_documents():
    rng = np.random.default_rng(6)
    for _ in range(40):
        lengths = np.unique(rng.integers(60_000, 300_000, int(rng.integers(1, 11))))
        ones, budget = np.ones(len(lengths), int), float(rng.integers(1, lengths.sum()))
        best = min(abs(s - budget) for s in attainable(lengths, ones))
        assert abs(check_fit(lengths, ones, budget) - budget) == best


def test_fit_budget_of_many_lengths():
    """Beyond the window too: with many documents to choose from a budget is met."""
    rng = np.random.default_rng(7)
    for n, longest, most in ((400, 5000, 1), (900, 2000, 3), (50, 60, 200)):
        lengths = rng.choice(np.arange(1, longest), n, replace=False)
        counts = rng.integers(1, most + 1, n)
        for share in (0.001, 0.2, 0.5, 0.9):
            budget = int((lengths * counts).sum() * share)
            assert check_fit(lengths, counts, budget) == check_fit(lengths, counts, budget, window=1) == budget


def test_fit_budget_takes_no_time():
    even, odd_budget = np.arange(2, 40_002, 2), 200_000_001
    begun = time.process_time()
    assert abs(check_fit(even, np.ones(len(even), int), odd_budget) - odd_budget) == 1
    lengths = np.random.default_rng(1).choice(np.arange(500_000, 1_000_000), 2000, replace=False)
    assert abs(check_fit(lengths, np.ones(2000, int), 7.3e8) - 7.3e8) <= 1
    assert time.process_time() - begun < 5


def test_long_plans_are_shuffled(spark, docs, monkeypatch):
    want = Counter(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    out = mixing.mix_sources(docs)
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString().replace("BroadcastHint", "")
    assert Counter(map(tuple, out.collect())) == want


def test_mixing(spark, empty):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("w" * int(rng.integers(1, 40))), [None, "a", "b", "é", "B"][int(rng.integers(5)) if i % 3 else 1]) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "z"), (None, "one two", "b"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # reshare what is above, until nothing is
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / total for s in order}
        above = {s for s in order if target[s] > 2 * sizes[s]} - capped
        if not above:
            break
        capped |= above
    source_of = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(0 <= target[s] - taken[s] < 1.5 for s in order)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_ranges_split_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_TOGETHER", 10)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    out = mixing.mix_sources(docs, weights=(1, 3))
    taken = out.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(0 <= r["target"] - r["t"] < 3 for r in taken)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii_base(spark, docs, empty):
    rng = np.random.default_rng(3)
    pieces = ["a", "@", ".", "b.c", "12", "4111111111111111", "+1", " ", "-", "_", "(2)", "255", "\n", "é", "x@y.z", "1.2.3.4", "5555 5555 5555 4444"]
    rows = [(i, "".join(rng.choice(pieces, 25))) for i in range(300)]
    random = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (docs, random):
        texts = dict(table.select("doc_id", "text").collect())
        got = pii.find_pii(table).collect()
        assert len(got) == table.count()
        for r in got:
            want = base_spans(texts[r["doc_id"]] or "")
            assert r["base_spans"] == want
            assert [r[f"n_{k}"] for k in BASE] == [len(re.findall(rf"{k}:", want)) for k in BASE]
            assert set(filter(None, want.split(","))) <= set(filter(None, r["spans"].split(",")))
    assert pii.find_pii(empty).count() == 0


def test_pii_bootstraps_from_contexts(spark):
    rows = [(i, f"write to user{i}@mail.org today please {i} times") for i in range(8)]
    rows += [(100, "write to KX-553120-Q today please"), (101, "version 2.0.14-beta3 of it"), (102, "write to nobody today")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "identifier:9:20"
    assert got[101]["spans"] == "" == got[102]["spans"] and got[3]["n_identifier"] == 0


def test_pii_finds_what_no_seed_looks_like(spark):
    """Values of password= are seeds; what is found has another length, another lead and other words before it."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeioustn"), 5))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n - 2)) + "a1"
    rows = [(i, f"{word()} password={hexes(18)} {word()} {word()}") for i in range(20)]
    rows += [(100 + i, f'{word()} token = "{hexes(40)}" {word()} {word()}') for i in range(20)]
    rows += [(200 + i, f'a {word()} {hexes(24)} {word()} a') for i in range(10)]  # by form alone: not found
    rows += [(300 + i, f"order no {rng.integers(10**9, 10**10)} {word()}") for i in range(20)]  # a pure context, no seed's form
    rows += [(400, 'id = "04c0ffee04c0ffee04c0" and name = "04c0ffee04c0ffee04c1" x')]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "identifier:15:33" for i in range(20))
    assert all(got[100 + i] == "identifier:15:55" for i in range(20))
    assert not any(got[i] for i, _ in rows if 200 <= i < 400)
    assert got[400] == "identifier:6:26,identifier:40:60"  # both by their lead and the words before


def brute_form(text):
    alphabets = (("digits", "0-9"), ("hex", "0-9a-f"), ("lower", "0-9a-z"), ("upper", "0-9A-Z"), ("mixed", "0-9A-Za-z"))
    name = next((name for name, chars in alphabets if re.fullmatch(f"[{chars}]+", text)), "marks")
    return ("form", name, len(text)), ("form", name, "long" if len(text) >= pii.LONG_FORM else "short")


def brute_identifiers(texts, rounds):
    """Of each text the (start, end) of its identifiers, by the definitions, on dictionaries."""
    blank = re.compile(r"[ \t-\r]+")
    normal = lambda word: re.sub("[0-9]", "0", word.lower())
    patterns = BASE | {"identifier": r"(?<![^ \t-\r])[^ \t-\r0-9]*[0-9][^ \t-\r]*"}
    places, edges, seeds, total = [], Counter(), set(), Counter()
    for text in texts:
        words_here = [normal(w) for w in blank.split(text) if w]
        for i in range(len(words_here)):
            for n in (1, 2, 3):
                if i >= n:
                    total["L", tuple(words_here[i - n : i][::-1])] += 1
                if i + n < len(words_here):
                    total["R", tuple(words_here[i + 1 : i + 1 + n])] += 1
        base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s]
        valid = set(filter(None, base_spans(text).split(",")))
        here = []
        for kind, pattern in patterns.items():
            found = list(re.finditer(pattern, text))
            ends = [0] + [m.end() for m in found]
            starts = [m.start() for m in found] + [len(text)]
            for k, m in enumerate(found):
                start, end, entity = m.start(), m.end(), m[0]
                if kind == "identifier":
                    if any(a < end and start < b for a, b in base):
                        continue
                    opened = max((i + 1 for i in range(len(entity) - 1) if entity[i] in "=:\"'<([{|" and re.match("[A-Za-z0-9]", entity[i + 1])), default=0)
                    at = opened + re.search("[A-Za-z0-9]", entity[opened:]).start()
                    lead, entity, start = entity[:at], re.sub("[^A-Za-z0-9]+$", "", entity[at:]), start + at
                    end = start + len(entity)
                    if len(re.sub("[^A-Za-z0-9]", "", entity)) < 6 or not re.search("[0-9]", entity):
                        continue
                    here.append((start, end, entity.lower()))
                elif f"{kind}:{start}:{end}" not in valid:
                    continue
                whole = kind == "identifier"  # contexts of base entities end at the one beside them
                left = [normal(w) for w in blank.split(text[0 if whole else ends[k] : m.start()])[:-1] if w][::-1]
                right = [normal(w) for w in blank.split(text[m.end() : len(text) if whole else starts[k + 1]])[1:] if w]
                seed = not whole or lead.lower() in ("password=", "pwd:")
                own = ([("lead", normal(lead))] if lead else []) + list(brute_form(entity)) if whole else []
                for pattern_of in own:
                    edges[pattern_of, entity.lower(), seed] += 1
                for side, near in (("L", left), ("R", right)):
                    for n in range(1, 4):
                        if len(near) >= n:
                            edges[(side, tuple(near[:n])), entity.lower(), seed] += 1
        places.append(here)
    of = defaultdict(list)
    for (pattern, entity, seed), n in edges.items():
        of[pattern].append((entity, seed, n))
    of = {p: e for p, e in of.items() if len(e) >= pii.MIN_SEEDS}
    for p, e in of.items():
        total[p] = max(total[p], sum(n for *_, n in e))
    of = {p: e for p, e in of.items() if sum(n for *_, n in e) >= pii.MIN_WEIGHT * (total[p] + 1)}
    place = {p: (p[0], p[1][0]) if p[0] in "LR" else p if p[0] == "lead" else "form" for p in of}
    shows, weight = defaultdict(set), {}
    for p, e in of.items():
        for entity, _, _ in e:
            shows[entity].add(p)

    def confidence(entity, but=None):
        left_open = 1.0
        for side in ("L", "R", "lead", "form"):
            told = [weight.get(p, 0) for p in shows[entity] if p[0] == side and place[p] != but]
            left_open *= 1 - max(told, default=0) * (0.5 if side == "form" else 1)
        return 1 - left_open

    for turn in range(rounds):
        new = {}
        for p, e in of.items():
            least = pii.CONFIDENT if p[0] == "form" else 0
            said = [(1 if seed else confidence(entity, place[p]) if turn else 0, n) for entity, seed, n in e]
            w = sum(n * c for c, n in said if c >= least) / (total[p] + 1)
            if sum(c for c, _ in said if c >= least) >= pii.MIN_SEEDS and w >= pii.MIN_WEIGHT:
                new[p] = w
        weight = new
    return [[(a, b) for a, b, entity in here if confidence(entity) >= pii.CONFIDENT] for here in places]


def contextual_texts(seed):
    rng = np.random.default_rng(seed)
    filler = ["of", "the", "a", "red", "on", "in", "was", "number", "2024", "v3.1.4-rc77"]
    some = lambda n: " ".join(rng.choice(filler, n))
    texts = []
    for i in range(90):
        entity = [f"u{i}@mail.org", f"10.0.{i}.7", f"KX-{i % 9}53120-q", f"password={i:08x}ab"][i % 4]
        where = ["owner id", "id", "the"][int(rng.integers(3))]
        texts.append(f"{some(4)} {where} {entity} {some(3)}")
        if i % 4 == 2:  # found by what base entities share with them, and found they tell another context
            texts.append(f"{some(2)} ticket: {entity}, {some(5)}")
        if i % 5 == 0:
            texts.append(f"{some(2)} ticket: ZZ{i}99{i}00 {some(3)}")
            texts.append(f'{some(2)} key = "{i:04x}" pin="{i:09x}c" {i:012x}e')
        texts.append(f"{some(3)} the {rng.integers(10**6, 10**7)} {some(2)}")
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_bootstrapping_is_the_graph_scoring(spark, seed, monkeypatch):
    texts = contextual_texts(seed)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_identifiers(texts, pii.ROUNDS)
    if seed:
        monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)
    for r in pii.find_pii(table).collect():
        got = re.findall(r"identifier:(\d+):(\d+)", r["spans"])
        assert [(int(a), int(b)) for a, b in got] == want[r["doc_id"]]
    cut = [texts[i][a:b] for i, spans in enumerate(want) for a, b in spans]
    once = {texts[i][a:b] for i, spans in enumerate(brute_identifiers(texts, 1)) for a, b in spans}
    assert any(x.startswith("KX") for x in once) and any(x.startswith("ZZ") for x in set(cut) - once)
    assert sum(bool(re.fullmatch("[0-9]{7}", x)) for x in cut) <= 4  # of 90


def test_pii_long_texts_and_repeated_entities(spark):
    long = "= 1234567 " * 5000 + "key " + "token " * 3000
    rows = [(i, f"{long} key password={i:040x} {long}") for i in range(4)]
    rows += [(10 + i, f"secret password={'ab12' * 10}") for i in range(300)] + [(400, "7" * 300_000), (401, "a1." * 100_000)]
    rows += [(402, "=" * 300_000 + "1"), (403, '="' * 150_000 + "x"), (404, "=a1" * 100_000)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["n_identifier"] for r in got if r["doc_id"] < 400)


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(f"{rng.choice(list('abcdef'))}{rng.integers(400)} the" for _ in range(80)) + "."
    bad = lambda: " ".join(["spam ### spam"] * int(rng.integers(10, 90)))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    model = quality_classifier.fit(table, labels, train_rows=200)
    out = quality_classifier.score_documents(table, model).toPandas()
    held = out[out.held_out]
    assert len(held) and (held.predicted == (held.doc_id % 4 != 0)).mean() > 0.97
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    odd = quality_classifier.score_documents(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    one_class = quality_classifier.fit(table, labels.where("quality = 1"))
    assert quality_classifier.score_documents(table, one_class).where("predicted = 0").count() == 0
    none = quality_classifier.fit(empty, labels.limit(0))
    assert quality_classifier.score_documents(empty, none).count() == 0


def test_classifier_learns_from_what_texts_are_made_of(spark):
    """Texts of one shape, good or bad by their words alone; against a plain logistic fit on the same differences."""
    rng = np.random.default_rng(5)
    good, bad = [f"{c}{i}" for c in "abc" for i in range(40)], [f"{c}{i}" for c in "xyz" for i in range(40)]
    make = lambda own, other: " ".join(rng.choice(own if rng.random() < 0.6 else other) for _ in range(60))
    rows = [(i, make(good, bad) if i % 2 else make(bad, good)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_classifier.fit(table, labels)
    out = quality_classifier.score_documents(table, model).toPandas().sort_values("doc_id")
    held, y = out.held_out.to_numpy(), out.doc_id.to_numpy() % 2 == 1
    x = np.array([quality_classifier.text_features(t) for _, t in rows])
    z = np.clip((x - x[~held].mean(axis=0)) / np.maximum(x[~held].std(axis=0), 1e-9), -6, 6)
    plain = np.zeros(z.shape[1])
    pairs = np.random.default_rng(6)
    a, b = pairs.choice(np.flatnonzero(~held & y), 4000), pairs.choice(np.flatnonzero(~held & ~y), 4000)
    for _ in range(3000):  # gradient descent
        d = z[a] - z[b]
        plain += 0.05 * ((1 / (1 + np.exp(d @ plain))) @ d / len(d) - quality_classifier.RIDGE * plain)
    strength = model._standard(x) @ model.weights
    def loss(s):  # of held-out pairs
        gap = s[held & y][:, None] - s[held & ~y][None, :]
        return np.log1p(np.exp(-gap)).mean()
    assert loss(strength) < 0.2 and loss(strength) < 1.2 * loss(z @ plain) + 0.02
    assert (out.predicted.to_numpy()[held] == y[held]).mean() > 0.8
