"""Closed frequent itemsets of baskets by close-by-one, and the association rules that they show."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: Rows times columns of a concept's table up to which one task closes all below it; larger ones grow another level in Spark.
TASK_CELLS = 1 << 21
#: Items of a row, at least, from which its pairs are not listed but looked up among those of the other rows.
LONG_ROW = 32

_DONE = "intent array<long>, support long"


def distinct_baskets(lines: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    """(basket, item), each pair once, written; rows in which either is null are in no basket."""
    pairs = lines.select(F.col(basket_col).alias("basket"), F.col(item_col).alias("item"))
    return materialize(pairs.where("basket IS NOT NULL AND item IS NOT NULL").distinct(), "baskets")


def frequent_items(pairs: DataFrame, min_support: int) -> DataFrame:
    """(item, support, code) of the frequent items, written; codes ascend by support, then item.

    So the rarest item of a set comes first, and the common ones are hardly ever extended.
    """
    counts = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    return materialize(counts.orderBy("support", "item").withColumn("code", F.monotonically_increasing_id()), "items")


def _rows(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(items, weight): the baskets as ascending codes of their frequent items; equal ones are one row."""
    coded = pairs.join(items.select("item", "code"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("items"))
    return coded.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def _long_from(rows: DataFrame, min_support: int) -> tuple[int, int]:
    """Size above which a row is long, and the weight of all long rows, which is below ``min_support``."""
    power = F.greatest(F.lit(LONG_ROW), F.pow(F.lit(2), F.ceil(F.log2(F.size("items")))).cast("int"))
    # one row for each power of two
    sizes = sorted((r["p"], r["w"]) for r in rows.groupBy(power.alias("p")).agg(F.sum("weight").alias("w")).collect())
    above = 0
    while sizes and above + sizes[-1][1] < min_support and sizes[-1][0] > LONG_ROW:
        above += sizes.pop()[1]
    return (sizes[-1][0] if sizes else LONG_ROW), above


def _level(rows: DataFrame, concepts: DataFrame, own: DataFrame | None, min_support: int) -> tuple[DataFrame, DataFrame]:
    """One level of close-by-one below ``concepts``: the new concepts and the rows of those that can be extended.

    ``rows`` (id, items, weight) has for each concept the baskets of its extent without its intent; ``concepts`` has
    (id, intent, last, failed). An item j after ``last`` makes a new concept from the baskets that have j too; its
    intent grows by j and whatever all of them have. If that comes before j, the concept stands elsewhere: the test
    fails, and is passed on with the witnesses that made it fail. Below, j is not tried while one of them is missing.

    Common items are counted by pairs of items in a row. Rows with many items list no pairs. They weigh less than
    ``min_support`` together, so that a pair needs some of the other rows, and only pairs found there are looked up.
    """
    long_size, long_weight = _long_from(rows, min_support)
    missing = lambda x: F.size(F.array_except(x["witness"], F.col("intent"))) > 0
    skip = F.transform(F.filter("failed", missing), lambda x: x["item"])
    rows = rows.join(concepts.select("id", "last", skip.alias("skip")), "id")
    short = rows.where(F.size("items") <= long_size)

    def pairs_of(items: Column, least: int) -> Column:
        after = lambda i, at: F.transform(F.slice(items, at + 1 + least, F.size(items)), lambda j: F.struct(i.alias("a"), j.alias("b")))
        return F.flatten(F.transform(items, after))

    listed = short.select("id", "last", "weight", F.explode(pairs_of(F.col("items"), int(own is not None))).alias("p"))
    listed = listed.where("p.b > last").groupBy("id", "p.a", "p.b").agg(F.sum("weight").alias("n"))
    listed = listed.where(F.col("n") >= min_support - long_weight)
    if own is not None:
        listed = listed.unionByName(own)
    listed = materialize(listed, "pairs")
    both = listed.select("id", F.col("a").alias("i"), F.col("b").alias("j"), "n")
    both = both.unionByName(listed.where("a <> b").select("id", F.col("b").alias("i"), F.col("a").alias("j"), "n"))
    far = rows.where(F.size("items") > long_size).withColumn("row", F.xxhash64("id", "items"))
    members = far.select("id", "row", "weight", "last", F.explode("items").alias("j"))
    looked_up = members.where("j > last").join(both.drop("n"), ["id", "j"]).join(members.select("id", "row", F.col("j").alias("i")), ["id", "row", "i"])
    looked_up = materialize(looked_up.select("id", "row", "weight", "j", "i"), "long-pairs")
    more = looked_up.groupBy("id", "i", "j").agg(F.sum("weight").alias("more"))
    if own is not None:  # whole counts already
        more = more.where("i <> j")
    counted = both.join(more, ["id", "i", "j"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))

    near = counted.where(F.col("n") >= min_support).groupBy("id", "j").agg(
        F.max(F.when(F.col("i") == F.col("j"), F.col("n"))).alias("support"),
        F.collect_list(F.when(F.col("i") != F.col("j"), F.struct("i", "n"))).alias("near"),
    )
    near = near.where("support IS NOT NULL").join(concepts, "id").where("j > last").withColumn("skip", skip)
    near = near.where(~F.array_contains("skip", F.col("j")))
    whole = F.transform(F.filter("near", lambda x: x["n"] == F.col("support")), lambda x: x["i"])
    part = F.transform(F.filter("near", lambda x: x["n"] < F.col("support")), lambda x: x["i"])
    tests = near.withColumns({"whole": whole, "part": F.array_sort(part)})
    tests = tests.withColumn("witness", F.filter("whole", lambda i: i < F.col("j")))
    tests = materialize(tests.select("id", "j", "support", "intent", "failed", "whole", "part", "witness"), "tests")
    failed = tests.where(F.size("witness") > 0).select("id", F.col("j").alias("i"), "witness")
    new = tests.where(F.size("witness") == 0).withColumn("child", F.monotonically_increasing_id())
    new = materialize(new.drop("witness"), "children")

    inherited = new.select("id", "child", F.explode(F.filter("part", lambda i: i > F.col("j"))).alias("i")).join(failed, ["id", "i"])
    inherited = inherited.groupBy("child").agg(F.collect_list(F.struct(F.col("i").alias("item"), "witness")).alias("fresh"))
    grown = new.join(inherited, "child", "left").select(
        F.col("child").alias("id"),
        F.array_sort(F.concat("intent", F.array("j"), "whole")).alias("intent"),
        F.col("j").alias("last"),
        F.concat(F.filter("failed", lambda x: F.array_contains("part", x["item"])), F.coalesce("fresh", F.array().cast("array<struct<item:long,witness:array<long>>>"))).alias("failed"),
        "support",
        F.size("part").alias("columns"),
        F.get("part", F.size("part") - 1).alias("most"),
    )
    grown = materialize(grown, "concepts")

    open_ = new.where(F.get("part", F.size("part") - 1) > F.col("j")).select("id", "j", "child", "part")
    from_short = short.select("id", "items", "weight", F.explode(F.filter("items", lambda j: j > F.col("last"))).alias("j")).join(open_, ["id", "j"])
    from_short = from_short.select("child", F.array_intersect("items", "part").alias("items"), "weight")
    kept = open_.select("id", "j", "child", F.explode("part").alias("i"))
    from_long = looked_up.join(kept, ["id", "j", "i"]).groupBy("child", "row", "weight").agg(F.sort_array(F.collect_list("i")).alias("items"))
    below = from_short.unionByName(from_long.select("child", "items", "weight")).where(F.size("items") > 0)
    below = below.groupBy("child", "items").agg(F.sum("weight").alias("weight"))
    return grown, materialize(below.withColumnRenamed("child", "id"), "extents")


def _close(intent: list[int], last: int, failed: list[dict], rows: list[dict], min_support: int) -> Iterator[tuple[list[int], int]]:
    """All concepts below one, depth first: (intent, support). ``rows``: items and weight of its extent, without its intent."""
    columns = np.unique(np.concatenate([np.asarray(r["items"], np.int64) for r in rows]))
    weight = np.array([r["weight"] for r in rows], np.float64)
    has = np.zeros((len(rows), len(columns)))
    for at, r in enumerate(rows):
        has[at, np.searchsorted(columns, r["items"])] = 1
    place = {int(c): k for k, c in enumerate(columns)}
    outer = set(intent)
    never = -1  # a witness that no concept below can have
    inherited = {
        place[x["item"]]: [place.get(w, never) for w in x["witness"] if w not in outer] for x in failed if x["item"] in place
    }
    todo = [(np.arange(len(rows)), np.zeros(len(columns), bool), int(np.searchsorted(columns, last, "right")) - 1, inherited)]
    while todo:
        extent, inside, y, known = todo.pop()
        table, w = has[extent], weight[extent]
        counts = w @ table
        tried = np.flatnonzero((counts >= min_support) & ~inside)
        tried = [int(j) for j in tried[tried > y] if all(k != never and inside[k] for k in known.get(int(j), ()))]
        if not tried:
            continue
        common = (table[:, tried] * w[:, None]).T @ table  # exact: whole numbers below 2**53
        passed, failures = [], {}
        for j, row in zip(tried, common, strict=True):
            closed = (row == counts[j]) | inside
            early = np.flatnonzero(closed[:j] & ~inside[:j])
            if len(early):
                failures[j] = early.tolist()
            else:
                passed.append((j, closed))
        known = known | failures if failures else known
        for j, closed in passed:
            yield sorted([*intent, *columns[closed].tolist()]), int(counts[j])
            if j + 1 < len(columns):
                todo.append((extent[table[:, j] > 0], closed, j, known))


def _depth(seeds: DataFrame, rows: DataFrame, min_support: int) -> DataFrame:
    """Every concept below the seeds; a seed and its rows, a bounded table, are one row and one task's work."""
    tables = rows.groupBy("id").agg(F.collect_list(F.struct("items", "weight")).alias("rows"))

    def dig(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                seed = batch.slice(at, 1).to_pylist()[0]
                found = list(_close(seed["intent"], seed["last"], seed["failed"], seed["rows"], min_support))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.int64())],
                        names=["intent", "support"],
                    )

    return seeds.join(tables, "id").select("intent", "last", "failed", "rows").mapInArrow(dig, _DONE)


def closed_itemsets(pairs: DataFrame, items: DataFrame, min_support: int, task_cells: int = TASK_CELLS) -> DataFrame:
    """(intent, support) of every closed itemset with at least ``min_support`` baskets; intents are ascending codes.

    ``pairs`` are distinct (basket, item), ``items`` come from :func:`frequent_items`. Fast close-by-one in two phases.
    Breadth: all concepts of a level grow at once by joins and counts, first those of single items. Depth: a concept
    whose table (distinct rows of its extent by items that are frequent with it) is within ``task_cells`` goes to a
    task, which closes everything below it with the failed tests that it inherits; one with a larger table stays in the
    breadth phase for another level. The tables of a level are written to the shared folder, and nothing is capped. The
    driver sees row counts only.
    """
    spark = pairs.sparkSession
    rows = materialize(_rows(pairs, items).withColumn("id", F.lit(-1).cast("long")), "rows")
    none = "cast(array() as array<struct<item:long,witness:array<long>>>)"
    root = spark.range(1).selectExpr("cast(-1 as bigint) AS id", "cast(array() as array<bigint>) AS intent", "cast(-1 as bigint) AS last", f"{none} AS failed")
    root = materialize(root, "root")
    own = items.select(F.lit(-1).cast("long").alias("id"), F.col("code").alias("a"), F.col("code").alias("b"), F.col("support").alias("n"))
    done, concepts = [], root
    while True:
        concepts, rows = _level(rows, concepts, own, min_support)
        own = None
        done.append(concepts.select("intent", "support"))
        open_ = concepts.where(F.col("most") > F.col("last"))
        sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).join(open_.select("id", "columns"), "id")
        large = materialize(sizes.where(F.col("rows") * F.col("columns") > task_cells).select("id"), "large")
        if large.isEmpty():
            done.append(_depth(open_, rows, min_support))
            break
        done.append(_depth(open_.join(large, "id", "left_anti"), rows.join(large, "id", "left_anti"), min_support))
        concepts = open_.join(large, "id", "left_semi").select("id", "intent", "last", "failed")
        rows = rows.join(large, "id", "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(out, "closed")


def supports_of(sets: DataFrame, closed: DataFrame) -> DataFrame:
    """(intent, support) of distinct frequent sets of two or more codes: the largest support of a closed set around each.

    A set that is closed finds itself. For others the closed sets that share their two rarest items are looked through.
    """
    same = sets.join(closed, "intent", "left")
    known, others = same.where("support IS NOT NULL"), same.where("support IS NULL").select("intent")
    pair = lambda c: F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    around = closed.select(F.col("intent").alias("whole"), "support", F.explode(pair(F.col("intent"))).alias("p"))
    found = others.withColumn("p", F.struct(F.get("intent", F.lit(0)).alias("a"), F.get("intent", F.lit(1)).alias("b")))
    found = found.join(around, "p").where(F.size(F.array_except("intent", "whole")) == 0)
    return known.unionByName(found.groupBy("intent").agg(F.max("support").alias("support")))


def basket_rules(
    lines: DataFrame,
    basket_col: str,
    item_col: str,
    min_count: int = 12,
    per_10000: int = 1,
    min_confidence: int = 30,
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """(items, support, rules): each closed itemset with its rules struct<item, rest_support, item_support>.

    A basket is the set of items of one basket key; rows without key or item are left out, repeated ones count once. An
    itemset is frequent with ``min_count`` baskets and ``per_10000`` ten-thousandths of all; it is closed if every
    larger set has fewer. Items are ascending. Taking item c from a set of support s is a rule if 100 * s >=
    ``min_confidence`` * a and s * B > a * (support of c), where a is the support of the rest and B counts all baskets.
    Rules are by item. No lines, or none frequent, give an empty result; other columns are not read.

    Keys and items may be as frequent as they like: pairs are made distinct first, a basket has each frequent item
    once, and of those there are at most mean basket size times 10000 / ``per_10000``, whatever the number of baskets.
    """
    pairs = distinct_baskets(lines, basket_col, item_col)
    total = pairs.select("basket").distinct().count()
    min_support = max(min_count, -(-total * per_10000 // 10_000))
    items = frequent_items(pairs, min_support)
    closed = closed_itemsets(pairs, items, min_support, task_cells)

    members = closed.select("intent", "support", F.explode("intent").alias("code")).join(items.withColumnRenamed("support", "item_support"), "code")
    rest = F.array_remove("intent", F.col("code"))
    members = materialize(members.withColumn("rest", rest), "members")
    single = members.where(F.size("rest") == 1).select("rest").distinct().withColumn("code", F.get("rest", F.lit(0)))
    single = single.join(items, "code").select("rest", F.col("support").alias("a"))
    several = supports_of(members.where(F.size("rest") > 1).select(F.col("rest").alias("intent")).distinct(), closed)
    supports = single.unionByName(several.select(F.col("intent").alias("rest"), F.col("support").alias("a")))
    s, a = F.col("support"), F.col("a")
    is_rule = (100 * s >= min_confidence * a) & (s * F.lit(total).cast("long") > a * F.col("item_support"))
    rule = F.when(is_rule, F.struct("item", F.col("a").alias("rest_support"), "item_support"))
    return members.join(supports, "rest", "left").groupBy("intent", "support").agg(
        F.sort_array(F.collect_list("item")).alias("items"), F.sort_array(F.collect_list(rule)).alias("rules")
    ).select("items", "support", "rules")
