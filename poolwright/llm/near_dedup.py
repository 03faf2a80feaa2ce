"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import WHITE, drop_path, give_back, work_path

SHINGLE = 5
#: Weighted Jaccard similarity, as a fraction, from which two texts are near duplicates.
SIMILAR = (4, 5)
ROWS, BANDS = 5, 28
SEED = 0
#: Weight layers of texts that are signed together, which bounds memory.
SIGNED_TOGETHER = 200_000
#: Rounds in which one member stands for the largest class of a list, before all are paired with it.
REST_STARS = 1
#: Rounds after those, over every so many-th layer by hash, before all are gone through.
REST_PARTS = (32,)
#: Weight layers of texts that verification remembers per task.
REMEMBERED = 4_000_000
#: Ids (of 8 bytes) that may be broadcast, by a count made first, so that only their texts are shuffled. With more,
#: all texts are shuffled.
BROADCAST_IDS = 1_000_000

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(_ODD)
_SPLIT = re.compile(WHITE.replace(r"\x20", " "))


def _step(n: int) -> np.uint64:
    return np.uint64(_ODD * n % 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if w]


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode())
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingle_layers(hashes: np.ndarray) -> np.ndarray:
    """The distinct (shingle, layer) pairs of a text as sorted 64-bit hashes.

    A shingle that occurs w times has weight w: it is the unit layers 1 to w of that shingle. The weighted Jaccard
    similarity of two texts is the plain one of these sets. A text of fewer than five words is one shingle.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = min(SHINGLE, n)
    acc = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        acc = mix64(acc * _MIX + hashes[k : n - width + 1 + k])
    acc.sort()
    starts = np.flatnonzero(np.concatenate(([True], acc[1:] != acc[:-1])))
    layer = np.arange(len(acc)) - np.repeat(starts, np.diff(np.append(starts, len(acc))))
    return np.sort(mix64(acc + _MIX * layer.astype(np.uint64)))


def dart_signatures(texts: list[np.ndarray], k: int, seed: int = SEED) -> np.ndarray:
    """For each text (none empty) and each of ``k`` coordinates, the earliest dart that hits the text's region.

    Darts fall on (element, weight layer) x rank as a Poisson process of unit intensity that depends on the seed alone:
    the ranks of a layer's darts are sums of exponential gaps, drawn from its hash, and each dart's hash also names its
    coordinate. Only darts below a rank limit are thrown, which the text's weight sets so that about k ln k + 2k land;
    most layers of a long text get none. Texts with a coordinate still empty are done again with twice the limit: darts
    below the old limit are the same, so the earliest dart of a coordinate never depends on the limit.
    """
    sizes = np.array([len(x) for x in texts])
    found = np.zeros((len(texts), k), dtype=np.uint64)
    base = mix64(np.concatenate(texts) + _step(2 * seed + 1)) if texts else np.zeros(0, dtype=np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    todo, factor = np.arange(len(texts)), 1.0
    while len(todo):
        limits = factor * (k * np.log(k) + 2 * k) / sizes[todo]
        alive = base if factor == 1 else np.concatenate([base[starts[i] : starts[i + 1]] for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        rank, limit, throw = np.zeros(len(alive)), limits[owner], 0
        slots, ranks, names = [], [], []
        while len(alive):
            throw += 1
            dart = mix64(alive + _step(throw))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            under = np.flatnonzero(rank < limit)
            alive, rank, owner, limit = alive[under], rank[under], owner[under], limit[under]
            name = mix64(dart[under] ^ _MIX)
            slots.append(owner * k + (name % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            names.append(name)
        slot, rank, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        order = np.argsort(-rank)  # the last write to a slot is its earliest dart
        hit, mine = np.zeros(len(todo) * k, dtype=bool), np.zeros(len(todo) * k, dtype=np.uint64)
        mine[slot[order]] = name[order]
        hit[slot] = True
        full = hit.reshape(-1, k).all(axis=1)
        found[todo[full]] = mine.reshape(-1, k)[full]
        todo, factor = todo[~full], factor * 2
    return found


def bands_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """One 64-bit key for each band of each text's signature; no keys for a text without layers."""
    out = [np.zeros(0, dtype=np.uint64)] * len(texts)
    some = [i for i, x in enumerate(texts) if len(x)]
    ends = np.cumsum([len(texts[i]) for i in some])
    cuts = np.searchsorted(ends, np.arange(SIGNED_TOGETHER, (ends[-1] if len(ends) else 0) + 1, SIGNED_TOGETHER))
    for part in np.split(np.array(some, dtype=np.int64), np.unique(cuts)):
        signature = dart_signatures([texts[i] for i in part], ROWS * BANDS).reshape(len(part), BANDS, ROWS)
        key = np.repeat(mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[None, :], len(part), axis=0)
        for r in range(ROWS):
            key = mix64(key * _MIX + signature[:, :, r])
        for i, keys in zip(part, key, strict=True):
            out[i] = keys
    return out


def similar(a: np.ndarray, b: np.ndarray, at_least: tuple[int, int] = SIMILAR) -> bool:
    """Whether two sets of layers have weighted Jaccard similarity of at least the fraction; exact in integers."""
    if not len(a) or not len(b):
        return False
    num, den = at_least
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= (len(a) + len(b) - both) * num


@cache
def _word_hashes() -> WordHashes:
    return WordHashes()


_Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _lent(task: _Task) -> _Task:
    """The task, after which its worker keeps no word hashes and no freed memory: it may idle while others need it."""

    @wraps(task)
    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _word_hashes.cache_clear()
            give_back()

    return lent


def _layers_of(text: str | None) -> np.ndarray:
    return shingle_layers(_word_hashes()(text_words(text or "")))


def _long_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


@_lent
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, id, text and more -> the same, the digest of the words (null without any) and the bands."""
    for batch in batches:
        for part in _slices(batch, 2):
            d1, d2, layers = [], [], []
            for text in part.column(2):  # uid, id and text come first
                words = text_words(text.as_py() or "")
                digest = xxhash.xxh3_128_intdigest(" ".join(words).encode())
                d1.append((digest >> 64) - (1 << 63) if words else None)
                d2.append((digest & ((1 << 64) - 1)) - (1 << 63) if words else None)
                layers.append(shingle_layers(_word_hashes()(words)))
            yield pa.record_batch(
                [*part.columns, pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _long_lists(bands_of(layers))],
                names=[*batch.schema.names, "d1", "d2", "bands"],
            )


def _slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``most`` bytes at most, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().cumsum()
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


@_lent
def _layer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, text -> (uid, layer) for each layer."""
    for batch in batches:
        for i in range(batch.num_rows):
            layers = _layers_of(batch.column(1)[i].as_py())
            uid = np.full(len(layers), batch.column(0)[i].as_py(), dtype=np.int64)
            yield pa.record_batch([pa.array(uid), pa.array(layers.view(np.int64))], names=["uid", "layer"])


@_lent
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, text_x, text_y -> the pairs (x, y) that are similar. Texts met again are seldom taken apart again."""
    known: dict[int, np.ndarray] = {}
    held = 0

    def layers(uid: int, text: pa.StringScalar) -> np.ndarray:
        nonlocal held
        if uid not in known:
            if held > REMEMBERED:
                known.clear()
                held = 0
            known[uid] = _layers_of(text.as_py())
            held += len(known[uid])
        return known[uid]

    for batch in batches:
        x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = []
        for i in range(batch.num_rows):
            one = layers(x[i], batch.column(2)[i])
            if similar(one, layers(y[i], batch.column(3)[i])):
                good.append(i)
        yield pa.record_batch(
            [pa.array([x[i] for i in good], pa.int64()), pa.array([y[i] for i in good], pa.int64())], names=["x", "y"]
        )


class _Tables:
    """Tables of one run in the shared folder; all but those kept are dropped when done."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        path = work_path(self.spark, label)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.setdefault(label, []).append(path)
        return out

    def drop(self, label: str, but_last: bool = False) -> None:
        paths = self.paths.get(label, [])
        for path in paths[:-1] if but_last else paths:
            drop_path(self.spark, path)
        self.paths[label] = paths[-1:] if but_last else []


def _needed(tables: _Tables, ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of some distinct ids: without a shuffle if the ids are few enough to be broadcast."""
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "uid", "left_semi")


def _verify(tables: _Tables, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones among distinct pairs (x, y)."""
    pairs = tables.put(pairs.select("x", "y"), "pairs")
    ids = pairs.select(F.col("x").alias("uid")).unionByName(pairs.select(F.col("y").alias("uid"))).distinct()
    texts = _needed(tables, tables.put(ids, "pair-ids"), texts)
    with_y = pairs.join(texts.select(F.col("uid").alias("y"), F.col("text").alias("text_y")), "y")
    both = with_y.join(texts.select(F.col("uid").alias("x"), F.col("text").alias("text_x")), "x")
    links = tables.put(both.select("x", "y", "text_x", "text_y").mapInArrow(_verified, "x long, y long"), "links")
    tables.drop("pairs")
    tables.drop("pair-ids")
    return links


def connect(tables: _Tables, labels: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, label): the least uid of each node's component; nodes without a link are left out.

    ``labels`` holds the components so far, and ``links`` become links between their labels. Every round each node
    takes the least label among its neighbours' and its own, then its label's label, until nothing changes; each round
    is written to the shared folder. Aggregates are partial before the shuffle: a node of many links is no hot key.
    """
    ends = links
    for end in ("x", "y"):
        known = labels.select(F.col("uid").alias(end), F.col("label").alias("now"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
    ends = ends.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    edges = tables.put(ends, "edges")
    if not edges.limit(1).count():
        tables.drop("edges")
        return labels
    both_ways = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both_ways.groupBy("x").agg(F.min("y").alias("y"))
    state = tables.put(least.select(F.col("x").alias("uid"), F.least("x", "y").alias("label")), "state")
    changed = True
    while changed:
        heard = both_ways.join(state.withColumnRenamed("uid", "y"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        near = state.join(heard, state["uid"] == heard["x"]).select(
            "uid", F.col("label").alias("was"), F.least("label", "heard").alias("label")
        )
        jump = state.select(F.col("uid").alias("label"), F.col("label").alias("far"))
        new = near.join(jump, "label", "left").select(
            "uid", "was", F.least("label", F.coalesce("far", "label")).alias("label")
        )
        new = tables.put(new, "state")
        changed = bool(new.where("was <> label").limit(1).count())
        state = new.drop("was")
        tables.drop("state", but_last=True)
    moved = state.select(F.col("uid").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("uid", F.coalesce("to", "label").alias("label"))
    fresh = state.join(labels.select("uid"), "uid", "left_anti").select("uid", "label")
    out = tables.put(old.unionByName(fresh), "labels")
    for label in ("labels", "state", "edges"):
        tables.drop(label, but_last=label == "labels")
    return out


def _with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))


def _inside(tables: _Tables, members: DataFrame) -> DataFrame:
    """(key, uid, centre) for the nodes of each bucket of two or more, its centre, the least node, aside."""
    buckets = members.groupBy("key").agg(F.min("uid").alias("centre"), F.count(F.lit(1)).alias("size"))
    return tables.put(members.join(buckets.where("size > 1").drop("size"), "key").where("uid <> centre"), "inside")


def _stars(tables: _Tables, inside: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels after each node has been compared with the centres of its buckets, as far as their classes differ."""
    stars = tables.put(inside.groupBy("uid", "centre").agg(F.count(F.lit(1)).alias("shared")), "stars")
    best = stars.groupBy("uid").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("centre"))
    pairs = best.select(F.col("centre").alias("x"), F.col("uid").alias("y"))
    labels = connect(tables, labels, _verify(tables, pairs, texts))
    of_centre = labels.select(F.col("uid").alias("centre"), F.col("label").alias("other"))
    apart = _with_labels(stars, labels).join(of_centre, "centre", "left")
    apart = apart.where(F.col("label") != F.coalesce("other", "centre"))
    pairs = apart.select(F.col("centre").alias("x"), F.col("uid").alias("y"))
    return connect(tables, labels, _verify(tables, pairs, texts))


def _rest(tables: _Tables, inside: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels after the pairs that no star has compared: of one bucket, but of different classes and without its centre.

    In a group of many near copies these are too many to be listed by bucket, so they are found by prefix filtering
    among the nodes of such buckets, which is exact. Each node orders its layers by how many of these nodes have them,
    the rarest first. Nodes of n and m layers that are similar have at least 4/9 (n + m) in common, thus one of the
    first n - ceil(0.8 n) + 1 of each; and if the first such stands at places i and j, then no more than
    min(n - i, m - j). Rare layers are shared by close relatives only. Nothing is paired within the largest class of a
    layer, only the others with all; and first in rounds in which one member stands for the largest class, then in rounds
    over a part of the layers. Similar nodes share many layers, so most of them are of one class, and no pair any more, by
    the time all layers are gone through.
    """
    known = _with_labels(inside.select("key", "uid"), labels)
    classes = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    nodes = tables.put(known.join(classes.select("key"), "key").select("uid", "label").distinct(), "open")
    if not nodes.limit(1).count():
        return labels
    ids = nodes.select("uid")
    layers = tables.put(_needed(tables, ids, texts).mapInArrow(_layer_rows, "uid long, layer long"), "layers")
    shared = layers.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"))
    ordered = layers.join(shared, "layer").groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("nodes", "layer"))).alias("order")
    )
    n = F.size("order")
    prefix = F.slice("order", 1, (n - F.floor((4 * n + 4) / F.lit(5)) + 1).cast("int"))
    posts = ordered.select("uid", n.alias("n"), F.posexplode(prefix).alias("at", "x")).where("x.nodes > 1")
    posts = tables.put(posts.select(F.col("x.layer").alias("layer"), "uid", "n", "at"), "posts")
    tables.drop("layers")
    for turn, part in enumerate((*[1] * REST_STARS, *REST_PARTS, 1)):
        now = _with_labels(posts.where(F.pmod(F.xxhash64("layer"), F.lit(part)) == 0), labels)
        per_class = now.groupBy("layer", "label").agg(F.count(F.lit(1)).alias("nodes"))
        lists = per_class.groupBy("layer").agg(
            F.count(F.lit(1)).alias("classes"), F.max_by("label", F.struct("nodes", "label")).alias("largest")
        )
        mixed = tables.put(now.join(lists.where("classes > 1").drop("classes"), "layer"), "mixed")
        others = mixed
        if turn < REST_STARS:
            # most of what shares a rare layer is similar: one member of the largest class stands for it at first
            member = F.struct(F.xxhash64("uid", F.lit(turn)).alias("h"), "uid", "label", "n", "at")
            others = mixed.where("label = largest").groupBy("layer").agg(F.min(member).alias("m")).select("layer", "m.*")
        pairs = _possible(mixed.where("label <> largest"), others)
        labels = connect(tables, labels, _verify(tables, pairs, texts))
        tables.drop("mixed")
    return labels


def _possible(few: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) of different classes that share a layer, where sizes and places let them be similar."""
    end = lambda rows, x: rows.select("layer", *[F.col(c).alias(f"{c}_{x}") for c in ("uid", "label", "n", "at")])
    least, most = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    could = (F.col("label_x") != F.col("label_y")) & (5 * least >= 4 * most) & (9 * room >= 4 * (least + most))
    pairs = end(few, "x").join(end(others, "y"), "layer").where(could)
    return pairs.select(F.least("uid_x", "uid_y").alias("x"), F.greatest("uid_x", "uid_y").alias("y")).distinct()


def _near_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (uid, id, text, ...): the rows with their digests, the distinct texts with labels, and the classes."""
    tables = _Tables(rows.sparkSession)
    added = T.StructType().add("d1", "long").add("d2", "long").add("bands", T.ArrayType(T.LongType()))
    signed = rows.mapInArrow(_signed, T.StructType(rows.schema.fields + added.fields))
    signed = tables.put(signed, "signed", compression="zstd")
    # a text's least row stands for all rows with its words; of ids the least comes first, null last
    least = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    copies = tables.put(
        signed.where("d1 IS NOT NULL")
        .groupBy("d1", "d2")
        .agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n"), F.min(least).alias("first")),
        "copies",
    )
    texts = signed.select("uid", "text")
    reps = signed.select("uid", "bands").join(copies.select("uid"), "uid")
    members = tables.put(reps.select("uid", F.explode("bands").alias("key")), "members")
    labels = tables.put(copies.select("uid", F.col("uid").alias("label")).limit(0), "labels")
    inside = _inside(tables, members)
    tables.drop("members")
    labels = _stars(tables, inside, labels, texts)
    labels = _rest(tables, inside, labels, texts)
    nodes = _with_labels(copies, labels)
    classes = nodes.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("first").alias("least"))
    return signed, nodes, classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, class_id, class_size long, kept boolean.

    Texts are compared as multisets of five-word shingles; two are linked if their weighted Jaccard similarity is 0.8
    or more, and a class is a connected component of links. class_id is the least id of the class, and the row that
    has it is kept.

    1. One scan hashes the words, takes the DartMinHash signature and cuts it into bands. Texts with the same words
       are one node from here on, however many there are: a group of copies is never joined with itself.
    2. Nodes that share a band's key are a bucket. A bucket is linked as a star about its least node, never as all
       pairs: first each node with the centre that it shares most bands with, then with its other centres that are
       still in another class. Every link is verified on the whole texts.
    3. What stars can miss are similar nodes whose classes differ although they share a bucket. Among the nodes of all
       buckets with several classes left, an exact prefix filter on their rarest shingles finds every such pair
       (:func:`_rest`), so no bucket is capped and no group is paired with itself.

    With 28 bands of 5 rows a pair of similarity 0.8 shares no band with probability 0.000015.

    Null and empty texts have no words and are each in a class of their own, as are texts with no near duplicate. Rows
    that repeat are copies. Null ids are above all others; of rows that share a class's least id one is kept. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    signed, nodes, classes = _near_classes(rows)
    of_text = nodes.select("d1", "d2", "label").join(classes, "label").drop("label")
    rows = signed.select("uid", "id", "d1", "d2")
    known = rows.join(of_text, ["d1", "d2"]).select(
        F.col("id").alias(id_col),
        F.col("least.id").alias("class_id"),
        "class_size",
        (F.col("uid") == F.col("least.uid")).alias("kept"),
    )
    alone = rows.where("d1 IS NULL").select(
        F.col("id").alias(id_col),
        F.col("id").alias("class_id"),
        F.lit(1).cast("long").alias("class_size"),
        F.lit(True).alias("kept"),
    )
    return known.unionByName(alone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one of each class, with all their columns."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("__nd_none"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        rest.alias("rest"),
    )
    signed, _, classes = _near_classes(rows)
    kept = signed.select("uid").where("d1 IS NULL").unionByName(classes.select("least.uid"))
    out = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return signed.select("uid", "text", "rest").join(kept, "uid").select(*out)
