"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import drop_path, work_path

#: Lines whose key has fewer code points are always kept.
MIN_KEY_CHARS = 10
#: Batches of a table, by ascending id.
BATCHES = 4
#: Runs of one level that are compacted into one run of the next.
FANOUT = 2
#: Bytes of output that one Arrow batch is closed at.
BATCH_BYTES = 8 << 20

_WHITE = b" \t\n\x0b\x0c\r"
_LAST_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes | None:
    """The key of a line in UTF-8: stripped of white space, A-Z lower-cased; None if it is too short to count."""
    key = line.strip(_WHITE).lower()  # bytes.lower() changes A-Z only
    if len(key) >= 4 * MIN_KEY_CHARS or (len(key) >= MIN_KEY_CHARS and len(key.decode()) >= MIN_KEY_CHARS):
        return key
    return None


def _halves(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h1, h2) for each distinct key of each text."""
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    for batch in batches:
        ids, h1, h2 = [], [], []
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys = {line_key(line) for line in (text.as_py() or "").encode().split(b"\n")}
            keys.discard(None)
            for key in keys:
                a, b = _halves(key)
                ids.append(row_id)
                h1.append(a)
                h2.append(b)
        yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, h1, h2)], schema=schema)


class LineRuns:
    """Which keys have been seen, and in which document first: runs of (h1, h2, owner), in levels.

    A run is a table bucketed by (h1, h2) and sorted within its buckets, written to the shared folder. A batch is
    joined with each run as it lies: the run is neither shuffled nor aggregated again. ``FANOUT`` runs of a level are
    merged into one of the next, so there are at most FANOUT - 1 runs a level and about log(batches) levels.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, run: DataFrame) -> tuple[str, str]:
        table, path = f"line_run_{uuid.uuid4().hex}", work_path(self.spark, "line-run")
        (
            run.repartition(self.buckets, "h1", "h2")
            .sortWithinPartitions("h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", path)
            .saveAsTable(table)
        )
        return table, path

    def _union(self, runs: list[tuple[str, str]]) -> DataFrame:
        first, *rest = [self.spark.table(table) for table, _ in runs]
        for other in rest:
            first = first.unionByName(other)
        return first

    def add(self, batch: DataFrame) -> None:
        """Take in (id, h1, h2): keys that no run holds become a new run, owned by their least id in the batch."""
        new = batch.groupBy("h1", "h2").agg(F.min("id").alias("owner"))
        for level in self.levels:
            for table, _ in level:
                new = new.join(self.spark.table(table).hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._write(new))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._union(merged)))
            for table, path in merged:
                self.spark.sql(f"DROP TABLE {table}")
                drop_path(self.spark, path)

    def owners(self) -> DataFrame:
        """All runs, (h1, h2, owner), read as files from now on: nothing stays in the catalog, and nothing can be added."""
        runs = [run for level in self.levels for run in level]
        schema = self.spark.table(runs[0][0]).schema
        for table, _ in runs:
            self.spark.sql(f"DROP TABLE {table}")  # the files stay until the driver ends
        self.levels = []
        return self.spark.read.schema(schema).parquet(*[path for _, path in runs])


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """The batch of an id: about equal numbers of rows by ascending id. Only ids are read for the bounds."""
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("id", shares, 1000)).first()[0] if shares else None
    batch = F.lit(0)
    for bound in bounds or []:
        batch = batch + (F.col("id") > bound).cast("int")
    return batch


def _dedup_columns(other: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("rest", other),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )


def _strip_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rest, text, owned -> rest, n_lines, n_dropped, text without the lines whose key another document owns."""
    for batch in batches:
        rest, texts, owned = (batch.column(batch.schema.get_field_index(c)) for c in ("rest", "text", "owned"))
        start, size, lines_of, dropped, out = 0, 0, [], [], []
        for i in range(batch.num_rows):
            lines = (texts[i].as_py() or "").encode().split(b"\n")
            mine = {(x["h1"], x["h2"]) for x in owned[i].as_py() or ()}
            kept = [line for line in lines if (key := line_key(line)) is None or _halves(key) in mine]
            lines_of.append(len(lines))
            dropped.append(len(lines) - len(kept))
            out.append(b"\n".join(kept).decode())
            size += len(out[-1])
            if size >= BATCH_BYTES or i == batch.num_rows - 1:
                yield pa.record_batch(
                    [
                        rest.slice(start, i + 1 - start),
                        pa.array(lines_of, pa.int64()),
                        pa.array(dropped, pa.int64()),
                        pa.array(out, pa.string()),
                    ],
                    names=["rest", "n_lines", "n_dropped", "text"],
                )
                start, size, lines_of, dropped, out = i + 1, 0, [], [], []


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of their texts, and two columns more: n_lines and n_dropped.

    A line's key is the line stripped of white space, with A-Z lower-cased. A key of at least 10 code points that two
    or more documents hold loses all its lines but those of the least id; other lines stay, joined by \\n.

    One scan gives the distinct 128-bit key hashes of each text. They are taken in as ``batches`` of ascending ids:
    each is reduced to its keys' least ids, anti-joined by merging with the sorted runs of earlier batches, and
    becomes a run itself (:class:`LineRuns`). So the runs say for every key which document keeps it, and a text is
    joined only with the keys that it keeps. A line that a third of all documents share is reduced before the shuffle
    and is in the runs once.

    Null and empty texts are one empty line, which stays; the text becomes empty. A null id counts as above every
    other; rows that share an id are one document and keep the same lines. Columns of ``docs`` named n_lines or
    n_dropped are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    key_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID))
    others = [c for c in docs.columns if c != text_col]
    texts = docs.select(key_id.alias("id"), F.col(text_col).alias("text"))
    path = work_path(spark, "line-keys")
    keys = texts.mapInArrow(_keys_of, "id long, h1 long, h2 long")
    keys.withColumn("batch", _batch_of(texts, batches)).write.partitionBy("batch").parquet(path)
    all_keys = spark.read.schema("id long, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(all_keys.where(F.col("batch") == i).drop("batch"))
    drop_path(spark, path)
    owned = runs.owners().groupBy("owner").agg(F.collect_list(F.struct("h1", "h2")).alias("owned"))
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).alias("none"))
    rows = docs.select(key_id.alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    joined = rows.join(owned, rows["id"] == owned["owner"], "left").select("rest", "text", "owned")
    stripped = joined.mapInArrow(_strip_lines, _dedup_columns(joined.schema["rest"].dataType))
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    columns = [x for x, c in zip(columns, docs.columns, strict=True) if c not in ("n_lines", "n_dropped")]
    return stripped.select(*columns, "n_lines", "n_dropped")
