"""Clustering of a table (id, vec): distances, k-means and its parts, members, nearest rows.

Centroids are a small matrix, checked for its size, that goes to the tasks; rows stay distributed. Sums of a centroid
update are partial before the shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import cosine_distance, rounded, seeded, squared_distance

PLACES = 6
#: Rows of a block of vectors that is one row of a table.
BLOCK_ROWS = 256
#: Bytes of the second table of pairs that are held against the first at a time.
GROUP_BYTES = 64 << 20
#: Pairs that a task with one range of distances measures, about; rows of it that are sorted at a time.
RANGE_PAIRS, RANGE_SORTED = 1 << 27, 1 << 25
#: Different distances in a range, about as many as a writer of columns keeps in a dictionary; most ranges; shares of pairs
#: that may lie beyond them on either side, in the first and the last range: the first that needs no more ranges counts.
RANGE_VALUES, RANGES, RANGE_TAILS = 130_000, 16, (0.001, 0.01, 0.05)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names. Only a local master may leave it
    unset: a temporary folder then does."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("poolwright.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="poolwright-")
        spark.conf.set("poolwright.shared.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/poolwright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def pairwise(left: DataFrame, right: DataFrame, distance: str = "l2") -> DataFrame:
    """(id, other, distance) between all rows of ``left`` and the rows of ``right``, a small table: squared Euclidean
    (l2) or 2 - 2ab (cos). ValueError for another name."""
    if distance not in ("l2", "cos"):
        raise ValueError(f"unknown distance {distance!r}")
    measure = squared_distance if distance == "l2" else cosine_distance
    small = right.select(F.col("id").alias("other"), F.col("vec").alias("other_vec"))
    return left.crossJoin(small).select("id", "other", measure(F.col("vec"), F.col("other_vec")).alias("distance"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(i, BLOCK_ROWS)
            x = kernels.matrix_of(part.column(1))
            ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.record_batch([ids, pa.array([x.ravel()], pa.list_(pa.float64()))], names=["ids", "flat"])


def pairwise_blocks(left: DataFrame, right: DataFrame, distance: str = "l2") -> DataFrame:
    """As :func:`pairwise`, but ``right`` may have any number of rows: both sides are packed into blocks of at most
    ``BLOCK_ROWS`` rows, and every pair of blocks is one product of small matrices. The blocks of ``right`` are dealt to
    groups of about ``GROUP_BYTES``, however many partitions it has, since the join reads ``left`` once for each group (or
    broadcasts ``right`` below Spark's threshold). ``right`` is read twice, once for its size."""
    if distance not in ("l2", "cos"):
        raise ValueError(f"unknown distance {distance!r}")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, flat, others, other_flat = (batch.column(i)[row].values.to_numpy() for i in range(4))
                x, y = flat.reshape(len(ids), -1), other_flat.reshape(len(others), -1)
                d = _distances(x, y, distance)
                step = max(1, BLOCK_ROWS * 64 // len(others))
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    yield pa.record_batch(
                        [
                            pa.array(np.repeat(part, len(others))),
                            pa.array(np.tile(others, len(part))),
                            pa.array(d[i : i + step].ravel()),
                        ],
                        names=["id", "other", "distance"],
                    )

    packed = lambda rows: rows.select("id", "vec").mapInArrow(_packed, "ids array<long>, flat array<double>")
    spread = packed(left).repartition(4 * left.sparkSession.sparkContext.defaultParallelism)
    numbers = right.agg(F.sum(F.size("vec").cast("long"))).first()[0] or 0
    other = packed(right).repartition(max(1, -(-8 * numbers // GROUP_BYTES)))
    other = other.select(F.col("ids").alias("other_ids"), F.col("flat").alias("other_flat"))
    return spread.crossJoin(other).mapInArrow(measured, "id long, other long, distance double")


def _distances(x: np.ndarray, y: np.ndarray, distance: str) -> np.ndarray:
    return kernels.squared_distances(x, y) if distance == "l2" else 2.0 - 2.0 * (x @ y.T)


def _range_bounds(left: DataFrame, y: np.ndarray, distance: str, places: int, pairs: int) -> np.ndarray | None:
    """Bounds between ranges of distances that have ``RANGE_VALUES`` rounded values, by a sample of pairs; None if there
    would be more than ``RANGES``, or if of so many pairs less than four had a distance. They decide where a pair comes, not
    whether."""
    x = kernels.matrix_of(left.select("vec").limit(512).toArrow()["vec"].combine_chunks())
    with np.errstate(all="ignore"):
        d = _distances(x, y[:: -(-len(y) // 512)], distance)
    d = d[np.isfinite(d)]
    width = RANGE_VALUES / 8 / 10.0**places
    for tail in RANGE_TAILS if len(d) else ():
        low, high = np.quantile(d, [tail, 1 - tail])
        cells = np.unique(np.floor(d[(low <= d) & (d <= high)] / width))  # where there are distances; gaps cost no range
        if len(cells) <= 8 * min(RANGES, pairs / (4 * RANGE_VALUES)):
            return cells[8::8] * width
    return None


def _packed_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small blocks, which are dealt evenly; numbers of single precision in half of the bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS // 16):
            part = batch.slice(i, BLOCK_ROWS // 16)
            x = kernels.matrix_of(part.column(1))
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            flat = short if np.array_equal(short, x) else x
            ids = part.column(0).to_numpy().astype(np.int64).tobytes()
            yield pa.record_batch([pa.array([ids]), pa.array([flat.tobytes()]), pa.array([flat.itemsize])], names=["ids", "flat", "width"])


def pairwise_rounded(left: DataFrame, right: DataFrame, distance: str = "l2", places: int = 6) -> DataFrame:
    """As :func:`pairwise_blocks` with rounded distances, in an order that a writer of columns keeps in few bytes.

    A task has some rows of ``left`` and one range of distances. It measures all pairs of its rows, a block at a time, keeps
    those of its range and gives them by distance, the dense side of the range first, so that equal distances stand
    together. Every block is measured once for each range, which takes less than to shuffle the pairs or to write them
    unordered. Every pair is in one range, whatever its distance. ``right`` goes to all tasks; where it has more than
    ``GROUP_BYTES``, where there are few pairs or distances repeat too little, pairs come as
    :func:`pairwise_blocks` gives them. ``left`` is read three times, for its size, a sample and the pairs.
    """
    if distance not in ("l2", "cos"):
        raise ValueError(f"unknown distance {distance!r}")
    n, (others, numbers) = left.count(), right.agg(F.count(F.lit(1)), F.sum(F.size("vec").cast("long"))).first()
    rows = 1 << max(6, min(16, (RANGE_PAIRS // max(others, 1)).bit_length() - 1))  # of a task: an id takes whole bits
    bounds = None
    if n * others >= RANGE_PAIRS // 8 and 8 * numbers <= GROUP_BYTES:
        table = right.select("id", "vec").orderBy("id").toArrow()
        other_ids, y = table["id"].to_numpy(), kernels.matrix_of(table["vec"].combine_chunks())
        bounds = _range_bounds(left, y, distance, places, min(n, rows) * others)
    if bounds is None:
        return pairwise_blocks(left, right, distance).withColumn("distance", rounded(F.col("distance"), places))
    scale, last, most, names = 10.0**places, len(bounds), RANGE_SORTED, ["id", "other", "distance"]

    def batch_of(ids: np.ndarray, at: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        row = at // len(y)
        return pa.record_batch([pa.array(ids[row]), pa.array(other_ids[at - row * len(y)]), pa.array(d)], names=names)

    def of_range(ids: np.ndarray, x: np.ndarray, part: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        # below the middle the dense side is the upper one
        sign, zero, found = -1 if 2 * part < last else 1, float(np.floor(bounds[min(part, last - 1)] * scale)) if last else 0.0, 0

        def by_distance(found: int) -> Iterator[pa.RecordBatch]:
            keys[:found].sort()
            for i in range(0, found, 1 << 16):
                some = keys[i : min(found, i + (1 << 16))]
                yield batch_of(ids, some & 0xFFFFFFFF, ((some >> 32) * sign + zero) / scale)

        for i in range(0, len(x), BLOCK_ROWS):
            for j in range(0, len(y), BLOCK_ROWS):
                d = _distances(x[i : i + BLOCK_ROWS], y[j : j + BLOCK_ROWS], distance).ravel()
                inside = ~(d < bounds[part - 1]) if part else np.ones(len(d), dtype=bool)  # what is no number is in the last range
                if part < last:
                    inside &= d < bounds[part]
                at = np.flatnonzero(inside)
                d, wide = d[at], min(BLOCK_ROWS, len(y) - j)
                at = (i + at // wide) * len(y) + j + at % wide
                key = d * scale
                key = np.trunc(key + np.copysign(0.5, key))
                far = ~(np.abs(key - zero) < 1 << 30)
                if far.any():
                    yield batch_of(ids, at[far], np.where(np.abs(key[far]) < 1 << 52, key[far] / scale + 0.0, d[far]))
                    at, key = at[~far], key[~far]
                keys[found : found + len(at)] = (((key - zero) * sign).astype(np.int64) << 32) | at
                found += len(at)
                if found > most:
                    yield from by_distance(found)
                    found = 0
        yield from by_distance(found)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.empty(most + BLOCK_ROWS * BLOCK_ROWS, dtype=np.int64)  # distances above the places of their pairs
        step = max(BLOCK_ROWS, (1 << 31) // len(y))  # so that a place has at most 32 bits
        for batch in batches:
            parts = batch.column(3).to_numpy()
            for part in np.unique(parts):
                own = batch.filter(pa.array(parts == part))
                ids = np.frombuffer(b"".join(own.column(0).to_pylist()), dtype=np.int64)
                flats = zip(own.column(1), own.column(2).to_pylist(), strict=True)
                x = np.concatenate([np.frombuffer(b.as_buffer(), dtype=f"f{w}").astype(np.float64) for b, w in flats])
                x = x.reshape(len(ids), -1)
                for i in range(0, len(x), step):
                    yield from of_range(ids[i : i + step], x[i : i + step], int(part), keys)

    packed = left.select("id", "vec").mapInArrow(_packed_bytes, "ids binary, flat binary, width long")
    spread = packed.repartition(-(-16 * n // (15 * rows)))
    ranges = left.sparkSession.range(0, last + 1, 1, last + 1).withColumnRenamed("id", "part")
    pairs = spread.hint("shuffle_replicate_nl").crossJoin(ranges)  # a task for each part of the rows and each range
    return pairs.mapInArrow(measured, "id long, other long, distance double")


def blocks(rows: DataFrame, max_bytes: int) -> Iterator[np.ndarray]:
    """The vectors of all rows, in matrices of at most so many bytes (one row at least). The driver holds one matrix
    and the packed rows of one partition."""
    parts: list[np.ndarray] = []
    size = 0
    packed = rows.select("id", "vec").mapInArrow(_packed, "ids array<long>, flat array<double>")
    for row in packed.select(F.size("ids").alias("n"), "flat").toLocalIterator():
        x = np.array(row["flat"], dtype=np.float64).reshape(row["n"], -1)
        step = max(1, max_bytes // max(1, x[0].nbytes))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            if parts and size + part.nbytes > max_bytes:
                yield np.vstack(parts)
                parts, size = [], 0
            parts.append(part)
            size += part.nbytes
    if parts:
        yield np.vstack(parts)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the first k rows in seeded order: a start that other engines can repeat."""
    first = rows.select("vec", seeded(seed, F.col("id")).alias("key"), "id").orderBy("key", "id").limit(k)
    return kernels.checked(np.array([r["vec"] for r in first.collect()], dtype=np.float64))


def farthest_first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first row in seeded order, then each time the row farthest from all taken."""
    chosen = first_centroids(rows, 1, seed)
    while 0 < len(chosen) < k:
        far = assign_clusters(rows, chosen).join(rows, "id").agg(F.max_by("vec", F.struct("d2", -F.col("id")))).first()[0]
        chosen = np.vstack([chosen, far])
    return kernels.checked(chosen)


def lowered(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vec, d2): the squared distance to the nearest centre, or what d2 says already if that is less."""
    known = "d2" in rows.columns

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = kernels.matrix_of(batch.column(1))
            d2 = batch.column(2).to_numpy() if known else np.full(len(x), np.inf)
            if len(x) and len(centres):
                d2 = np.minimum(d2, kernels.nearest(x, centres)[1])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(d2)], names=["id", "vec", "d2"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("id", "vec", *["d2"] * known).mapInArrow(least, f"id long, vec {kind}, d2 double")


def _uniform(seed: int, key: Column) -> Column:
    """A number above 0 and up to 1 from the seeded hash of a row."""
    return (F.conv(F.substring(seeded(seed, key), 1, 12), 16, 10).cast("double") + 1) / 2.0**48


#: Centres after which the distances so far are written.
WRITTEN_AFTER = 16


def kmeans_plus_plus(
    rows: DataFrame, k: int, seed: int, chosen: np.ndarray | None = None, after: Callable[[np.ndarray], None] | None = None
) -> np.ndarray:
    """Greedy k-means++: candidates are drawn by squared distance as the rows of least -ln(u) / d2, with u from the
    seeded hash of each row, so any number of tasks draws the same; the one that leaves the least potential stays.

    Distances stand beside the vectors and are only lowered: nothing is joined or shuffled, and a table is written for
    every ``WRITTEN_AFTER`` centres. ``chosen`` has the centres of a run to go on with; ``after`` gets them at each one.
    """
    if chosen is None:
        chosen = first_centroids(rows, 1, seed)
        if after and len(chosen):
            after(chosen)
    trials = 2 + int(np.log(max(k, 1)))
    known, written = cut(lowered(rows, chosen)), len(chosen)
    while 0 < len(chosen) < k:
        if len(chosen) - written >= WRITTEN_AFTER:
            known, written = cut(lowered(known, chosen[written:])), len(chosen)
        at = lowered(known, chosen[written:])
        u = _uniform(seed * 1000003 + len(chosen), F.col("id"))
        drawn = at.where("d2 > 0").orderBy(-F.ln(u) / F.col("d2"), "id").limit(trials).select("vec").collect()
        if not drawn:
            break
        candidates = np.array([r["vec"] for r in drawn], dtype=np.float64)
        chosen = np.vstack([chosen, candidates[int(np.argmin(_potentials(at, candidates)))]])
        if after:
            after(chosen)
    return kernels.checked(chosen)


#: Passes of the parallel start, and rows drawn in each, in k.
PARALLEL_ROUNDS, OVERSAMPLING = 5, 2


def kmeans_parallel(
    rows: DataFrame, k: int, seed: int, rounds: int = PARALLEL_ROUNDS, oversampling: float = OVERSAMPLING
) -> np.ndarray:
    """A start in a few passes where k-means++ takes k of them: whole samples are drawn, weighed and clustered again.

    From the first row in seeded order on, each round draws every row with probability ``oversampling`` * k * d2 / sum
    of d2, by the row's seeded hash, so about ``oversampling`` * k rows come to the driver, however many there are. Each
    candidate then weighs as many rows as are nearest to it, and weighted k-means++ over the candidates, again by seeded
    hashes, picks k of them: first the heaviest, then those of least -ln(u) / (weight * d2). Of fewer different rows than
    k all are centres.
    """
    drawn = rows.select("id", "vec").orderBy(seeded(seed, F.col("id")), "id").limit(1).collect()
    if not drawn:
        return np.zeros((0, 0))
    ids, parts, at = [], [], rows
    for n in range(1, rounds + 2):
        if drawn:
            ids += [r["id"] for r in drawn]
            parts.append(np.array([r["vec"] for r in drawn], dtype=np.float64))
        if n > rounds:
            break
        at = cut(lowered(at, parts[-1]))
        potential = at.agg(F.sum("d2")).first()[0]
        if not potential:
            break
        share = F.lit(float(oversampling * k)) * F.col("d2") / F.lit(potential)
        drawn = at.where(_uniform(seed * 1000003 + n, F.col("id")) < share).select("id", "vec").collect()
    points = np.vstack(parts)
    order = np.argsort(ids, kind="stable")  # of equal distances the candidate of the least id has the row
    ids, points = np.array(ids)[order], kernels.checked(points[order])
    sizes = assign_clusters(rows, points).groupBy("cid").agg(F.count(F.lit(1)).alias("n")).collect()
    weight = np.zeros(len(points))
    weight[[r["cid"] for r in sizes]] = [r["n"] for r in sizes]
    centres = [int(np.argmax(weight))]
    d2 = kernels.squared_distances(points, points[centres])[:, 0]
    while len(centres) < k and (weight * d2 > 0).any():
        u = np.array([(int(md5(f"{seed * 1000003 + 1000 + len(centres)}:{i}".encode()).hexdigest()[:12], 16) + 1) / 2.0**48 for i in ids])
        free = weight * d2 > 0
        key = np.where(free, -np.log(u) / np.where(free, weight * d2, 1), np.inf)
        centres.append(int(np.argmin(key)))
        d2 = np.minimum(d2, kernels.squared_distances(points, points[centres[-1:]])[:, 0])
    return points[centres]


def _potentials(rows: DataFrame, candidates: np.ndarray) -> list[float]:
    """The potential that each candidate would leave: partial sums by task."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, d2 = kernels.matrix_of(batch.column(0)), batch.column(1).to_numpy()
            left = np.minimum(d2[:, None], kernels.squared_distances(x, candidates)) if len(x) else np.zeros((0, len(candidates)))
            yield pa.record_batch([pa.array(np.arange(len(candidates))), pa.array(left.sum(axis=0))], names=["c", "s"])

    out = rows.select("vec", "d2").mapInArrow(sums, "c long, s double").groupBy("c").agg(F.sum("s").alias("s"))
    return [r["s"] for r in out.orderBy("c").collect()]


def assign_clusters(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cid, d2): the nearest centroid, the first of equal ones, in Arrow batches."""
    centroids = kernels.checked(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = kernels.matrix_of(batch.column(1))
            which, d2 = kernels.nearest(x, centroids) if len(x) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield pa.record_batch([batch.column(0), pa.array(which), pa.array(d2)], names=["id", "cid", "d2"])

    return rows.select("id", "vec").mapInArrow(assigned, "id long, cid long, d2 double")


def compute_centroids(rows: DataFrame, assignment: DataFrame, before: np.ndarray) -> np.ndarray:
    """Means of the members; an empty cluster keeps its centroid."""
    out = before.copy()
    for row in member_means(rows, assignment).collect():
        out[row["cid"]] = row["mean"]
    return out


def member_means(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cid, n, mean)."""
    members = rows.join(assignment.select("id", "cid"), "id").select("cid", array_to_vector("vec").alias("v"))
    mean = vector_to_array(Summarizer.mean(F.col("v")))
    return members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"))


def _updates(rows: DataFrame, runs: list[np.ndarray]) -> list[np.ndarray]:
    """One assignment and update of every run in a single pass over the rows: per task the sums of the members, then
    their totals."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)) for centroids in runs]
        for batch in batches:
            x = kernels.matrix_of(batch.column(0))
            if not len(x):
                continue
            for centroids, (n, s) in zip(runs, total, strict=True):
                which, _ = kernels.nearest(x, centroids)
                n += np.bincount(which, minlength=len(centroids))
                s += kernels.sums_by(x, which, len(centroids))
        for run, (n, s) in enumerate(total):
            full = np.flatnonzero(n)
            yield pa.record_batch(
                [pa.array(np.full(len(full), run)), pa.array(full), pa.array(n[full]), pa.array(list(s[full]), pa.list_(pa.float64()))],
                names=["run", "cid", "n", "s"],
            )

    parts = rows.select("vec").mapInArrow(sums, "run long, cid long, n long, s array<double>")
    total = vector_to_array(Summarizer.sum(F.col("v")))
    parts = parts.select("run", "cid", "n", array_to_vector("s").alias("v")).groupBy("run", "cid")
    out = [centroids.copy() for centroids in runs]
    for row in parts.agg(F.sum("n").alias("n"), total.alias("s")).collect():
        out[row["run"]][row["cid"]] = np.array(row["s"]) / row["n"]
    return out


def _run_potentials(rows: DataFrame, runs: list[np.ndarray]) -> list[float]:
    """The :func:`potential` of every run, summed over its clusters, in two passes: the means of the members, then the
    squared distances to them."""
    means = _updates(rows, runs)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(runs))
        for batch in batches:
            x = kernels.matrix_of(batch.column(0))
            for run in range(len(runs) if len(x) else 0):
                total[run] += kernels.gaps(x, means[run], kernels.nearest(x, runs[run])[0])
        yield pa.record_batch([pa.array(np.arange(len(runs))), pa.array(total)], names=["run", "cost"])

    parts = rows.select("vec").mapInArrow(sums, "run long, cost double")
    costs = {r["run"]: r["cost"] for r in parts.groupBy("run").agg(F.sum("cost").alias("cost")).collect()}
    return [costs.get(run, 0.0) for run in range(len(runs))]


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after exactly so many rounds."""
    for _ in range(rounds):
        centroids = _updates(rows, [centroids])[0]
    return centroids


def potential(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cid, n, potential): members and the sum of their squared distances to their own mean."""
    means = member_means(rows, assignment)
    joined = rows.join(assignment.select("id", "cid"), "id").join(means, "cid")
    gap = squared_distance(F.col("vec"), F.col("mean"))
    return joined.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("potential"))


STARTS = {"first": first_centroids, "farthest": farthest_first_centroids, "kmeans++": kmeans_plus_plus, "kmeans||": kmeans_parallel}


def kmeans(rows: DataFrame, k: int, rounds: int = 10, seed: int = 1, start: str = "first", tries: int = 1) -> np.ndarray:
    """Centroids of k clusters (of fewer if there are fewer rows); of several tries the one of least potential.

    The rows are written once, so that no round repeats the joins that they come from. All tries take their rounds
    together, as many as a broadcast holds: a round is one pass over the rows, however many tries there are.
    """
    if start not in STARTS:
        raise ValueError(f"unknown start {start!r}")
    rows = cut(rows.select("id", "vec"))
    best: tuple[float, np.ndarray] | None = None
    starts = [STARTS[start](rows, k, seed + i) for i in range(tries)]
    together = max(1, kernels.MAX_MATRIX_BYTES // max(1, *(centroids.nbytes for centroids in starts)))
    for i in range(0, tries, together):
        runs = starts[i : i + together]
        for _ in range(rounds):
            runs = _updates(rows, runs)
        if tries == 1:
            return runs[0]
        for cost, centroids in zip(_run_potentials(rows, runs), runs, strict=True):
            best = (cost, centroids) if best is None or cost < best[0] else best
    return best[1]


def cluster_members(assignment: DataFrame) -> DataFrame:
    """(cid, members): ids of each cluster in order."""
    return assignment.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("members"))


def sorted_by_distance(assignment: DataFrame, places: int = PLACES) -> DataFrame:
    """(cid, id, d2, nth): members of each cluster, the nearest first."""
    d2 = F.round("d2", places)
    nth = F.row_number().over(Window.partitionBy("cid").orderBy(d2, "id"))
    return assignment.select("cid", "id", d2.alias("d2"), nth.cast("long").alias("nth"))


def nearest_rows(rows: DataFrame, centroids: np.ndarray, places: int = PLACES) -> DataFrame:
    """(id, score): for each centroid the nearest of all rows; the least first, no row twice. Tasks send one row each
    per centroid."""
    centroids = kernels.checked(centroids)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), kernels.matrix_of(batch.column(1))
            if not len(x):
                continue
            d2 = np.round(kernels.squared_distances(x, centroids), places)
            order = np.lexsort((ids,))
            at = order[d2[order].argmin(axis=0)]
            cid = np.arange(len(centroids))
            yield pa.record_batch([pa.array(cid), pa.array(ids[at]), pa.array(d2[at, cid])], names=["cid", "id", "d2"])

    found = rows.select("id", "vec").mapInArrow(best, "cid long, id long, d2 double")
    near = found.groupBy("cid").agg(F.min(F.struct("d2", "id")).alias("near"))
    return near.groupBy("near.id").agg(F.min("near.d2").alias("score")).orderBy("score", "id")
