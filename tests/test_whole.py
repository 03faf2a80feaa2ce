"""Registered queries and operators work on all the rows that they are meant for."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from poolwright.functions import kernels
from poolwright.operators import clustering, hierarchy, strategies, textures
from poolwright.plans import registry
from poolwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
tables_here = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def embeddings(spark):
    return {r["vec_id"]: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


@tables_here
@pytest.mark.parametrize("name", ["ssrae_features", "vctex_features"])
def test_features_of_every_unlabelled_row(spark, embeddings, name):
    ids = [r["id"] for r in QUERIES[name](spark, SF).select("id").collect()]
    assert sorted(ids) == sorted(i for i in embeddings if i % 5)


@tables_here
@pytest.mark.parametrize("name", ["pairwise_l2_whole", "pairwise_cosine_whole"])
def test_pairs_with_every_twentieth_row(spark, embeddings, name):
    got = {(r["id"], r["other"]): r["distance"] for r in QUERIES[name](spark, SF).collect()}
    others = [i for i in embeddings if i % 20 == 0]
    assert len(got) == len(embeddings) * len(others) and len(others) > 1
    vec = {i: np.array(r["embedding"], dtype=np.float64) for i, r in embeddings.items()}
    measure = (lambda a, b: ((a - b) ** 2).sum()) if "l2" in name else (lambda a, b: 2 - 2 * a @ b)
    assert all(abs(d - measure(vec[a], vec[b])) < 2e-6 for (a, b), d in got.items())


def test_pairs_of_many_blocks(spark):
    rows = spark.range(700).selectExpr("id", "array(double(id), 1D) AS vec")
    got = clustering.pairwise_blocks(rows, rows.where("id < 600"))
    assert got.count() == 700 * 600 == got.select("id", "other").distinct().count()
    assert got.where("distance <> (id - other) * (id - other)").count() == 0


def test_first_table_of_pairs_is_read_once_for_each_group(spark, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to broadcast
    try:
        rows = spark.range(700).selectExpr("id", "array(double(id), 1D) AS vec")
        pairs = lambda n: clustering.pairwise_blocks(rows, rows.where("id < 600").repartition(n))
        one = pairs(1).rdd.getNumPartitions()
        assert pairs(7).rdd.getNumPartitions() == one
        monkeypatch.setattr(clustering, "GROUP_BYTES", 4096)
        got = pairs(7)  # 9,600 bytes
        assert got.rdd.getNumPartitions() == 3 * one
        assert got.count() == 700 * 600 == got.select("id", "other").distinct().count()
        assert got.where("distance <> (id - other) * (id - other)").count() == 0
        assert clustering.pairwise_blocks(rows, rows.where("id < 0")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def unit_vectors(spark, n, width=16, odd=()):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, width)).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i, v in odd:
        x[i] = v
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("distance", ["l2", "cos"])
@pytest.mark.parametrize("most", [1 << 25, 5000])
def test_every_pair_is_in_one_range_of_distances(spark, monkeypatch, distance, most):
    for name, value in {"RANGE_PAIRS": 1 << 18, "RANGE_SORTED": most, "RANGE_VALUES": 4000}.items():
        monkeypatch.setattr(clustering, name, value)
    monkeypatch.setattr(clustering, "pairwise_blocks", None)
    odd = [(3, 1e6), (40, -1e6), (701, np.nan), (720, 1e200), (1, 0.0), (602, 0.5)]
    x, rows = unit_vectors(spark, 900, odd=odd)
    out = clustering.pairwise_rounded(rows, rows.where("id % 3 = 0"), distance, 4)
    parts = [[tuple(r) for r in part] for part in out.rdd.glom().collect()]
    assert sum(map(bool, parts)) > 4
    got = {(i, j): d for part in parts for i, j, d in part}
    assert sum(map(len, parts)) == 900 * 300 == len(got) and {j for _, j in got} == set(range(0, 900, 3))
    with np.errstate(all="ignore"):
        want = kernels.squared_distances(x, x) if distance == "l2" else 2 - 2 * x @ x.T
    d, e = np.array(list(got.values())), np.array([want[i, j] for i, j in got])
    with np.errstate(invalid="ignore"):
        near = np.abs(d - e) <= np.maximum(0.51e-4, 1e-12 * np.abs(e))
    assert (near | (d == e) | (np.isnan(d) & np.isnan(e))).all()
    small = d[np.abs(d) < 9] * 1e4
    assert len(small) > 250_000 and (np.abs(small - np.rint(small)) < 1e-8).all()


def test_ranges_leave_out_gaps(spark):
    far = [0.0] * 64 + [8.0]  # every second row, at 65 from the others
    x = np.hstack([unit_vectors(spark, 900, 64)[0], np.zeros((900, 1))])
    x[::2] = far
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    bounds = clustering._range_bounds(rows, x[::3], "l2", 6, 1 << 27)
    assert 8 < len(bounds) < clustering.RANGES and bounds[0] < 1.7 and bounds[-1] > 2.2
    assert max(high - low for low, high in zip(bounds, bounds[1:]) if high < 2.5) < 0.2


def test_pairs_by_distance_take_less_room(spark, monkeypatch, tmp_path):
    _, rows = unit_vectors(spark, 3000)
    pairs = lambda: clustering.pairwise_rounded(rows, rows.where("id % 5 = 0"), "cos", 4)
    pairs().write.parquet(f"{tmp_path}/few")
    monkeypatch.setattr(clustering, "RANGE_PAIRS", 1 << 21)
    pairs().write.parquet(f"{tmp_path}/ranges")
    size = {name: sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) for name in ("few", "ranges")}
    few, ranges = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("few", "ranges"))
    assert ranges.count() == few.count() == 3000 * 600
    far = few.join(ranges.withColumnRenamed("distance", "d"), ["id", "other"]).where("abs(distance - d) > 1e-9")
    assert far.count() == 0 and size["ranges"] < 3.5 * 3000 * 600


@pytest.mark.parametrize("name", ["pairwise_l2_whole", "pairwise_cosine_whole"])
def test_pairs_of_a_larger_table_take_less_room(spark, tmp_path, name):
    n = 18_400
    x = np.random.default_rng(5).normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    table = pa.table({"vec_id": np.arange(n), "embedding": vectors, "label": np.zeros(n, dtype=np.int32)})
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == n * n // 20
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 5.5 * n * n / 20


@tables_here
def test_every_pixel_is_normalized(spark, embeddings):
    got = {(r["id"], r["pos"]): r["value"] for r in QUERIES["pixel_normalization_whole"](spark, SF).collect()}
    mean, std = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    assert len(got) == sum(len(r["embedding"]) for r in embeddings.values())
    for (i, pos), value in got.items():
        x = np.floor((float(embeddings[i]["embedding"][pos]) + 1) * 100)
        assert abs(value - (x / 255 - mean[pos % 3]) / std[pos % 3]) < 1e-6


@tables_here
def test_export_has_every_row(spark, embeddings):
    rows = QUERIES["index_export_whole"](spark, SF).collect()
    assert sorted(r["id"] for r in rows) == sorted(embeddings) and {r["split"] for r in rows} == {"train", "test"}
    assert {r["id"] for r in rows if r["split"] == "test"} == {i for i in embeddings if i % 10 == 1}


def farthest_first(vec, labelled, n):
    """Picks and distances by brute force; of equally far rows the least id."""
    d2 = {i: min(((v - vec[j]) ** 2).sum() for j in labelled) for i, v in vec.items() if i not in labelled}
    picks = []
    while len(picks) < n:
        i = min(d2, key=lambda i: (-round(d2[i], 6), i))
        picks.append((i, -np.sqrt(d2.pop(i))))
        d2 = {j: min(d, ((vec[j] - vec[i]) ** 2).sum()) for j, d in d2.items()}
    return picks


@tables_here
def test_kcenter_picks_n(spark, embeddings):
    got = [(r["id"], r["score"]) for r in QUERIES["kcenter_greedy_whole"](spark, SF).collect()]
    vec = {i: np.array(r["embedding"], dtype=np.float64) for i, r in embeddings.items()}
    want = farthest_first(vec, {i for i in vec if i % 5 == 0}, 10)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=2e-6)


def test_kcenter_refuses_no_number_of_labels(spark, monkeypatch):
    monkeypatch.setattr(kernels, "MAX_MATRIX_BYTES", 2048)
    rng = np.random.default_rng(7)
    vec = {i: rng.normal(size=4) for i in range(300)}
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in vec.items()], "id long, label int, vec array<double>")
    labels = rows.where("id < 200").selectExpr("id", "0 AS round")
    got = [r["id"] for r in strategies.kcenter_greedy(rows, labels, 4).collect()]
    assert got == [i for i, _ in farthest_first(vec, set(range(200)), 4)]


@pytest.mark.parametrize("name", ["SSRAEKmeansSampling", "VCTexKmeansSampling"])
def test_best_of_ten_starts(spark, monkeypatch, name):
    asked = []

    def kmeans(rows, k, rounds, seed, tries=1):
        asked.append(tries)
        return np.array([[0.0], [9.0]])

    monkeypatch.setattr(clustering, "kmeans", kmeans)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, vec array<double>")
    got = registry.strategy(name)(None, None, 2, None, rows, 1).collect()
    assert asked == [10] and sorted(r["id"] for r in got) == [0, 9]


def test_tries_take_their_rounds_together(spark):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(400)], "id long, vec array<double>")
    x = np.array([r["vec"] for r in rows.collect()])
    spark.sparkContext.setJobGroup("tries", "tries")
    got = clustering.kmeans(rows, 5, 8, 1, tries=6)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("tries")) < 6 * 8  # a job a round and try is no more
    each = [clustering.kmeans(rows, 5, 8, 1 + i) for i in range(6)]
    cost = [kernels.lloyd(x, c, 0)[2] for c in each]
    assert np.allclose(got, each[int(np.argmin(cost))])
    assert np.allclose(clustering._run_potentials(rows, each), cost)


def test_levels_read_features_once_and_end_when_no_row_moves(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vec(i):
        read.add(1)
        return [float(i % 4), float(i % 3)]

    rows = spark.range(200).repartition(2).select("id", vec("id").alias("vec"))
    calls = []
    monkeypatch.setattr(kernels, "nearest", lambda *args, f=kernels.nearest: calls.append(1) or f(*args))
    levels = hierarchy.hierarchical_kmeans(rows, (6, 2), 50, 1)
    assert read.value == 200 == levels[0].count()
    assert len(calls) < 10  # six centroids settle long before 50 rounds


def naive_weights(x, y, q, ridge):
    """Ridge weights from the hidden layer to y, one product at a time."""
    hidden = textures.hidden_weights(q, len(x)).astype(np.float64)
    z = np.array([[-1.0] * x.shape[1]] + [[1 / (1 + np.exp(-(h[1:] @ x[:, i] - h[0]))) for i in range(x.shape[1])] for h in hidden])
    return (y @ z.T) @ np.linalg.inv(z @ z.T + ridge * np.eye(q + 1))


def naive_windows(channel):
    height, width = channel.shape
    at = lambda i, j: channel[min(max(i, 0), height - 1), min(max(j, 0), width - 1)]
    places = [(i, j) for i in range(height) for j in range(width)]
    return np.array([[at(i + a, j + b) for i, j in places] for a in (-1, 0, 1) for b in (-1, 0, 1)], dtype=np.float64)


def naive_standard(rows):
    return np.array([(r - r.mean()) / (np.sqrt(((r - r.mean()) ** 2).sum() / (len(r) - 1)) + 1e-3) for r in rows])


def test_textures_by_hand():
    image = np.random.default_rng(3).integers(0, 256, (7, 6, 3)).astype(np.uint8)
    raw = [naive_windows(image[:, :, c]) for c in range(3)]
    std = [naive_standard(r) for r in raw]
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (2, 0)]
    want = np.hstack([naive_weights(std[a], std[b], 13, 1e-3) for a, b in pairs]).ravel()
    assert np.allclose(textures.ssrae(image), want, rtol=2e-3, atol=2e-3)
    x, y = np.vstack(std), np.vstack(raw)
    want = np.concatenate([naive_weights(x, y, q, 1e3).ravel() for q in (5, 17)])
    assert np.allclose(textures.vctex(image), want, rtol=1e-4, atol=1e-4)


@tables_here
@pytest.mark.parametrize("name", ["ssrae_kmeans_sampling", "vctex_kmeans_sampling", "ssrae_kmeans_hc_sampling"])
def test_texture_strategies_choose_by_texture(spark, embeddings, name, monkeypatch):
    seen = []
    monkeypatch.setattr(registry, "features_for", lambda *args, f=registry.features_for: seen.append(f(*args)) or seen[-1])
    ids = [r["id"] for r in QUERIES[name](spark, SF).collect()]
    assert len(set(ids)) == len(ids) <= 10 and all(i % 5 for i in ids)
    features = {r["id"]: np.array(r["vec"]) for r in seen[0].collect()}
    assert sorted(features) == sorted(i for i in embeddings if i % 5)
    if "hc" not in name:
        centroids = clustering.kmeans(seen[0], 10, 10, 1, tries=10)
        near = {min(features, key=lambda i: (round(((features[i] - m) ** 2).sum(), 6), i)) for m in centroids}
        assert near == set(ids)


def test_features_are_extracted_once(spark, tmp_path, monkeypatch):
    pixels = bytes(np.random.default_rng(1).integers(0, 256, 5 * 5 * 3).astype(np.uint8))
    images = spark.createDataFrame([(i, 5, 5, pixels) for i in range(3)], "id long, height int, width int, pixels binary")
    first = registry.features_for("SSRAEKmeansSampling", images, str(tmp_path))
    assert first.count() == 3 and len(first.first()["vec"]) == 756
    again = registry.features_for("SSRAEKmeansHCSampling", images.limit(0), str(tmp_path))
    other = registry.features_for("VCTexKmeansSampling", images, str(tmp_path))
    assert again.count() == 3 and len(other.first()["vec"]) == 648
