"""Invariants and worked values of the operators on small tables."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwright.operators import clustering, hierarchy, metrics, pool, reports, strategies, textures
from poolwright.operators.scorers import MLScorer, PrototypeScorer, UDFScorer
from poolwright.plans import loop, registry
from poolwright.sources import images, results, tables
from poolwright.streaming import score_stream


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        label = i % 3
        rows.append((i, label, (rng.normal(size=4) + 4 * np.eye(4)[label]).tolist()))
    return spark.createDataFrame(rows, "id long, label int, vec array<double>").cache()


@pytest.fixture(scope="module")
def labels(points):
    return points.where("id < 30").select("id", F.lit(0).alias("round"))


@pytest.mark.parametrize("name", sorted(registry.STRATEGIES))
def test_strategies_choose_unlabelled_rows(points, labels, name):
    scorer = PrototypeScorer().fit(pool.labeled(points, labels))
    features = pool.evict(points, labels)
    ids = [r["id"] for r in registry.strategy(name)(points, labels, 5, scorer, features, 1).collect()]
    assert 0 < len(ids) <= 5 and len(set(ids)) == len(ids) and min(ids) >= 30
    if "Kmeans" not in name and "KMeans" not in name:
        assert len(ids) == 5


def test_unknown_names():
    for get in (registry.strategy, registry.scorer):
        with pytest.raises(NotImplementedError):
            get("none")


def test_more_than_there_are(points, labels):
    scorer = PrototypeScorer().fit(pool.labeled(points, labels))
    assert strategies.uncertainty(points, labels, 1000, scorer, "EntropySampling").count() == 60
    with pytest.raises(ValueError):
        strategies.random_sampling(points, labels, 1000)


def test_uncertain_probabilities(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [0.75, 0.25])], "id long, p array<double>")
    for name, want in (("LeastConfidence", 0.5), ("MarginSampling", 0.0), ("EntropySampling", np.log(0.5))):
        got = {r["id"]: r["s"] for r in rows.select("id", strategies.SCORES[name](F.col("p")).alias("s")).collect()}
        assert got[1] == pytest.approx(want) and min(got, key=got.get) == 1 and max(got, key=got.get) == 2


def test_disagreement(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [0.3, 0.7]), (2, 1, [0.3, 0.7])]
    out = strategies.disagreement(spark.createDataFrame(rows, "id long, pass int, p array<double>"))
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got[1] == pytest.approx(-np.log(2)) and got[2] == pytest.approx(0)


def test_farthest_first_on_a_line(spark):
    line = spark.createDataFrame([(i, i, [float(i)]) for i in (0, 1, 2, 10, 11)], "id long, label int, vec array<double>")
    zero = spark.createDataFrame([(0, 0)], "id long, round int")
    assert [r["id"] for r in strategies.kcenter_greedy(line, zero, 2).collect()] == [11, 2]


def test_scorers_agree_on_easy_rows(points, labels):
    train = pool.labeled(points, labels)

    def by_mean(rows):
        pdf = rows.toPandas()
        means = np.stack([np.mean(np.stack(pdf[pdf.label == c].vec), axis=0) for c in range(3)])
        return [0, 1, 2], lambda x: -((x[:, None] - means[None]) ** 2).sum(axis=2)

    for scorer in (PrototypeScorer(), MLScorer(), UDFScorer(by_mean)):
        scores = loop.evaluate(scorer.fit(train), points)
        assert scores["acc"] > 0.8
        total = scorer.predict_prob(points).select(F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("t"))
        assert total.where("abs(t - 1) > 1e-9").count() == 0


def test_state(spark, points, labels):
    new = spark.createDataFrame([(40,), (40,), (3,)], "id long")
    more = pool.update(labels, new, 2)
    assert more.count() == 31 and more.where("id = 3").first()["round"] == 0
    assert pool.update(more, new, 3, new).count() == 29
    assert pool.as_of(more, 1).count() == 30
    assert pool.row_by_id(points, 7).count() == 1
    with pytest.raises(IndexError):
        pool.row_by_id(points, 700)


@pytest.mark.parametrize("start", sorted(clustering.STARTS))
def test_kmeans_finds_the_groups(points, start):
    centroids = clustering.kmeans(points, 3, 5, 2, start=start, tries=2)
    assert centroids.shape == (3, 4)
    total = clustering.assign_clusters(points, centroids).groupBy("cid").count().agg(F.sum("count")).first()[0]
    assert total == 90


def test_distances_have_names(points):
    with pytest.raises(ValueError):
        clustering.pairwise(points, points, "l1")
    with pytest.raises(ValueError):
        clustering.kmeans(points, 2, start="none")


def test_hierarchy(spark, points, tmp_path):
    levels = hierarchy.hierarchical_kmeans(points, (8, 3), 4, 1, (4, 2), 2)
    sizes = {(r["level"], r["cid"]): r["size"] for r in hierarchy.flat_sizes(levels).collect()}
    assert sum(v for (level, _), v in sizes.items() if level == 2) == 90
    for how in "rc":
        ids = [r["id"] for r in hierarchy.sample(levels, 20, how=how).collect()]
        assert len(ids) == 20 == len(set(ids))
    assert hierarchy.sample(levels, 200, multiplier=2).count() == 180
    tables.write_levels(levels, str(tmp_path / "levels"))
    assert tables.read_levels(spark, str(tmp_path / "levels"))[1].count() == levels[1].count()
    with pytest.raises(ValueError):
        hierarchy.hierarchical_kmeans(points, (8, 3), 4, 1, (4,))
    with pytest.raises(ValueError):
        hierarchy.sample(levels, -1)


@pytest.mark.parametrize(("sizes", "target", "want"), [((10, 3, 1), 7, [3, 3, 1]), ((5, 5, 5), 7, None), ((2, 2, 0), 9, [2, 2, 0])])
def test_allocation(spark, sizes, target, want):
    children = spark.createDataFrame([(0, i, s) for i, s in enumerate(sizes)], "parent long, child long, size long")
    out = hierarchy.allocate(children, spark.createDataFrame([(0, target)], "parent long, target long"), 1)
    got = [r["target"] for r in out.orderBy("child").collect()]
    assert sorted(got) == [2, 2, 3] if want is None else got == want


def test_metrics_without_a_denominator(spark):
    rows = [(1, 0, 0), (2, 1, 0), (3, 0, 2)]  # 1 is never predicted, 2 never true
    predictions = spark.createDataFrame(rows, "id long, label int, predicted int")
    got = metrics.weighted_scores(predictions).first()
    assert got["acc"] == pytest.approx(1 / 3) and got["precision"] == pytest.approx(1 / 3)
    assert metrics.confusion(predictions).count() == 9 and metrics.accuracy(predictions).first()[0] == got["acc"]


def test_reports(spark, tmp_path):
    for seed in (1, 2):
        for strategy in ("A", "B"):
            run = loop.Run("pool", strategy, seed, 5, 10, 1, {m: [0.1, 0.2 * seed] for m in ("acc", "precision", "recall", "f1")})
            results.write_run(run.result(), results.run_folder(str(tmp_path), "pool", seed, 10, 5, 1, 2, strategy))
    root = f"{tmp_path}/pool"
    os.makedirs(f"{root}/SEED_1/NQ_10_NIL_5_NR_1_NE_2/C")
    runs = results.read_runs(spark, root)
    assert runs.count() == 4
    with pytest.raises(ValueError):
        results.read_runs(spark, root, strict=True)
    long = reports.curves(runs)
    row = reports.mean_std(long).where("strategy = 'A' AND metric = 'acc'").first()
    assert row["mean"] == pytest.approx(0.3) and row["std"] == pytest.approx(0.1) and row["shown"] == "0.3000 (±0.1000)"
    assert reports.nested(long).count() == 2
    results.write_csv(reports.strategy_table(long), f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/csv").count() == 4
    with open(tmp_path / "params.json", "w") as f:
        json.dump({"pool": {"n_epoch": 3}}, f)
    assert results.hyper_parameters(str(tmp_path / "params.json"), "pool") == {"n_epoch": 3}


def test_features_are_cached(spark, points, labels, tmp_path):
    path = str(tmp_path / "features")
    assert tables.cached_features(points, path).count() == 90
    assert tables.cached_features(points.limit(0), path, labels).count() == 60
    with pytest.raises(ValueError):
        tables.checked_table(spark, path, ("X", "y"))


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(color):
        raw = b"".join(b"\0" + bytes(color) * 4 for _ in range(4))
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        head = struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    for name, color in (("a", (255, 0, 0)), ("b", (0, 0, 255))):
        os.makedirs(tmp_path / "train" / name)
        (tmp_path / "train" / name / f"{name}_1.png").write_bytes(png(color))
    (tmp_path / "train" / "b" / "broken.png").write_bytes(b"no image")
    rows = images.image_folder(spark, str(tmp_path), "train", 8).orderBy("id").collect()
    assert [(r["id"], r["name"], r["height"]) for r in rows] == [(0, "a", 8), (1, "b", 8)]
    assert bytes(rows[0]["pixels"][:3]) == b"\xff\0\0" and bytes(rows[1]["pixels"][:3]) == b"\0\0\xff"
    vectors = textures.extract_features(images.image_folder(spark, str(tmp_path), "train", 8), "ssrae")
    assert {len(r["vec"]) for r in vectors.collect()} == {756}
    assert {r["name"] for r in images.prefix_labelled(spark, str(tmp_path / "train" / "a")).collect()} == {"a"}


def test_stream(spark, points, labels, tmp_path):
    scorer = PrototypeScorer().fit(pool.labeled(points, labels))
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, scorer).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").count() == 90


def test_projection(points):
    assert len(textures.reduce_dimensions(points, 2).first()["point"]) == 2


def test_sweep(spark):
    assert loop.sweep(spark, ["A", "B"], [10, 50], [1, 2, 3]).count() == 12
