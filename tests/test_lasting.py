"""Draws by weight, feature tables, hierarchies of tables, files and roll-ups of experiments."""

import hashlib
import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwright.functions import kernels
from poolwright.operators import draws, hierarchy, reports
from poolwright.sources import files, results
from poolwright.sources.features import FeatureTable


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_weighted_draws(spark, ranges):
    rng = np.random.default_rng(4)
    ids, weights = rng.permutation(50) * 3 - 20, rng.integers(0, 9, 50).astype(float)
    rows = [(int(i), float(w), 5) for i, w in zip(ids, weights)] + [(None, 4.0, 5), (1000, None, 5), (1001, -2.0, 5)]
    df = spark.createDataFrame(rows, "id long, weight double, range int")
    order = np.argsort(ids)
    order = order[weights[order] > 0]
    high = np.cumsum(weights[order])
    want = {}
    for k in range(300):
        place = int(hashlib.md5(f"9:{k}".encode()).hexdigest()[:12], 16) / 2.0**48 * high[-1]
        want[k] = int(ids[order[np.searchsorted(high, place, "right")]])
    assert {r["draw"]: r["id"] for r in draws.weighted_draws(df, 300, 9, ranges).collect()} == want
    assert draws.weighted_draws(df.limit(0), 5, 9, ranges).count() == 0


def test_places_at_the_edges(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 3.0), (3, 1.0)], "id long, weight double")
    places = spark.createDataFrame([(0, 0.0), (1, 1.9), (2, 2.0), (3, 4.9), (4, 5.999), (5, 6.0), (6, 99.0), (7, -1.0), (8, 2.0)], "draw long, place double")
    for ranges in (1, 4):
        found = {r["draw"]: r["id"] for r in draws.look_up(draws.running_sums(df, ranges), places).collect()}
        assert found == {0: 1, 1: 1, 2: 3, 3: 3, 4: 3, 5: None, 6: None, 7: 1, 8: 3}
    none = draws.look_up(draws.running_sums(df.limit(0)), places).collect()
    assert len(none) == 9 and not any(r["id"] for r in none)


def counted(spark):
    """An extractor that says how many rows it was given."""
    given = spark.sparkContext.accumulator(0)

    def extract(rows):
        def each(batches):
            for batch in batches:
                given.add(batch.num_rows)
                yield batch

        return rows.select("id", F.array(F.col("id").cast("double")).alias("vec")).mapInArrow(each, "id long, vec array<double>")

    return extract, given


def test_feature_tables_grow(spark, tmp_path):
    extract, given = counted(spark)
    rows = spark.range(40).union(spark.createDataFrame([(None,)], "id long"))
    table = FeatureTable(spark, str(tmp_path), "images", "one", size=3)
    assert table.read() is None
    assert table.refresh(rows.where("id < 10 OR id IS NULL"), extract)[1] == 10
    again = FeatureTable(spark, str(tmp_path), "images", "one", size=3)  # another session of work
    assert again.refresh(rows.where("id < 10"), extract)[1] == 0 and given.value == 10
    features, fresh = again.refresh(rows, extract)
    assert (fresh, given.value, features.count()) == (30, 40, 40)
    assert {r["id"]: r["vec"] for r in features.collect()} == {i: [float(i)] for i in range(40)}
    other = FeatureTable(spark, str(tmp_path), "images", "one", size=4)
    assert other.path != table.path and other.read() is None
    assert other.refresh(rows.limit(0), extract)[0].count() == 0


@pytest.mark.parametrize("broken", ["no mark", "bad mark", "rows missing", "no table"])
def test_broken_parts_are_done_again(spark, tmp_path, broken):
    extract, given = counted(spark)
    table = FeatureTable(spark, str(tmp_path), "images", "one")
    table.refresh(spark.range(6), extract)
    table.refresh(spark.range(9), extract)
    part = f"{table.path}/{table.parts()[-1]}"
    if broken == "no mark":
        files.delete(spark, f"{part}.mark")
    elif broken == "bad mark":
        files.write_bytes(spark, f"{part}.mark", b"3")
    elif broken == "rows missing":
        spark.range(1).select("id", F.array(F.lit(0.0)).alias("vec")).write.mode("overwrite").parquet(part)
    else:
        files.delete(spark, part)
    table = FeatureTable(spark, str(tmp_path), "images", "one")
    assert table.read().count() == 6
    features, fresh = table.refresh(spark.range(9), extract)
    assert (fresh, features.count(), given.value) == (3, 9, 12)


def lloyd(x, centres, rounds):
    for _ in range(rounds):
        which = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[which == k].mean(axis=0) if (which == k).any() else c for k, c in enumerate(centres)])
    return centres, ((x[:, None] - centres[None]) ** 2).sum(axis=2)


def first(ids, k, seed):
    return sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest(), ids[i]))[:k]


def test_hierarchy_of_tables(spark):
    x = np.random.default_rng(2).normal(size=(90, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    levels = hierarchy.hierarchical_kmeans(df, (9, 3), 4, 5, (3, 2), 2, start="seeded")
    points = x
    for level, k, size in zip(levels, (9, 3), (3, 2)):
        ids = np.arange(len(points))
        centres, _ = lloyd(points, points[first(ids, k, 5)], 4)
        for _ in range(2):
            d2 = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
            which = d2.argmin(axis=1)
            take = np.array(sorted(i for c in range(k) for i in sorted(ids[which == c], key=lambda i: (d2[i, c], i))[:size]))
            centres, _ = lloyd(points[take], points[take[first(take, k, 5)]], 4)
        d2 = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        got = {r["child"]: (r["cid"], r["d2"]) for r in level.collect()}
        assert [got[i][0] for i in ids] == d2.argmin(axis=1).tolist()
        assert np.allclose([got[i][1] for i in ids], d2.min(axis=1))
        points = centres
    with pytest.raises(ValueError, match="unknown start"):
        hierarchy.hierarchical_kmeans(df, (9,), 4, start="x")


def test_large_samples_stay_tables(spark, monkeypatch):
    """What a driver's matrix may not hold no longer ends the run."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)], "id long, vec array<double>")
    monkeypatch.setattr(kernels, "MAX_MATRIX_BYTES", 1000)
    levels = hierarchy.hierarchical_kmeans(df, (12, 3), 3, 1, (8, 2), 2)
    assert levels[0].count() == 60 and levels[1].count() <= 12


def run(strategy, seed, n_query, last):
    curve = [0.1, last]
    return {"dataset_name": "d", "strategy_name": strategy, "n_init_labeled": 5, "n_query": n_query, "n_round": 1, "seed": seed, "all_acc": curve,
            "all_precision": curve, "all_recall": curve, "all_f1_score": curve, "rounds": [0, 1]}


RUNS = [("A", 1, 5, 0.5), ("A", 2, 5, 0.7), ("B", 1, 5, 0.25), ("A", 1, 10, 0.9), ("B", 1, 10, None)]


@pytest.fixture
def experiment(spark, tmp_path):
    for strategy, seed, n, last in RUNS:
        results.write_run(run(strategy, seed, n, last), f"{tmp_path}/SEED_{seed}/NQ_{n}/{strategy}")
    return results.read_runs(spark, str(tmp_path), strict=True)


def test_experiments_are_rolled_up(experiment):
    out = reports.rolled_up(reports.curves(experiment)).where("metric = 'f1'").collect()
    want = defaultdict(list)
    for strategy, seed, n, last in RUNS:
        for names in reports.ROLLED:
            key = tuple({"seed": seed, "n_query": n, "strategy": strategy}[c] if c in names else None for c in ("seed", "n_query", "strategy"))
            want[",".join(names), *key] += [last] if last is not None else []
    got = {(r["over"], r["seed"], r["n_query"], r["strategy"]): (r["runs"], r["mean"], r["std"], r["least"], r["greatest"]) for r in out}
    assert got.keys() == {k for k, v in want.items() if v}
    for key, values in got.items():
        v = want[key]
        assert np.allclose(values, (len(v), np.mean(v), np.std(v), min(v), max(v)))
    assert reports.rolled_up(reports.curves(experiment.limit(0))).count() == 0


def test_experiments_are_written(spark, experiment, tmp_path):
    for _ in range(2):
        results.write_experiment(experiment, f"{tmp_path}/out")
    json_rows = spark.read.json(f"{tmp_path}/out/data_experiment_json")
    assert sorted((r["strategy"], r["seed"], r["n_query"]) for r in json_rows.collect()) == sorted(r[:3] for r in RUNS)
    assert len(files.matching(spark, f"{tmp_path}/out/data_experiment_csv/seed=1/n_query=5/*.csv")) == 1
    csv = spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/out/data_experiment_csv")
    assert {(r["strategy"], r["seed"], r["n_query"], r["all_acc"]) for r in csv.collect()} == {(s, i, n, None if v is None else str(v)) for s, i, n, v in RUNS}
    files.write_bytes(spark, f"{tmp_path}/SEED_9/NQ_1/A/other", b"")
    with pytest.raises(ValueError, match=r"no results\.json"):
        results.read_runs(spark, str(tmp_path), strict=True)


def test_files(spark, tmp_path):
    path = f"{tmp_path}/a/b/c"
    for data in (b"", b"\x00\xff" * 70_000, "é".encode()):
        files.write_bytes(spark, path, data)
        assert files.read_bytes(spark, path) == data
    assert files.names(spark, f"{tmp_path}/a/b") == ["c"] and files.names(spark, f"{tmp_path}/no") == []
    with pytest.raises(FileNotFoundError):
        files.read_bytes(spark, f"{path}.no")
    assert files.opened(files.sealed(b"x\ny")) == b"x\ny"
    for bad in (b"", b"x", files.sealed(b"x")[:-1] + b"z"):
        with pytest.raises(ValueError, match="damaged"):
            files.opened(bad)
    files.write_bytes(spark, f"{tmp_path}/p.json", json.dumps({"d": {"k": 1}}).encode())
    assert results.hyper_parameters(f"{tmp_path}/p.json", "d") == {"k": 1}
    with pytest.raises(KeyError):
        results.hyper_parameters(f"{tmp_path}/p.json", "e")
