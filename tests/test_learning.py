"""Resumable clustering, the parallel start, discriminants, the head with dropout and saved scorers, against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolwright.functions import kernels
from poolwright.operators import clustering as c
from poolwright.operators import discriminant, resume, strategies
from poolwright.operators.head import HeadScorer
from poolwright.operators.scorers import BatchModelScorer, MLScorer, PrototypeScorer, UDFScorer
from poolwright.sources import files

K, SEED = 4, 7


def points(n=240, d=5, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 4, n)
    return label, rng.normal(size=(n, d)) + 3 * rng.normal(size=(4, d))[label]


@pytest.fixture(scope="module")
def pool(spark):
    label, x = points()
    rows = [(i, x[i].tolist(), int(label[i]) + 10, "extra") for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int, d2 string").select("id", "vec", "label").repartition(3).cache()


class Killed(Exception):
    pass


def killed_at(wanted):
    def after(phase, step):
        if (phase, step) == wanted:
            raise Killed

    return after


@pytest.mark.parametrize("place", [("start", 1), ("start", 3), ("start", 4), ("round", 0), ("round", 2)])
def test_killed_runs_go_on(spark, pool, tmp_path, place):
    want = c.kmeans(pool, K, 3, SEED, start="kmeans++")
    path = str(tmp_path / "states")
    with pytest.raises(Killed):
        resume.resumable_kmeans(pool, K, 3, SEED, path, after=killed_at(place))
    seen = []
    got = resume.resumable_kmeans(pool, K, 3, SEED, path, after=lambda phase, step: seen.append((phase, step)))
    assert np.allclose(got, want) and place not in seen and len(files.names(spark, path)) <= 2
    assert np.allclose(resume.resumable_kmeans(pool, K, 3, SEED, path, after=killed_at(("round", 3))), want)  # nothing left to do
    with pytest.raises(ValueError, match="another run"):
        resume.resumable_kmeans(pool, K + 1, 3, SEED, path)


@pytest.mark.parametrize("damage", [b"", b"no state", None])
def test_damaged_states_are_passed_over(spark, pool, tmp_path, damage):
    path = str(tmp_path / "states")
    want = resume.resumable_kmeans(pool, K, 3, SEED, path, keep=3)
    newest = files.names(spark, path)[-1]
    data = files.read_bytes(spark, f"{path}/{newest}")
    files.write_bytes(spark, f"{path}/{newest}", data[: len(data) // 2] if damage is None else damage)
    seen = []
    got = resume.resumable_kmeans(pool, K, 3, SEED, path, keep=3, after=lambda *place: seen.append(place))
    assert seen == [("round", 3)] and np.allclose(got, want)


def test_states_now_and_then_and_none(spark, pool, tmp_path):
    path = str(tmp_path / "few")
    resume.resumable_kmeans(pool, K, 5, SEED, path, every=2, start="first")
    assert resume.StateLog(spark, path).newest()[1]["step"] == 5
    empty = pool.limit(0)
    assert len(resume.resumable_kmeans(empty, K, 2, SEED, str(tmp_path / "none"))) == 0
    with pytest.raises(ValueError, match="unknown start"):
        resume.resumable_kmeans(pool, K, 2, SEED, path, start="?")


def test_plus_plus_writes_distances_now_and_then(pool, monkeypatch):
    want = c.kmeans_plus_plus(pool, 7, SEED)
    monkeypatch.setattr(c, "WRITTEN_AFTER", 2)
    assert np.allclose(c.kmeans_plus_plus(pool, 7, SEED), want)
    assert len(np.unique(want, axis=0)) == 7


def potential(pool, centres):
    return c.assign_clusters(pool, centres).agg(F.sum("d2")).first()[0]


def test_parallel_start(spark, pool):
    one, other = (c.kmeans(pool, K, 10, SEED, start=s) for s in ("kmeans||", "kmeans++"))
    assert potential(pool, one) <= 1.05 * potential(pool, other)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, [0.0, 0.0])], "id long, vec array<double>")
    assert sorted(c.kmeans_parallel(same, 4, SEED).tolist()) == [[0.0, 0.0], [1.0, 2.0]]
    assert len(c.kmeans_parallel(pool.limit(0), 3, SEED)) == 0


def by_hand(x, y, fold):
    """The discriminant of all other folds, fitted anew for each fold from its rows."""
    hits = {}
    for f in np.unique(fold):
        tx, ty = x[fold != f], y[fold != f]
        names = np.unique(ty)
        means = np.array([tx[ty == k].mean(axis=0) for k in names])
        within = sum((tx[ty == k] - m).T @ (tx[ty == k] - m) for k, m in zip(names, means)) / (len(tx) - len(names))
        scores = [
            x[fold == f] @ np.linalg.solve(within, m) - m @ np.linalg.solve(within, m) / 2 + np.log((ty == k).mean())
            for k, m in zip(names, means)
        ]
        hits[int(f)] = int((names[np.argmax(scores, axis=0)] == y[fold == f]).sum())
    return hits


def test_cross_validation(spark, pool):
    label, x = points()
    fold = np.array([int(hashlib.md5(f"{SEED}:{i}".encode()).hexdigest()[:8], 16) % 10 for i in range(len(x))])
    nulls = spark.createDataFrame([(900, None, 10), (901, [0.0] * 5, None)], "id long, vec array<double>, label int")
    rows = discriminant.cross_validated(pool.unionByName(nulls), 10, SEED).collect()
    assert {r["fold"]: r["hits"] for r in rows} == by_hand(x, label, fold)
    assert {r["fold"]: r["n"] for r in rows} == dict(enumerate(np.bincount(fold)))
    assert sum(r["hits"] for r in rows) > 0.8 * len(x)
    assert discriminant.cross_validated(pool.limit(0)).count() == 0
    flat = pool.select("id", F.concat("vec", "vec").alias("vec"), "label")  # features that depend on each other
    assert sum(r["hits"] for r in discriminant.cross_validated(flat, 10, SEED).collect()) == sum(r["hits"] for r in rows)


def trained_by_hand(x, y, ids, s):
    """The head in one loop over all rows, without Spark; gradients by differences are checked apart."""
    head = HeadScorer(**s)
    head.classes = sorted(set(y.tolist()))
    cls = np.searchsorted(head.classes, y)
    head.weights = head.start(x.shape[1])
    speed, history = [0 * w for w in head.weights], []
    for epoch in range(s["epochs"]):
        batch = np.array([int(hashlib.md5(f"{s['seed']}:{epoch}:{i}".encode()).hexdigest()[:8], 16) % s["batches"] for i in ids])
        losses, hits = [], []
        for k in range(s["batches"]):
            at = np.flatnonzero(batch == k)
            if not len(at):
                continue
            w1, b1, w2, b2 = head.weights
            kept = head.kept(ids[at], s["seed"], epoch)
            a = x[at] @ w1 + b1
            z = (np.maximum(a, 0) * kept) @ w2 + b2
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            losses.append(-np.log(p[np.arange(len(at)), cls[at]]).mean())
            hits.append((z.argmax(axis=1) == cls[at]).mean())
            dz = (p - np.eye(len(head.classes))[cls[at]]) / len(at)
            da = (dz @ w2.T) * kept * (a > 0)
            for n, g in enumerate((x[at].T @ da, da.sum(0), (np.maximum(a, 0) * kept).T @ dz, dz.sum(0))):
                speed[n] = s["momentum"] * speed[n] + g
                head.weights[n] = head.weights[n] - s["rate"] * speed[n]
        history.append((epoch + 1, np.mean(losses), np.mean(hits)))
    return head, history


@pytest.fixture(scope="module")
def settings():
    return {"hidden": 8, "epochs": 3, "batches": 3, "rate": 0.05, "momentum": 0.3, "drop": 0.5, "seed": 5}


@pytest.fixture(scope="module")
def head(pool, settings):
    return HeadScorer(**settings).fit(pool)


def test_head_learns_as_a_plain_loop_does(spark, pool, head, settings):
    label, x = points()
    want, history = trained_by_hand(x, label + 10, np.arange(len(x)), settings)
    assert all(np.allclose(a, b) for a, b in zip(head.weights, want.weights, strict=True))
    assert np.allclose([tuple(r) for r in head.summary(spark).orderBy("epoch").collect()], history)
    assert history[-1][1] < history[0][1]
    p = {r["id"]: r["p"] for r in head.predict_prob(pool).collect()}
    z = want.hidden(x) @ want.weights[2] + want.weights[3]
    assert np.allclose([p[i] for i in range(len(x))], np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))
    deep = {r["id"]: r["vec"] for r in head.embeddings(pool).collect()}
    assert np.allclose([deep[i] for i in range(len(x))], want.hidden(x))


def test_gradients_are_slopes(head):
    label, x = points()
    ids, cls = np.arange(20), label[:20].astype(np.int64)
    _, _, slopes = head.gradients(ids, cls, x[:20], 1)
    for w, g in zip(head.weights, slopes, strict=True):
        at = (0,) * w.ndim
        kept, w[at] = w[at], w[at] + 1e-6
        up = head.gradients(ids, cls, x[:20], 1)[0]
        w[at] = kept - 1e-6
        down = head.gradients(ids, cls, x[:20], 1)[0]
        w[at] = kept
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_passes_with_dropout(spark, pool, head):
    once, again = (head.predict_prob_passes(pool.repartition(n), 6, 2).collect() for n in (1, 5))
    assert {(r["id"], r["pass"]): tuple(r["p"]) for r in once} == {(r["id"], r["pass"]): tuple(r["p"]) for r in again}
    assert len(once) == 6 * pool.count() and abs(sum(once[0]["p"]) - 1) < 1e-9
    masks = kernels.hashed_uniform(1, 2, np.arange(4000), 10)
    assert abs(masks.mean() - 0.5) < 0.01 and abs(np.corrcoef(masks.T) - np.eye(10)).max() < 0.06
    labels = pool.where("id % 5 = 0").select("id", F.lit(0).alias("round"))
    picked = strategies.bald(pool, labels, 7, head, passes=6)
    assert picked.count() == 7 and picked.where("id % 5 = 0").count() == 0
    assert strategies.kmeans_sampling(pool, labels, 5, 3, scorer=head).count() == 5
    assert HeadScorer().fit(pool.limit(0)).classes == []


@pytest.mark.parametrize("kind", ["prototype", "logistic", "head"])
def test_saved_scorers(spark, pool, head, tmp_path, kind):
    scorer = {"prototype": lambda: PrototypeScorer(0.7).fit(pool), "logistic": lambda: MLScorer().fit(pool), "head": lambda: head}[kind]()
    path = str(tmp_path / kind)
    for _ in range(2):  # the second replaces the first
        scorer.save(spark, path)
    loaded = type(scorer).load(spark.newSession(), path)
    assert loaded.classes == scorer.classes == [10, 11, 12, 13]
    rows = lambda s: np.array([r["p"] for r in s.predict_prob(pool).orderBy("id").collect()])
    assert (rows(loaded) == rows(scorer)).all()
    data = files.read_bytes(spark, f"{path}/scorer")
    files.write_bytes(spark, f"{path}/scorer", data[:-3])
    with pytest.raises(ValueError, match="damaged"):
        type(scorer).load(spark, path)


def test_models_of_users(spark, pool):
    class Doubling:
        """Stands for a user's model; counts how often it is loaded."""

        def __init__(self):
            loads.add(1)

        def embeddings(self, x):
            return 2 * x

        def scores(self, x):
            return self.embeddings(x) @ np.arange(15.0).reshape(5, 3)

    _, x = points()
    loads = spark.sparkContext.accumulator(0)
    scorer = BatchModelScorer(Doubling, [3, 5, 8], 5, batch_size=7).fit(pool)
    z = 2 * x @ np.arange(15.0).reshape(5, 3)
    got = {r["id"]: r["p"] for r in scorer.predict_prob(pool.coalesce(1)).collect()}
    assert np.allclose([got[i] for i in range(len(x))], np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))
    assert 1 <= loads.value < len(x) / 7  # not for each batch
    calls = {r["id"]: r["predicted"] for r in scorer.predict(pool).collect()}
    assert [calls[i] for i in range(len(x))] == [[3, 5, 8][k] for k in z.argmax(axis=1)]
    deep = {r["id"]: r["vec"] for r in scorer.embeddings(pool).collect()}
    assert np.allclose([deep[i] for i in range(len(x))], 2 * x)
    labels = pool.where("id % 5 = 0").select("id", F.lit(0).alias("round"))
    assert strategies.kmeans_sampling(pool, labels, 5, 3, scorer=scorer).count() == 5
    assert scorer.predict_prob(pool.limit(0)).count() == 0


def test_what_cannot_be_saved(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        UDFScorer(lambda rows: ([], len)).save(spark, str(tmp_path / "x"))
    with pytest.raises(FileNotFoundError):
        PrototypeScorer.load(spark, str(tmp_path / "nothing"))
