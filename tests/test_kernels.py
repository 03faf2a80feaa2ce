"""Numeric kernels and texture features against plain numpy."""

import tracemalloc

import numpy as np
import pytest

from poolwright.functions import kernels
from poolwright.operators import textures
from poolwright.operators.hierarchy import best_cut


def test_distances_and_nearest():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(7, 5))
    want = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    assert np.allclose(kernels.squared_distances(x, y), want)
    which, d2 = kernels.nearest(x, y, block=14)
    assert (which == want.argmin(axis=1)).all() and np.allclose(d2, want.min(axis=1))


def test_nearest_of_many_centroids_in_little_memory():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3000, 2)), rng.normal(size=(6000, 2))
    y[5000] = y[17]  # of equal ones the first
    x[7] = y[17]
    tracemalloc.start()
    which, d2 = kernels.nearest(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # all distances are 144 MB
    for i in (0, 7, 2999):
        want = ((x[i] - y) ** 2).sum(axis=1)
        assert which[i] == want.argmin() and abs(d2[i] - want.min()) < 1e-12


def test_lloyd_keeps_empty_clusters():
    x = np.array([[0.0], [1.0], [10.0]])
    centroids, which, cost = kernels.lloyd(x, np.array([[0.0], [10.0], [500.0]]), 3)
    assert which.tolist() == [0, 0, 1] and centroids[2, 0] == 500.0 and cost == pytest.approx(0.5)


def test_kmeans_clamps_k():
    x = np.array([[0.0], [5.0]])
    centroids, which, cost = kernels.kmeans(x, 9, 2, np.random.default_rng(1))
    assert len(centroids) == 2 and cost == 0 and len(set(which)) == 2


def test_first_of_equal_centroids():
    rng = np.random.default_rng(0)
    for _ in range(20):
        centroids = rng.normal(size=(5, 64))
        centroids[4], centroids[3] = centroids[0], centroids[1]
        for n in (1, 3, 7, 100):
            assert kernels.nearest(rng.normal(size=(n, 64)), centroids)[0].max() < 3


def test_matrices_are_checked(monkeypatch):
    monkeypatch.setattr(kernels, "MAX_MATRIX_BYTES", 8)
    with pytest.raises(ValueError):
        kernels.checked(np.zeros((2, 2)))


@pytest.mark.parametrize(("sizes", "target", "cut"), [((10, 3, 1), 7, 3), ((5, 5, 5), 7, 2), ((2, 2), 9, 2), ((), 3, 0)])
def test_best_cut(sizes, target, cut):
    assert best_cut(list(sizes), target) == cut


def test_best_cut_guards():
    with pytest.raises(ValueError):
        best_cut([1], -1)
    with pytest.raises(ValueError):
        best_cut([-1], 1)


def test_windows_pad_edges():
    image = np.arange(6.0).reshape(2, 3)
    out = textures.windows(image)
    assert out.shape == (6, 9) and out[0].tolist() == [0, 0, 1, 0, 0, 1, 3, 3, 4]


def test_texture_sizes():
    image = np.random.default_rng(2).integers(0, 256, size=(8, 8, 3))
    assert textures.ssrae(image).shape == (756,) and textures.vctex(image).shape == (648,)
    assert np.isfinite(textures.ssrae(np.full((8, 8, 3), 7))).all()
    for bad in (np.zeros((8, 8)), np.zeros((8, 8, 4))):
        with pytest.raises(ValueError):
            textures.ssrae(bad)


def test_hidden_weights_are_single_precision():
    weights = textures.hidden_weights(17, 27)
    assert weights.dtype == np.float32 and weights.shape == (17, 28)
    length = 17 * 28
    v = [np.float32(length + 1)]
    for _ in range(4):
        step = np.float32(np.float32(length + 2) * v[-1]) + np.float32(length + 3)
        v.append(np.mod(np.float32(step), np.float32(length * length)))
    spread = np.diff(weights.ravel()[:5]) / np.diff(np.array(v))
    assert np.allclose(spread, spread[0], rtol=1e-3)


def test_output_weights_solve_the_ridge():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(9, 40)), rng.normal(size=(9, 40))
    beta = textures.output_weights(x, y, 5, 1e-3)
    bias = -np.ones((1, 40))
    z = np.vstack([bias, 1 / (1 + np.exp(-(textures.hidden_weights(5, 9).astype(float) @ np.vstack([bias, x]))))])
    assert np.allclose(beta @ (z @ z.T + 1e-3 * np.eye(6)), y @ z.T)
    assert textures.output_weights(x, y, 5, None).shape == (9, 6)
