"""Numeric kernels on numpy arrays, for Arrow batches and for what is small by a checked size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a matrix that may be sent to all executors.
MAX_MATRIX_BYTES = 256 << 20


def checked(matrix: np.ndarray) -> np.ndarray:
    """The matrix, if it is small enough to go with every task."""
    if matrix.nbytes > MAX_MATRIX_BYTES:
        raise ValueError(f"a matrix of {matrix.nbytes} bytes is too large to broadcast; at most {MAX_MATRIX_BYTES}")
    return matrix


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a number: multiplications and shifts, modulo 2**64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashed_uniform(seed: int, step: int, ids: np.ndarray, width: int) -> np.ndarray:
    """For each id ``width`` numbers from 0 to below 1 that depend on seed, step and id alone."""
    base = _mixed(np.array([seed % 2**64], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step))
    row = _mixed(ids.astype(np.int64).view(np.uint64) + base)
    cell = _mixed(row[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (cell >> np.uint64(11)) * 2.0**-53


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All pairs, by expansion, never below zero."""
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.maximum(d, 0.0)


#: Centroids that are held against rows at a time.
COLUMNS = 4096


def nearest(x: np.ndarray, centroids: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equal ones, and the squared distance. At most ``block`` distances
    stand in memory at a time, however many rows and centroids there are. Products of one row with equal centroids can
    differ in their last bits, so repeated centroids are looked up."""
    columns = max(1, min(len(centroids), COLUMNS, block))
    rows = max(1, block // columns)
    norms = (centroids * centroids).sum(axis=1)
    which, how = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    for i in range(0, len(x), rows):
        part, near, least = x[i : i + rows], which[i : i + rows], how[i : i + rows]
        own = (part * part).sum(axis=1)[:, None]
        for j in range(0, len(centroids), columns):
            d = own + norms[None, j : j + columns]
            product = part @ centroids[j : j + columns].T
            product *= 2
            d -= product
            np.maximum(d, 0.0, out=d)
            at = d.argmin(axis=1)
            d = d[np.arange(len(d)), at]
            less = d < least if j else slice(None)
            near[less], least[less] = at[less] + j, d[less]
    seen: dict[bytes, int] = {}
    first = np.array([seen.setdefault(c.tobytes(), i) for i, c in enumerate(centroids + 0.0)], dtype=np.int64)
    return (first[which] if len(first) else which), how


def greedy_kmeans_plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Positions of k initial centres: each of 2 + ln k candidates, drawn by squared distance, is tried; the one that
    leaves the least potential is kept."""
    k = min(k, len(x))
    trials = 2 + int(np.log(max(k, 1)))
    chosen = [int(rng.integers(len(x)))]
    closest = squared_distances(x, x[chosen])[:, 0]
    norms = (x * x).sum(axis=1)
    while len(chosen) < k:
        cumulative = np.cumsum(closest)
        picks = np.searchsorted(cumulative, rng.random(trials) * cumulative[-1])
        picks = np.minimum(picks, len(x) - 1)
        d2 = np.maximum(norms[:, None] + norms[None, picks] - 2 * (x @ x[picks].T), 0.0)
        left = np.minimum(closest[:, None], d2)
        best = int(left.sum(axis=0).argmin())
        chosen.append(int(picks[best]))
        closest = left[:, best]
    return np.array(chosen)


def lloyd(x: np.ndarray, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(centroids, assignment, potential) after exactly so many rounds; an empty cluster keeps its centroid. Rounds after
    one in which no row moves would change nothing and are left out."""
    which, _ = nearest(x, centroids)
    for _ in range(rounds):
        centroids, before = means(x, which, centroids), which
        which, _ = nearest(x, centroids)
        if (which == before).all():
            break
    return centroids, which, float(((x - means(x, which, centroids)[which]) ** 2).sum())


def sums_by(x: np.ndarray, which: np.ndarray, k: int, rows: int = 2048) -> np.ndarray:
    """The sum of each cluster's rows: runs of rows in order of their cluster, some rows at a time."""
    out = np.zeros((k, x.shape[1]))
    for i in range(0, len(x), rows):
        order = np.argsort(which[i : i + rows], kind="stable")
        of = which[i : i + rows][order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[first]] += np.add.reduceat(x[i : i + rows][order], first, axis=0)
    return out


def gaps(x: np.ndarray, centroids: np.ndarray, which: np.ndarray, rows: int = 2048) -> float:
    """The sum of squared distances of rows to the centroids they are given, some rows at a time."""
    parts = ((x[i : i + rows] - centroids[which[i : i + rows]]).ravel() for i in range(0, len(x), rows))
    return float(sum(d @ d for d in parts))


def means(x: np.ndarray, which: np.ndarray, before: np.ndarray) -> np.ndarray:
    n = np.bincount(which, minlength=len(before))
    return np.where(n[:, None] > 0, sums_by(x, which, len(before)) / np.maximum(n, 1)[:, None], before)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, tries: int = 1):  # noqa: ANN201
    """The best of some tries by potential; k is clamped to the number of rows."""
    runs = [lloyd(x, x[greedy_kmeans_plus_plus(x, k, rng)], rounds) for _ in range(tries)]
    return min(runs, key=lambda run: run[2])
