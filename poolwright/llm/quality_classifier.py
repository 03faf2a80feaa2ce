"""A quality score learned from preferences between documents (Bradley-Terry), and a verdict by score quantile."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most: those with the least hashed ids. Their number bounds what is
#: broadcast and what the driver gets.
TRAIN_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
SEED = 11
RIDGE = 1e-3
#: The score that the quantile is mapped to, from which a document is predicted good.
THRESHOLD = 0.3
FOLDS = 5

#: Numbers that a text's words, and its bytes in threes, are hashed to.
WORD_BINS, BYTE_BINS = 128, 128
COUNTS = (
    "log_words", "word_length", "symbols", "exclamations", "capital_words", "digits", "stops", "distinct_words",
    "same_as_last", "same_lines", "words_per_line", "short_words", "same_pairs", "letters",
)
WIDTH = len(COUNTS) + WORD_BINS + BYTE_BINS
#: Pairs that are looked at together when the model is fitted.
PAIRS_TOGETHER = 20_000


def text_features(text: str) -> np.ndarray:
    """WIDTH numbers about one whole text: COUNTS, and what it is made of. An empty text has its own, mostly zeros."""
    return np.concatenate([text_counts(text), word_shares(text), byte_shares(text)])


def _shares(bins: np.ndarray, n: int) -> np.ndarray:
    """Square roots of the shares of the bins."""
    return np.sqrt(np.bincount(bins, minlength=n) / max(1, len(bins)))


def word_shares(text: str) -> np.ndarray:
    """How a text's words, in lower case, are spread over bins."""
    hashes = np.fromiter(map(crc32, text.lower().encode("utf-8", "replace").split()), dtype=np.int64)
    return _shares(hashes % WORD_BINS, WORD_BINS)


def byte_shares(text: str) -> np.ndarray:
    """How every three bytes in a row of a text are spread over bins; a long text is read in parts."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(BYTE_BINS)
    for i in range(0, max(0, len(data) - 2), 1 << 20):
        part = data[i : i + (1 << 20) + 2].astype(np.uint32)
        hashes = ((part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        counts += np.bincount(hashes % BYTE_BINS, minlength=BYTE_BINS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def text_counts(text: str) -> list[float]:
    """Numbers about one whole text, in the order of COUNTS."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    stripped = sum(map(len, words))
    return [
        np.log1p(len(words)),
        np.log1p(stripped / n),
        np.log1p(sum(map(text.count, "#*$%&|<>")) / n),
        np.log1p(text.count("!") / n),
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, "0123456789")) / chars,
        np.log1p((text.count(".") + text.count(",")) / n),
        np.log1p(len(set(words))) / np.log1p(n),
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(len(w) <= 3 for w in words) / n,
        1 - (len(set(zip(words, words[1:], strict=False))) + 1) / n,
        stripped / chars,
    ]


class BradleyTerry:
    """score(x) = logistic(strength(x) - cut + logit(THRESHOLD)), strength linear in standardised features.

    A good document is preferred to a bad one with probability logistic(strength difference). The cut is the quantile
    of the training strengths at the share of bad ones, so about as many are predicted bad as are.
    """

    def __init__(self, x: np.ndarray, good: np.ndarray, seed: int = SEED):
        width = WIDTH
        x = x.reshape(-1, width)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(width)
        spread = x.std(axis=0) if len(x) else np.ones(width)
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        self.weights, self.cut = np.zeros(width), 0.0
        share = good.mean() if len(good) else 0.5
        if not len(good) or not 0 < share < 1:  # nothing to prefer: every score is the threshold if all are good, below it if none is
            self.cut = 0.0 if share else 1.0
            return
        z = self._standard(x)
        rng = np.random.default_rng(seed)
        better, worse = np.flatnonzero(good), np.flatnonzero(~good)
        self.weights = self._fit(z, rng.choice(better, PAIRS), rng.choice(worse, PAIRS))
        self.cut = float(np.quantile(z @ self.weights, 1 - share))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    @staticmethod
    def _fit(z: np.ndarray, better: np.ndarray, worse: np.ndarray) -> np.ndarray:
        """Newton's method on the mean logistic loss of the pairs' feature differences, with a ridge."""
        w = np.zeros(z.shape[1])
        for _ in range(30):
            gradient, curve = RIDGE * w, RIDGE * np.eye(len(w))
            for i in range(0, len(better), PAIRS_TOGETHER):
                d = z[better[i : i + PAIRS_TOGETHER]] - z[worse[i : i + PAIRS_TOGETHER]]
                p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                gradient = gradient - d.T @ (1 - p) / len(better)
                curve = curve + (d * (p * (1 - p))[:, None]).T @ d / len(better)
            step = np.linalg.solve(curve, gradient)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = self._standard(x.reshape(-1, WIDTH)) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(strength, -500, 500)) * (1 - THRESHOLD) / THRESHOLD)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """good, text -> good, features."""
    for batch in batches:
        rows = [text_features(text.as_py() or "").astype(np.float32) for text in batch.column(1)]
        yield pa.record_batch(
            [batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["good", "features"]
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> BradleyTerry:
    """A model from at most ``train_rows`` labelled rows outside the held-out fold.

    These labels are few and bounded, so they are broadcast and no text is shuffled; only features reach the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good"))
        .where("id IS NOT NULL AND good IS NOT NULL")
        .where(~held_out("id"))
        .orderBy(F.xxhash64("id"), "id", "good")
        .limit(train_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("good", "text")
    features = rows.mapInArrow(_features, "good boolean, features array<float>")
    sample = features.limit(train_rows).toArrow()  # rows that share an id may be more
    x = np.concatenate([c.flatten().to_numpy() for c in sample.column("features").chunks] or [np.zeros(0)])
    x = x.astype(np.float64).reshape(-1, WIDTH)
    order = np.lexsort(x[:, : len(COUNTS)].T)  # however the rows came
    return BradleyTerry(x[order], np.array(sample.column("good").to_pylist(), dtype=bool)[order])


def held_out(id_col: str):  # noqa: ANN201
    """Whether an id is in the fold that is never learned from: crc32 of its text modulo 5 is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def score_documents(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, held_out, score (0 to 1, higher: better), predicted (1 from THRESHOLD on).

    Null and empty texts get the score of an empty text. A null id is not held out. Repeated rows are scored alike. An
    empty table gives an empty result. Only the text is an input of a score; other columns are not read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(text.as_py() or "") for text in batch.column(1)]).reshape(-1, WIDTH)
            yield pa.record_batch([batch.column(0), pa.array(model.score(x), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"id {kind}, score double")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out("id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
