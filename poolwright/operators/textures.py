"""Texture features of images: the weights of small randomised autoencoders, fitted to 3x3 windows of each image."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SSRAE_HIDDEN = 13
VCTEX_HIDDEN = (5, 17)


def checked_image(image: np.ndarray) -> np.ndarray:
    """ValueError unless the image is height x width x 3."""
    if image.ndim != 3 or image.shape[2] != 3:
        raise ValueError(f"an image of shape (height, width, 3) is needed, not {image.shape}")
    return image


def windows(channel: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The window about each pixel as a row; beyond the border the edge repeats."""
    padded = np.pad(channel, size // 2, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).reshape(-1, size * size)


@cache
def hidden_weights(q: int, p: int) -> np.ndarray:
    """The fixed pseudo-random weights, q x (p + 1): a linear congruential sequence in single precision, standardised.

    With L = q (p + 1): v0 = L + 1, then v = ((L + 2) v + (L + 3)) mod L², every step rounded to float32.
    """
    length = q * (p + 1)
    one = np.float32
    v = np.zeros(length, dtype=np.float32)
    v[0] = length + 1
    for i in range(1, length):
        v[i] = np.mod(one(one(one(length + 2) * v[i - 1]) + one(length + 3)), one(length * length))
    out = ((v - v.mean()) / v.std(ddof=1)).reshape(q, p + 1)
    out.setflags(write=False)
    return out


def standardized(rows: np.ndarray) -> np.ndarray:
    """Each row less its mean, over its sample deviation plus 1e-3."""
    return (rows - rows.mean(axis=1, keepdims=True)) / (rows.std(axis=1, ddof=1, keepdims=True) + 1e-3)


def output_weights(x: np.ndarray, y: np.ndarray, q: int, ridge: float | None) -> np.ndarray:
    """Weights from the hidden layer to y: ridge regression on sigmoid activations, each with a bias of -1; without a
    ridge by least squares."""
    bias = -np.ones((1, x.shape[1]))
    z = 1 / (1 + np.exp(-(hidden_weights(q, len(x)).astype(np.float64) @ np.vstack([bias, x]))))
    z = np.vstack([bias, z])
    if ridge is None:
        return np.linalg.lstsq(z.T, y.T, rcond=None)[0].T
    return np.linalg.solve(z @ z.T + ridge * np.eye(len(z)), z @ y.T).T


def ssrae(image: np.ndarray, q: int = SSRAE_HIDDEN) -> np.ndarray:
    """54 (q + 1) values: each channel predicts itself, and red green, green blue, blue red."""
    image = checked_image(image).astype(np.float64)
    red, green, blue = (standardized(windows(image[:, :, c]).T) for c in range(3))
    pairs = ((red, red), (green, green), (blue, blue), (red, green), (green, blue), (blue, red))
    return np.hstack([output_weights(x, y, q, 1e-3) for x, y in pairs]).reshape(-1).astype(np.float32)


def vctex(image: np.ndarray, hidden: tuple[int, ...] = VCTEX_HIDDEN) -> np.ndarray:
    """27 (q + 1) values for each q: the standardised windows of all channels predict the raw ones."""
    image = checked_image(image).astype(np.float64)
    raw = np.vstack([windows(image[:, :, c]).T for c in range(3)])
    x = standardized(raw)
    return np.concatenate([output_weights(x, raw, q, 1e3).reshape(-1) for q in hidden]).astype(np.float32)


EXTRACTORS = {"ssrae": ssrae, "vctex": vctex}


def feature_key(extractor: str) -> str:
    """A name for an extractor with its parameters, for caches; KeyError for an unknown one."""
    hidden = {"ssrae": (SSRAE_HIDDEN,), "vctex": VCTEX_HIDDEN}[extractor]
    return f"{extractor}-w{WINDOW}-q{'-'.join(map(str, hidden))}"


def extract_features(images: DataFrame, extractor: str = "ssrae") -> DataFrame:
    """(id, vec array<float>) from (id, height, width, pixels): pixels are bytes, RGB by row. Rows are independent.

    KeyError for an unknown extractor, ValueError for pixels that are not height x width x 3.
    """
    function = EXTRACTORS[extractor]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for height, width, pixels in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                flat = np.frombuffer(pixels, dtype=np.uint8)
                if len(flat) != height * width * 3:
                    raise ValueError(f"{len(flat)} bytes are no image of {height} x {width} x 3")
                vectors.append(function(flat.reshape(height, width, 3)))
            yield pa.record_batch([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "vec"])

    return images.select("id", "height", "width", "pixels").mapInArrow(extracted, "id long, vec array<float>")


def reduce_dimensions(features: DataFrame, k: int = 2) -> DataFrame:
    """(id, point): principal components, for plots."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    rows = features.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="c").fit(rows)
    return model.transform(rows).select("id", vector_to_array("c").alias("point"))
