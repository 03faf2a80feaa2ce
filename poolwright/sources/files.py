"""Small files on whatever file system a path names, through Hadoop: results, models, states of long runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes beside the path and renames, so that a reader sees the old file or the new one, never a part."""
    fs, place = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"could not write {path}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """FileNotFoundError if there is none."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order; of folders and files."""
    fs, place = _at(spark, pattern)
    return sorted(f.getPath().toString() for f in fs.globStatus(place) or [])


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def sealed(data: bytes) -> bytes:
    """The data behind its digest, so that :func:`opened` knows whether all of it is there."""
    return hashlib.sha256(data).hexdigest().encode() + b"\n" + data


def opened(data: bytes) -> bytes:
    """ValueError if the data is not what was sealed."""
    digest, _, rest = data.partition(b"\n")
    if hashlib.sha256(rest).hexdigest().encode() != digest:
        raise ValueError("damaged")
    return rest
