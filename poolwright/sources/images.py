"""Image folders <root>/<split>/<class>/<file>, resized, as rows of RGB bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import cut

#: Side in pixels that the image sets of each name are resized to: fixed values.
SIZES = {"daninhas": 128, "cifar10": 32}


def image_folder(spark: SparkSession, root: str, split: str, size: int | None = None) -> DataFrame:
    """(id, name, path, height, width, pixels) of every readable image; unreadable ones are dropped.

    ids count from 0 in order of path within the split. ``name`` is the class folder. Pixels are interleaved RGB. With
    ``size`` images are resized to that side, to the nearest source pixel.
    """
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True)
    rows = read.load(f"{root}/{split}").select(
        F.col("image.origin").alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    kind = "path string, height int, width int, pixels binary"
    rows = rows.mapInPandas(lambda parts: _rgb(parts, size), kind)
    ordered = rows.repartitionByRange("path").sortWithinPartitions("path")
    numbered = _numbered(cut(ordered))  # written once: ranges are sampled anew each time they are made
    name = F.element_at(F.split("path", "/"), -2)
    return numbered.select("id", name.alias("name"), "path", "height", "width", "pixels")


def _numbered(ordered: DataFrame) -> DataFrame:
    """Consecutive ids over range partitions: a small count per partition gives each its offset."""
    from pyspark.sql import Window

    marked = ordered.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    paths = marked.select("path", "part", "row")
    sizes = paths.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("part", "first", before.alias("before"))
    return marked.join(F.broadcast(offsets), "part").withColumn("id", F.col("row") - F.col("first") + F.col("before"))


def _rgb(parts, size):  # noqa: ANN001, ANN202
    import numpy as np

    for pdf in parts:
        out = []
        for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
            image = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
            image = np.repeat(image, 3, axis=2) if c == 1 else image[:, :, 2::-1]  # stored as BGR
            if size:
                rows, columns = (np.arange(size) * n // size for n in (h, w))
                image = image[rows][:, columns]
            out.append((image.shape[0], image.shape[1], np.ascontiguousarray(image).tobytes()))
        pdf = pdf.assign(height=[o[0] for o in out], width=[o[1] for o in out], pixels=[o[2] for o in out])
        yield pdf[["path", "height", "width", "pixels"]]


def prefix_labelled(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,bmp,tif,tiff}") -> DataFrame:
    """(path, name, content): files of given endings; the name is the file's up to the first underscore."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.split(F.element_at(F.split("path", "/"), -1), "_")[0]
    return files.select("path", name.alias("name"), "content")
