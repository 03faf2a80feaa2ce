"""Feature tables that last: what was extracted once is read, only new rows are extracted."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from . import files


class FeatureTable:
    """Features of one table by one extractor with its parameters, in a folder that these three name.

    A refresh writes the features of rows that are not there yet as one more part, then a sealed mark with its number of
    rows. A part without a readable mark, or whose rows are not as many, is what a broken run left: it is not read, and
    the next refresh removes it and extracts its rows again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, table: str, extractor: str, **parameters: object):
        said = json.dumps([table, extractor, parameters], sort_keys=True)
        self.spark, self.path = spark, f"{root.rstrip('/')}/{extractor}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"
        self._good: dict[str, int] = {}

    def parts(self) -> list[str]:
        """Names of the parts that are whole."""
        found = files.names(self.spark, self.path)
        for name in (n for n in found if n.startswith("part-") and f"{n}.mark" in found and n not in self._good):
            try:
                rows = json.loads(files.opened(files.read_bytes(self.spark, f"{self.path}/{name}.mark")))
                if self.spark.read.parquet(f"{self.path}/{name}").count() == rows:
                    self._good[name] = rows
            except (ValueError, PySparkException):  # a broken mark, or files that Parquet cannot read
                continue
        return sorted(n for n in found if n in self._good)

    def read(self) -> DataFrame | None:
        """All features so far; None if there are none."""
        paths = [f"{self.path}/{name}" for name in self.parts()]
        return self.spark.read.parquet(*paths) if paths else None

    def refresh(self, rows: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """The features of all (id, ...) rows ever given, and how many were extracted now.

        ``extract`` turns rows into (id, vec); a row whose id has features already is not given to it. If nothing is
        new, nothing is written. Rows with a null id have no features.
        """
        good, number = set(self.parts()), 0
        for name in files.names(self.spark, self.path):
            part = name.removesuffix(".mark")
            number = max(number, int(part.removeprefix("part-")) + 1) if part.removeprefix("part-").isdigit() else number
            if part not in good:
                files.delete(self.spark, f"{self.path}/{name}")
        known = self.read()
        rows = rows.where("id IS NOT NULL")
        fresh = rows if known is None else rows.join(known.select("id"), "id", "left_anti")
        if known is not None and fresh.isEmpty():
            return known, 0
        name = f"part-{number:06d}"
        extract(fresh).write.mode("overwrite").parquet(f"{self.path}/{name}")
        written = self.spark.read.parquet(f"{self.path}/{name}").count()
        files.write_bytes(self.spark, f"{self.path}/{name}.mark", files.sealed(json.dumps(written).encode()))
        self._good[name] = written
        return self.read(), written
