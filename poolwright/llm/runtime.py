"""Where intermediate tables live, and the few expressions that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters.
WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may leave that unset (tests on one machine): a
    temporary folder is then made once for the session and remembered in the session's own settings.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("poolwright.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="poolwright-")
        spark.conf.set("poolwright.shared.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/poolwright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Parts that the rows of one key are dealt to in :func:`dealt_join`.
SALTS = 8


def dealt_join(many: DataFrame, few: DataFrame, on: str, by: Column, how: str = "inner") -> DataFrame:
    """A join on ``on`` in which the rows of a frequent key of ``many`` are dealt to ``SALTS`` parts, by ``by``.

    Every row of ``few`` goes to each part, so pairs are those of the plain join.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    many = many.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return many.join(few.withColumn("__part", parts), [on, "__part"], how).drop("__part")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def count_words(text: Column) -> Column:
    """How many words a text has (long), without a list of them; 0 for null."""
    white, word = WHITE.replace("+", "*+"), WHITE.replace("[", "[^").replace("+", "++")
    marks = F.regexp_replace(text, white + word + white, "x")
    return F.when(text.rlike(word), F.length(marks).cast("long")).otherwise(F.lit(0).cast("long"))


def give_back() -> None:
    """Lets a Python worker that may now idle give memory that it has freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast path: there lower() does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
