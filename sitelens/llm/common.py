"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is exactly these characters; all else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one bitmap, as Spark's bitmap functions make them.
_BITS_A_ROW = 8 * 4096


def memory_goes_back() -> None:
    """Returns to the system what this Python worker no longer uses.

    Workers serve one stage after the other, and allocators keep what the largest batch of any of them took.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def words(text: Column) -> Column:
    """Words of a text, unchanged; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where all of Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir")


@contextmanager
def finished_shuffles_go(spark: SparkSession):
    """Spark deletes the shuffle files of the actions inside as soon as each of them has ended."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int | None):
    """Actions inside hand Python at most ``rows`` rows at a time; an executor and its workers hold a batch of whole texts several times over."""
    before = spark.conf.get(_BATCH)
    if rows and not 0 < int(before) <= rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Scratch:
    """Tables written in the shared folder to cut lineage, and deleted when nothing needs them any more.

    Executors that are lost later cost no recomputation of what lies before a cut. ``batch`` bounds the rows that Python gets at a time.
    """

    def __init__(self, spark: SparkSession, batch: int | None = None):
        self.spark, self.base, self.folders, self.batch = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}, batch

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.folders)}"
        with finished_shuffles_go(self.spark), small_batches(self.spark, self.batch):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.folders[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders[id(df)][0])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sampled(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows, by a hash of ``key``, which should tell rows apart.

    Rows are first let through by a threshold on the hash that fits their number, so that about
    ``bound`` rows in all, not so many of each partition, are sorted and reach the driver.
    """
    n = rows.count()
    share = min(1.0, (bound + 6 * bound**0.5) / max(n, 1))
    order = F.xxhash64(key)
    passing = rows.where(F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40)))
    return passing.orderBy(order, key).limit(bound)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Bitmap:
    """A set of hashes in a fixed number of bits: it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @classmethod
    def collect(cls, hashes: DataFrame, size: int) -> Bitmap:
        """From a frame of one bigint column; ``size`` bits, a power of two of at least 32,768, reach the driver."""
        bit = hashes.select((F.col(hashes.columns[0]).bitwiseAND(F.lit(size - 1)) + 1).alias("bit"))
        made = bit.groupBy(F.bitmap_bucket_number("bit").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        out = np.zeros(size // 8, np.uint8)
        with finished_shuffles_go(hashes.sparkSession):
            for r in made.collect():
                # Spark counts rows and numbers from 1.
                at = (r.row - 1) * (_BITS_A_ROW // 8)
                out[at : at + _BITS_A_ROW // 8] = np.frombuffer(r.bits, np.uint8)[: len(out) - at]
        return cls(out)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) & self.mask
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
