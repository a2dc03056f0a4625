"""Helpers shared by the corpus operators: table access and the shared scratch folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: What one operator keeps in this process for its next tasks.
_HELD: dict[str, object] = {}

#: Rows and bytes of one Arrow batch: what a task holds outside of the JVM's heap and in Python doesn't grow with the texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH``; they are read when a plan runs, so they stay set."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Only Spark opens the path, so any Hadoop file system works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a local master has one temporary folder for the whole session; any other master is an error,
    since its executors would each write to a disk of their own.
    """
    small_batches(spark)
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="nearfield-"))
        root = _LOCAL[0]
    return f"{root}/nearfield/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df._scratch)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forgotten(spark: SparkSession) -> None:
    """Let the driver see which shuffles nothing refers to any more: executors then delete their files, which otherwise waits for
    the driver's memory to fill."""
    spark._jvm.java.lang.System.gc()


def held(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this worker for its next tasks under ``name``. What was kept under another name goes."""
    if name not in _HELD:
        alone()
        _HELD[name] = make()
    return _HELD[name]


def alone() -> None:
    """Forget what another operator keeps in this worker: workers outlive queries and serve all operators in turn."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library keeps what is freed
            trim(0)


#: Least and most bits of a bitmap.
FILTER = (1 << 20, 1 << 26)


def bitmap(rows: DataFrame, *columns: str) -> bytes:
    """Bits in which the hash of every row's ``columns`` is set: a filter that passes all such rows and few others.

    It has 16 bits a row within ``FILTER``, so FILTER / 64 words at most reach the driver. With more rows it passes more, which
    a join that follows removes.
    """
    size = min(FILTER[1], max(FILTER[0], 1 << (16 * rows.count()).bit_length()))
    spot = F.pmod(F.xxhash64(*columns), F.lit(size)).alias("spot")
    words = rows.select(spot).groupBy(F.expr("spot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    del words
    pa.default_memory_pool().release_unused()
    return out.tobytes()


def among(rows: DataFrame, marks: bytes, *columns: str) -> DataFrame:
    """The ``rows`` that a ``bitmap`` of the same columns passes; texts of the others are sent nowhere."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        bits = np.frombuffer(marks, np.int64)
        for batch in batches:
            spot = batch.column("__spot").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((bits[spot >> 6] >> (spot & 63)) & 1 == 1))

    spotted = rows.withColumn("__spot", F.pmod(F.xxhash64(*columns), F.lit(8 * len(marks))))
    return spotted.mapInArrow(kept, spotted.schema).drop("__spot")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: One character that belongs to a word: anything but ASCII white space.
WORD_CLASS = r"[^\x20\x09-\x0D]"
