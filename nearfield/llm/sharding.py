"""Sharding by global byte-size prefix sums: contiguous runs of documents of near equal bytes. DataFrame operations only.

Plan: the narrow rows (id, size, checksum; no text) are written, range-partitioned by doc_id and written again with their
partition's number. Per-partition totals (a row a partition) give each partition's first byte and first rank; a window
inside the partition does the rest, so no task sees more than one partition and no total passes through one row at a time.

A document belongs to the shard in whose equal share of all bytes its middle byte lies: the cut nearest to each target.
Order: doc_id ascending, nulls first, then checksum and size, so repeated rows are neighbours and reruns agree.
A null text has size 1 and the checksum of the empty text. An empty table gives no rows. Other columns are not read.
Copies of one text are not held together: under the ``bytes`` law a group may exceed a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm.common import partitions, table, written


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1) and checksum of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def byte_shards(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows(doc_id, size, text_crc32)`` with shard and slot. Sums must stay below 2**62 / n_shards."""
    spark = rows.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    rows = written(rows, "shard-sizes")  # texts are read once, not for the bounds of the ranges too
    ranged = rows.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    kept = written(ranged, "shard-rows")
    totals = kept.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    run = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(run), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("n").over(run), F.lit(0)).alias("first_rank"),
        F.sum("bytes").over(W.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        kept.join(F.broadcast(firsts), "part")  # a row a partition
        .withColumn("before", F.col("first_byte") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("rank", F.col("first_rank") + F.count("*").over(inside))
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * before + size) * {n_shards}) div (2 * all_bytes)) as int)"))
    )
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first_of_shard"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_of_shard")).alias("slot"))


def op8_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    out = byte_shards(sized(table(spark, sf_dir, "documents")), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
