"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Targets: sources in code-point order (null last) take the weights in turn; all words are shared by weight, no source
takes more than ``most`` times its own words, and what is cut off is shared again by weight until none is above. In order
of cap over weight the capped sources come first, so one running sum over the sources finds the final level.

Sampling: every document of a source expects target / source words copies. Its documents, in order of size and doc_id,
lie end to end with that length; one offset in [0, 1) for the source (from a hash of seed and name) is added, and a
document is emitted once for each integer boundary that its stretch crosses. Neighbours have near equal sizes, so the
words taken differ from the target by about one of the largest documents.

Plan: narrow rows are range-partitioned by source and size and written once with their partition's number; counts by
partition and source (partitions + sources rows) give each stretch's first rank, so a hot source is spread over many
tasks. Defined cases: null text has size 0 and is emitted like any other document of its source; a source without words
has target 0 and its documents are taken 0 times; repeated rows count separately; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm.common import WORD_CLASS, partitions, table, written

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"


def source_targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """A row a source of ``rows(source, size)``: key, source_size, target, rate (copies a document) and offset."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("key", key)
    share, common = F.array(*[F.lit(w).cast("long") for w in weights]), reduce(lcm, weights)
    numbered = sums.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumn("weight", F.element_at(share, (F.col("n") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by_ratio = W.orderBy((F.col("source_size") * F.expr(f"{common} div weight")), "n")
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(0))
    left = weighed.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(rest))
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("left_weight")
    placed = left.withColumn("place", F.row_number().over(by_ratio)).withColumn("level_at", F.min(F.when(fits, F.col("place"))).over(every))
    level = F.max(F.when(F.col("place") == F.col("level_at"), F.col("left").cast("double") / F.col("left_weight").cast("double"))).over(every)
    target = F.when(F.col("place") < F.col("level_at"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight").cast("double"))
    out = placed.withColumn("level", level).withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return out.select("key", "source_size", "target", rate.alias("rate"), offset.alias("offset"))


def systematic(rows: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``rows(doc_id, source, size, ...)`` with source_size, target and copies; further columns break ties and are kept."""
    spark = rows.sparkSession
    more = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    order = [F.col("size"), F.col("doc_id").asc_nulls_first(), *more]
    rows = written(rows, "mix-sizes")  # texts are counted once, not for the bounds of the ranges too
    ranged = rows.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id())
    kept = written(ranged.withColumn("key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))), "mix-rows")
    counts = kept.groupBy("part", "key").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.withColumn("first", first).join(source_targets(kept, weights, most, seed), "key").drop("n")
    rank = F.col("first") + F.row_number().over(W.partitionBy("part", "key").orderBy(*order))
    upto = lambda k: F.floor(k.cast("double") * F.col("rate") + F.col("offset"))
    copies = F.least(F.lit(most).cast("long"), upto(F.col("rank")) - upto(F.col("rank") - 1))
    return kept.join(stretches, ["part", "key"]).withColumn("rank", rank).withColumn("copies", copies).drop("part", "key", "first", "rank", "rate", "offset")


def word_count(text: str = "text"):
    """Number of runs of anything but ASCII white space; null counts 0. A run starts where white space (or nothing) ends."""
    held = F.concat(F.lit(" "), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.regexp_count(held, F.lit(f"[\\x20\\x09-\\x0D]{WORD_CLASS}")).cast("long")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with each row repeated as often as the mix takes it; the columns stay.

    Rows alike in doc_id and text share their copies evenly, so which of them is which never matters.
    """
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count().alias("size"), tie.alias("tie"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    taken = systematic(rows, weights, most, seed).groupBy(key.alias("__nf_id"), F.col("tie").alias("__nf_tie")).agg(F.sum("copies").alias("__nf_copies"), F.count("*").alias("__nf_alike"))
    keyed = docs.withColumns({"__nf_doc": key, "__nf_text": tie})
    joined = keyed.join(taken.where("__nf_copies > 0"), (F.col("__nf_doc") == F.col("__nf_id")) & (F.col("__nf_text") == F.col("__nf_tie")))
    row = F.row_number().over(W.partitionBy("__nf_doc", "__nf_text").orderBy("__nf_copies"))  # the join's partitioning serves
    of_row = F.expr("__nf_copies * __nf_row div __nf_alike - __nf_copies * (__nf_row - 1) div __nf_alike")
    counted = joined.withColumn("__nf_row", row).withColumn("__nf_n", of_row).where("__nf_n > 0")
    return counted.withColumn("__nf_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__nf_n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: weights 5, 2, 1 in turn, at most 3 times a source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    out = systematic(rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, source_size * {MOST} AS cap FROM n),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY source_size * (10 // weight), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(weight) OVER (ORDER BY source_size * (10 // weight), n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw,
        row_number() OVER (ORDER BY source_size * (10 // weight), n) AS place FROM w),
f AS (SELECT *, min(CASE WHEN lft * weight <= cap * lw THEN place END) OVER () AS level_at FROM l),
v AS (SELECT *, max(CASE WHEN place = level_at THEN CAST(lft AS DOUBLE) / CAST(lw AS DOUBLE) END) OVER () AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN place < level_at THEN CAST(cap AS DOUBLE) ELSE level * CAST(weight AS DOUBLE) END AS target,
        CAST('0x' || substr(md5('{SEED}|' || key), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0e0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * least({MOST}, floor(CAST(k AS DOUBLE) * rate + u) - floor(CAST(k - 1 AS DOUBLE) * rate + u)) AS BIGINT) AS taken FROM r
"""
