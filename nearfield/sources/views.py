"""Coordinate tables derived from the driver's tables: integer remainders and one division, exact in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, filter, columns); the same text is a Spark projection and a DuckDB view.
VIEWS = {
    "articles_g": ("documents", "true", ["doc_id AS seq", "concat('Doc ', doc_id) AS title", "(doc_id * 7919 % 18001) / 100e0 - 90e0 AS lat", "(doc_id * 104729 % 36001) / 100e0 - 180e0 AS lon", "n_chars AS len", "lang AS lang"]),
    "articles_d": ("documents", "true", ["doc_id AS seq", "concat('Doc ', doc_id) AS title", "40e0 + (doc_id * 7919 % 2000) / 100e0 AS lat", "-10e0 + (doc_id * 104729 % 3000) / 100e0 AS lon", "n_chars AS len", "lang AS lang"]),
    "page_like": ("documents", "true", ["doc_id AS seq", "doc_id AS page_id", "CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS ns", "CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS redirect", "concat('Doc_', doc_id % 900) AS title", "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars END AS page_len"]),
    "geo_like": ("orders", "true", ["o_orderkey AS seq", "o_orderkey % 1200 AS page_id", "CASE WHEN o_orderkey % 17 = 0 THEN 'moon' ELSE 'earth' END AS globe", "CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS prim", "CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0e0 ELSE (o_custkey * 7919 % 18201) / 100e0 - 91e0 END AS lat", "CASE WHEN o_orderkey % 23 = 0 THEN 0e0 ELSE (o_custkey * 104729 % 36201) / 100e0 - 181e0 END AS lon"]),
    "positions": ("events", "true", ["user_id AS user_id", "ts AS ts", "event_id AS event_id", "48.85e0 + (event_id * 37 % 200) / 100000e0 AS lat", "2.29e0 + (event_id * 53 % 200) / 100000e0 AS lon", "CASE WHEN event_type = 'error' THEN 'picked' ELSE 'gps' END AS source", "event_type AS event_type"]),
    "queries_pts": ("customer", "true", ["c_custkey AS pid", "38e0 + (c_custkey * 7907 % 2400) / 100e0 AS lat", "-14e0 + (c_custkey * 104723 % 3800) / 100e0 AS lon"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, keep, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(keep).selectExpr(*columns)


def ctes(*names: str) -> str:
    """The same views as the start of a DuckDB query."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(VIEWS[n][2])} FROM {VIEWS[n][0]} WHERE {VIEWS[n][1]})" for n in names)
