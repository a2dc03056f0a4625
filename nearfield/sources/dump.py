"""SQL dumps: gzipped text with CREATE TABLE and INSERT lines; and line-delimited JSON.

The header is read on the driver up to the table's end; INSERT lines go through one Arrow pass that cuts tuples and keeps
the required columns by their place; a tuple that ends before a place has null there. gzip can't be split, so one task reads
a file; its parsed rows are dealt to all tasks by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
TOKEN = re.compile(r"""\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()']*))\s*""", re.DOTALL)
ESCAPED = re.compile(r"\\(.)|''", re.DOTALL)
COLUMN = re.compile(r"^\s*`([^`]+)`")
ARTICLE = "title string, lat double, lon double, len long"


def tuples(values: str) -> Iterator[list[str | None]]:
    """The tuples of a VALUES list; NULL alone is null, other words stay text. An unended tuple is dropped."""
    at, n = 0, len(values)
    while (at := values.find("(", at)) >= 0:
        at, row = at + 1, []
        while at < n:
            found = TOKEN.match(values, at)
            quoted, plain = found.group(1), found.group(2)
            if quoted is not None:
                row.append(ESCAPED.sub(lambda m: "'" if m[1] is None else ESCAPES.get(m[1], m[1]), quoted))
            else:
                row.append(None if plain.strip() == "NULL" else plain.strip())
            at = found.end()
            mark, at = values[at : at + 1], at + 1
            if mark == ")":
                yield row
                break
            if mark != ",":
                return


def columns_of(lines: list[str]) -> list[str] | None:
    """Column names in order, from the lines of a CREATE TABLE statement."""
    names = [m[1] for m in map(COLUMN.match, lines) if m]
    return names or None


def scan(spark: SparkSession, path: str, table: str, required: list[str]) -> DataFrame:
    """The required columns of a dumped table as text, with ``seq`` in file order. ValueError without table or column."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    start = lines.where(F.col("value").startswith(f"CREATE TABLE `{table}`")).agg(F.min("line")).head()[0]
    if start is None:
        raise ValueError(f"{path} has no table {table}")
    after = lines.where(F.col("line") > start)
    end = after.where(F.col("value").rlike(r"^\s*\)")).agg(F.min("line")).head()[0]
    header = after.where(F.col("value").rlike(r"^\s*`") & (F.lit(True) if end is None else F.col("line") < end))
    names = columns_of([r.value for r in header.orderBy("line").select("value").collect()]) or []
    missing = [x for x in required if x not in names]
    if missing:
        raise ValueError(f"table {table} has no column {', '.join(missing)}")
    places, prefix = [names.index(x) for x in required], f"INSERT INTO `{table}` VALUES "

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                found = [(line, k, *[row[p] if p < len(row) else None for p in places]) for k, row in enumerate(tuples(text.as_py()[len(prefix) :]))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if j < 2 else pa.string()) for j, x in enumerate(zip(*found, strict=True))], ["line", "pos", *required])

    schema = "line long, pos long, " + ", ".join(f"`{x}` string" for x in required)
    parsed = lines.where(F.col("value").startswith(prefix)).mapInArrow(rows, schema)
    return parsed.repartition("line", "pos").withColumn("seq", F.struct("line", "pos")).drop("line", "pos")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited JSON under a fixed schema; blank lines are skipped."""
    return spark.read.schema(ARTICLE).json(path).where("title is not null")


def write_articles(articles: DataFrame, path: str) -> None:
    """One article a line; an unknown length is left out."""
    articles.select("title", "lat", "lon", "len").write.option("ignoreNullFields", "true").json(path)
