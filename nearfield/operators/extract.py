"""Extraction: filters, the page join, first-wins distinct, and the landmark check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.constants import CANARY_DEG
from nearfield.functions.text import display_title


def valid_coordinate(lat="lat", lon="lon") -> Column:
    """A real place: no NaN, inside the inclusive ranges, and not exactly (0, 0)."""
    a, b = F.col(lat), F.col(lon)
    return a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & a.between(-90, 90) & b.between(-180, 180) & ~((a == 0) & (b == 0))


def in_box(south, north, west, east, lat="lat", lon="lon") -> Column:
    """Inclusive on all sides; reaches the Parquet scan as comparisons."""
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def parse_box(text: str) -> dict[str, float]:
    """``west,south,east,north`` or ValueError."""
    import math

    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4 or not all(map(math.isfinite, parts)):
        raise ValueError("bounds are four finite numbers: west,south,east,north")
    return dict(zip(("west", "south", "east", "north"), parts, strict=True))


def page_length(value) -> Column:
    """A positive whole number, or null; garbage is tolerated."""
    x = F.col(value).try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x.cast("bigint"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``: one shuffle, cut to one row a key before it where Spark can."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def extract(pages: DataFrame, geo: DataFrame, box: dict | None = None) -> DataFrame:
    """Articles (seq, title, lat, lon, len): the last page of an id, primary earth coordinates, the first row of a title."""
    kept = pages.where("ns = 0 and redirect = 0").groupBy("page_id").agg(F.max_by(F.struct("title", "page_len"), "seq").alias("p"))
    places = geo.where((F.col("globe") == "earth") & (F.col("prim") == 1)).where(valid_coordinate())
    if box:
        places = places.where(in_box(box["south"], box["north"], box["west"], box["east"]))
    joined = places.select("seq", "page_id", "lat", "lon").join(kept, "page_id")
    rows = joined.select("seq", display_title("p.title").alias("title"), "lat", "lon", F.col("p.page_len").alias("raw_len"))
    return first_by(rows, ["title"], ["seq"]).select("seq", "title", "lat", "lon", page_length("raw_len").alias("len"))


def canary(articles: DataFrame, landmarks: DataFrame) -> DataFrame:
    """One row: landmarks matched, missing and mismatched (more than the tolerance off)."""
    found = landmarks.select("title", F.col("lat").alias("want_lat"), F.col("lon").alias("want_lon")).join(articles.select("title", "lat", "lon"), "title", "left")
    off = (F.abs(F.col("lat") - F.col("want_lat")) > CANARY_DEG) | (F.abs(F.col("lon") - F.col("want_lon")) > CANARY_DEG)
    return found.agg(
        F.count_if(F.col("lat").isNotNull() & ~off).alias("matched"),
        F.count_if(F.col("lat").isNull()).alias("missing"),
        F.count_if(F.col("lat").isNotNull() & off).alias("mismatched"),
    )


def require_canary(report: DataFrame, bounded: bool = False) -> None:
    """Raise for any mismatch, and for no match at all unless the extraction was bounded."""
    row = report.head()
    if row.mismatched or (not row.matched and not bounded):
        raise ValueError(f"landmark check failed: {row.asDict()}")
