"""The stored tile index: articles and tile members as Parquet, and a manifest; built once, read by every query.

``articles`` has a row an article with its own tile and cell; ``members`` a row a tile and article of its buffered box. Both
are ranged by tile and cell and partitioned by tile row, so a query reads the rows of its tiles alone. A cell is half a degree
wide; cells are what nearest-neighbour queries join on. The manifest is one JSON document, written last: an index without it
doesn't exist. It names the folders of its tables, so a new build never mixes with an old one.

A title is kept once, the first by ``seq``, as extraction does.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.constants import BUFFER_DEG, CELL_COLS, CELL_DEG, CELL_ROWS, COLS, GRID_DEG, INDEX_VERSION, ROWS
from nearfield.functions import geo
from nearfield.operators import extract, tiling
from nearfield.session import shared_root

FIELDS = {"id": str, "row": int, "col": int, "south": (int, float), "north": (int, float), "west": (int, float), "east": (int, float), "articles": int, "bytes": int, "hash": str}
ARTICLES = "seq long, title string, lat double, lon double, len long, tile_col int, tile_id string, cell int, tile_row int"
MEMBERS = "seq long, title string, lat double, lon double, len long, tile_col int, tile_id string, native boolean, cell int, x double, y double, z double, weight int, tile_row int"


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))])


def cell(lat="lat", lon="lon") -> Column:
    """The number of the half-degree cell of a place."""
    row = F.least(F.floor((geo.col(lat) + 90) / CELL_DEG), F.lit(CELL_ROWS - 1))
    column = F.least(F.floor((geo.col(lon) + 180) / CELL_DEG), F.lit(CELL_COLS - 1))
    return (row * CELL_COLS + column).cast("int")


def cell_center(number) -> tuple[Column, Column, Column]:
    number = geo.col(number)
    return geo.cartesian((F.floor(number / CELL_COLS) + 0.5) * CELL_DEG - 90, (number % CELL_COLS + 0.5) * CELL_DEG - 180)


def reach(degrees: float) -> float:
    """Radians from the centre of a box of so many degrees to its farthest point, at most: its half diagonal on the equator."""
    return 2 * math.asin(math.sqrt(2) * math.sin(math.radians(degrees / 4)))


def tile_hashes(members: DataFrame) -> DataFrame:
    """(tile_id, bytes, hash): eight digits over a sum of its rows' digests, so no tile is gathered; a sum has no order."""
    row = F.concat_ws("|", F.col("seq").cast("string"), "title", F.round(F.col("lat") * 1e6).cast("long").cast("string"), F.round(F.col("lon") * 1e6).cast("long").cast("string"), F.col("weight").cast("string"))
    part = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    out = members.groupBy("tile_id").agg(F.sum(part).alias("total"), F.count("*").alias("n"), F.sum(F.octet_length("title") + 17).cast("long").alias("bytes"))
    return out.select("tile_id", "bytes", F.substring(F.md5(F.concat_ws(":", F.col("total").cast("string"), F.col("n").cast("string"))), 1, 8).alias("hash"))


def combined(hashes: list[str]) -> str:
    """Eight digits over the tiles' hashes in order of id."""
    return hashlib.sha256("".join(hashes).encode()).hexdigest()[:8]


@dataclass
class Index:
    """A stored index: its manifest's values and where its tables are."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def codes(self) -> list[int]:
        """Existing tiles, row by row: row * 72 + column; 2,592 at most."""
        return sorted(x["row"] * COLS + x["col"] for x in self.manifest["tiles"])

    @property
    def tiles(self) -> DataFrame:
        """The manifest's tiles as rows."""
        schema = "id string, row int, col int, south double, north double, west double, east double, articles long, bytes long, hash string"
        rows = [tuple(float(x[k]) if k in ("south", "north", "west", "east") else x[k] for k in FIELDS) for x in self.manifest["tiles"]]
        return self.spark.createDataFrame(rows, schema)

    @property
    def members(self) -> DataFrame:
        return self.spark.read.schema(MEMBERS).parquet(f"{self.path}/{self.manifest['members']}")

    @property
    def articles(self) -> DataFrame:
        return self.spark.read.schema(ARTICLES).parquet(f"{self.path}/{self.manifest['articles']}")


def build(articles: DataFrame, path: str, generated: str | None = None) -> Index:
    """Write the index of ``articles(seq, title, lat, lon, len)`` under ``path``; an older manifest there is replaced at the end."""
    spark, run = articles.sparkSession, uuid.uuid4().hex[:12]
    places = {"articles": f"articles-{run}", "members": f"members-{run}"}
    first = tiling.assigned(extract.first_by(articles, ["title"], ["seq"])).withColumn("cell", cell())
    _typed(first, ARTICLES).repartitionByRange("tile_row", "cell", "seq").write.partitionBy("tile_row").parquet(f"{path}/{places['articles']}")
    held = spark.read.schema(ARTICLES).parquet(f"{path}/{places['articles']}")
    x, y, z = geo.cartesian("lat", "lon")
    located = held.withColumns({"x": geo.stored(x), "y": geo.stored(y), "z": geo.stored(z), "weight": geo.weight_class("len")})
    rows = tiling.members(located.drop("tile_row", "tile_col", "tile_id"))
    _typed(rows, MEMBERS).repartitionByRange("tile_row", "tile_col", "cell", "seq").sortWithinPartitions("tile_row", "tile_col", "cell").write.partitionBy("tile_row").parquet(f"{path}/{places['members']}")
    members = spark.read.schema(MEMBERS).parquet(f"{path}/{places['members']}")
    found = tiling.index(members).join(tile_hashes(members), F.col("id") == F.col("tile_id")).orderBy("id")
    tiles = [{k: r[k] for k in FIELDS} for r in found.collect()]  # 2,592 rows at most
    stamp = generated or str(spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").head()[0])
    manifest = {"version": INDEX_VERSION, "gridDeg": GRID_DEG, "bufferDeg": BUFFER_DEG, "generated": stamp, "hash": combined([t["hash"] for t in tiles]), **places, "tiles": tiles}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return Index(spark, path, manifest)


def valid(manifest) -> bool:
    """The shape of a manifest: version and grid of this code, and tiles with all their fields inside of the grid."""
    if not isinstance(manifest, dict) or manifest.get("version") != INDEX_VERSION or manifest.get("gridDeg") != GRID_DEG or manifest.get("bufferDeg") != BUFFER_DEG:
        return False
    tiles = manifest.get("tiles")
    if not isinstance(tiles, list) or not all(isinstance(manifest.get(k), str) for k in ("hash", "articles", "members")):
        return False
    whole = lambda t: isinstance(t, dict) and all(isinstance(t.get(k), v) and not isinstance(t.get(k), bool) for k, v in FIELDS.items())
    return all(whole(t) and 0 <= t["row"] < ROWS and 0 <= t["col"] < COLS for t in tiles)


def read(spark: SparkSession, path: str) -> Index | None:
    """The index at ``path``; None where there is no manifest, it isn't JSON, or it has another shape."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    try:
        manifest = json.loads("\n".join(r.value for r in spark.read.option("wholetext", "true").text(f"{path}/manifest").collect()))
    except ValueError:
        return None
    return Index(spark, path, manifest) if valid(manifest) else None


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: what a stored index was made from."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    status = system.getFileStatus(folder)
    return repr(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in (system.listStatus(folder) if status.isDirectory() else [status])))


def opened(articles: DataFrame, source: str, name: str) -> Index:
    """The stored index of ``articles``, made from the files at ``source``; built where none is valid or the files changed."""
    spark = articles.sparkSession
    key = hashlib.sha256(f"{INDEX_VERSION}|{name}|{_state(spark, source)}".encode()).hexdigest()[:16]
    path = f"{shared_root(spark)}/nearfield-index/{name}-{key}"
    return read(spark, path) or build(articles, path)


def changed(cached: DataFrame, current: Index) -> DataFrame:
    """Tiles of the index that ``cached(id, hash)`` lacks or holds in another state: those to load."""
    return current.tiles.join(cached.select("id", "hash"), ["id", "hash"], "left_anti")
