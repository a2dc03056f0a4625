"""Tiles: cells, buffered membership, manifest, and tile selection for positions.

Range conditions become equi-joins on cells: each article is sent to the nine cells around its own and kept where the
residual box holds, so no nested loop is planned. There are at most 2,592 tiles; only their table is broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.constants import BUFFER_DEG, COLS, EDGE_DEG, GRID_DEG, MIN_ARTICLES, ROWS
from nearfield.functions import geo


def assigned(rows: DataFrame) -> DataFrame:
    """``rows(lat, lon, ...)`` with tile_row, tile_col and tile_id."""
    return rows.withColumns({"tile_row": geo.tile_row("lat"), "tile_col": geo.tile_col("lon")}).withColumn("tile_id", geo.tile_id("tile_row", "tile_col"))


def members(articles: DataFrame) -> DataFrame:
    """Articles of each populated tile and its buffer (tiles of at least four), with ``native`` for its own core."""
    own = assigned(articles).withColumnsRenamed({"tile_row": "own_row", "tile_col": "own_col"}).drop("tile_id")
    populated = own.select(F.col("own_row").alias("tile_row"), F.col("own_col").alias("tile_col")).distinct()  # 2,592 rows at most
    near = own.withColumn("dr", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dc", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    near = near.withColumn("tile_row", F.col("own_row") + F.col("dr")).withColumn("tile_col", geo.wrapped_col(F.col("own_col") + F.col("dc")))
    near = near.where(F.col("tile_row").between(0, ROWS - 1)).join(F.broadcast(populated), ["tile_row", "tile_col"])
    box = geo.tile_bounds("tile_row", "tile_col")
    near = near.withColumn("nlon", geo.shifted_lon("lon", box["west"] + GRID_DEG / 2))
    inside = F.col("lat").between(box["south"] - BUFFER_DEG, box["north"] + BUFFER_DEG) & F.col("nlon").between(box["west"] - BUFFER_DEG, box["east"] + BUFFER_DEG)
    native = (F.col("lat") >= box["south"]) & (F.col("lat") < box["north"]) & (F.col("nlon") >= box["west"]) & (F.col("nlon") < box["east"])
    kept = near.where(inside).withColumn("native", native).withColumn("tile_id", geo.tile_id("tile_row", "tile_col"))
    counted = kept.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ARTICLES).drop("n")
    return kept.join(F.broadcast(counted), ["tile_row", "tile_col"], "left_semi").drop("own_row", "own_col", "dr", "dc", "nlon")


def index(tiles: DataFrame) -> DataFrame:
    """One manifest row a tile of ``members``."""
    counts = tiles.groupBy("tile_row", "tile_col", "tile_id").agg(F.count_if("native").alias("articles"), F.count("*").alias("vertices"))
    box = geo.tile_bounds("tile_row", "tile_col")
    return counts.select(F.col("tile_id").alias("id"), F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), *[box[k].alias(k) for k in ("south", "north", "west", "east")], "articles", "vertices")


def index_hash(hashes: DataFrame) -> DataFrame:
    """First eight digits of the SHA-256 of all hashes in order of id; at most 2,592 rows are gathered."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("id", "hash"))), lambda x: x["hash"]))
    return hashes.agg(F.substring(F.sha2(joined, 256), 1, 8).alias("hash"))


def _listed(codes: list[int]) -> Column:
    """Existing tiles (row * 72 + column; 2,592 at most) as one constant array: choosing tiles joins nothing."""
    return F.from_json(F.lit(json.dumps(sorted(codes))), "array<int>")


def _ring_to(code) -> Column:
    return geo.ring("tile_row", "tile_col", F.floor(code / COLS), code % COLS).cast("int")


def _id_of(code) -> Column:
    return geo.tile_id(F.floor(code / COLS), code % COLS)


def for_positions(positions: DataFrame, codes: list[int]) -> DataFrame:
    """(pid, tile_id, kind): the tile of a position and existing neighbours within a degree of its edges; where the own
    tile doesn't exist, all tiles of the nearest populated ring. A projection, on streams as on tables."""
    at = assigned(positions.select("pid", "lat", "lon")).withColumn("held", _listed(codes))
    south, west = F.col("tile_row") * GRID_DEG - 90, F.col("tile_col") * GRID_DEG - 180
    near = {(-1, 0): F.col("lat") - south < EDGE_DEG, (1, 0): south + GRID_DEG - F.col("lat") < EDGE_DEG, (0, -1): F.col("lon") - west < EDGE_DEG, (0, 1): west + GRID_DEG - F.col("lon") < EDGE_DEG}
    code = lambda dr, dc: (F.col("tile_row") + dr) * COLS + geo.wrapped_col(F.col("tile_col") + dc)
    around = []
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            if dr or dc:
                hold = (near[dr, 0] if dr else F.lit(True)) & (near[0, dc] if dc else F.lit(True))
                if dr:
                    hold = hold & (F.col("tile_row") + dr).between(0, ROWS - 1)
                around.append(F.when(hold & F.array_contains("held", code(dr, dc)), F.struct(code(dr, dc).cast("int").alias("code"), F.lit("adjacent").alias("kind"))))
    own = F.struct(code(0, 0).cast("int").alias("code"), F.lit("primary").alias("kind"))
    direct = F.array_compact(F.array(own, *around))
    first = F.array_min(F.transform("held", _ring_to))
    lost = F.transform(F.filter("held", lambda c: _ring_to(c) == first), lambda c: F.struct(c.alias("code"), F.lit("ring").alias("kind")))
    chosen = F.when(F.array_contains("held", code(0, 0).cast("int")), direct).otherwise(lost)
    return at.select("pid", F.explode(chosen).alias("t")).select("pid", _id_of(F.col("t.code")).alias("tile_id"), "t.kind")


def rings(positions: DataFrame, codes: list[int], most: int | None = None) -> DataFrame:
    """(pid, tile_id, ring) of all tiles, or those within ``most``: found once for each of the 2,592 tiles that positions can be
    in, then lent to the positions of that tile."""
    return _lent(positions, own_rings(positions, codes, most))


def own_rings(positions: DataFrame, codes: list[int], most: int | None = None) -> DataFrame:
    """(tile_row, tile_col, tile_id, ring) for each tile that holds a position."""
    own = assigned(positions.select("lat", "lon")).select("tile_row", "tile_col").distinct()
    held = _listed(codes) if most is None else F.filter(_listed(codes), lambda c: _ring_to(c) <= most)
    return own.select("tile_row", "tile_col", F.explode(held).alias("code")).select("tile_row", "tile_col", _id_of(F.col("code")).alias("tile_id"), _ring_to(F.col("code")).alias("ring"))


def _lent(positions: DataFrame, by_tile: DataFrame) -> DataFrame:
    return assigned(positions.select("pid", "lat", "lon")).select("pid", "tile_row", "tile_col").join(by_tile, ["tile_row", "tile_col"]).select("pid", "tile_id", "ring")


def nearest(positions: DataFrame, codes: list[int]) -> DataFrame:
    """All tiles of each position's first populated ring."""
    own = assigned(positions.select("lat", "lon")).select("tile_row", "tile_col").distinct().withColumn("held", _listed(codes))
    first = F.array_min(F.transform("held", _ring_to))
    found = own.select("tile_row", "tile_col", F.explode(F.filter("held", lambda c: _ring_to(c) == first)).alias("code"))
    return _lent(positions, found.select("tile_row", "tile_col", _id_of(F.col("code")).alias("tile_id"), _ring_to(F.col("code")).alias("ring")))


def centroids(tiles: DataFrame) -> DataFrame:
    """Direction of each tile's mean vector and the member nearest to it."""
    x, y, z = geo.cartesian("lat", "lon")
    points = tiles.select("tile_id", "title", *[geo.stored(v).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))])
    means = points.groupBy("tile_id").agg(*[F.avg(n).alias(f"m{n}") for n in "xyz"])
    m = geo.normalized(("mx", "my", "mz"))
    near = points.join(F.broadcast(means), "tile_id")
    off = F.round(geo.metres(geo.chord_angle(("x", "y", "z"), m)), 2)
    return near.groupBy("tile_id").agg(F.min_by("title", F.struct(off, "title")).alias("anchor"), F.round(F.first("mx"), 9).alias("mx"), F.round(F.first("my"), 9).alias("my"), F.round(F.first("mz"), 9).alias("mz"))


def stale(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Cached tiles whose (id, hash) is not in the manifest."""
    return cached.join(current.select("id", "hash"), ["id", "hash"], "left_anti")


def lru_evicted(uses: DataFrame, keep: int) -> DataFrame:
    """Ids beyond the ``keep`` last used of each language."""
    last = uses.groupBy("lang", "id").agg(F.max("ts").alias("last"))
    return last.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.col("last").desc(), "id"))).where(F.col("rn") > keep).drop("rn")


