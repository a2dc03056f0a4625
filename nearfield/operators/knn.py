"""Nearest neighbours over the stored index: exact top-k in tiles, in one tile or everywhere; rank and ring pages.

Positions never meet all articles. Each (position, tile) bounds its k-th distance from the counts of the tile's half-degree
cells: a cell's articles lie within its centre's distance plus its reach, so the distance by which k of them are held is
a bound; cells that begin beyond it are left out, and positions join the remaining cells by equality. Counts are of native
rows, so copies in buffers never shorten a bound; without k of them there is no bound and all cells are read. The cells of a
tile are 169 at most, and only their counts are broadcast. Of articles at one place those with the k first titles are read, and
one position stands for all at its place (``by_place``), so copies add no pairs beyond k a place. Ranks come from one shuffle by
position (WindowGroupLimit cuts to k before it). Distances are compared after rounding to a millimetre and ties end in the
title, so reruns and engines agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.constants import CELL_DEG, COLS, GRID_DEG, MAX_RING
from nearfield.functions import geo
from nearfield.operators import store, tiling

#: Chord added to bounds: kept vectors are single precision, distances are rounded.
SLACK = 1e-6


def located(articles: DataFrame) -> DataFrame:
    """Articles with the vector that is kept for them and their weight class."""
    x, y, z = geo.cartesian("lat", "lon")
    out = articles.withColumns({"x": geo.stored(x), "y": geo.stored(y), "z": geo.stored(z)})
    return out.withColumn("weight", geo.weight_class("len")) if "len" in articles.columns else out


def distance(px="px", py="py", pz="pz"):
    return F.round(geo.metres(geo.chord_angle((px, py, pz), ("x", "y", "z"))), 3)


def pointed(positions: DataFrame) -> DataFrame:
    x, y, z = geo.cartesian("lat", "lon")
    return positions.select("pid", x.alias("px"), y.alias("py"), z.alias("pz"))


def result(rows: DataFrame) -> DataFrame:
    """pid, rank, title, place as kept, distance and weight."""
    lat, lon = geo.latlon("x", "y", "z")
    return rows.select("pid", F.col("rn").alias("rank"), "title", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), "distance_m", "weight")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest titles of each position; copies of an article in several tiles have one rank and are one row."""
    if k < 1:
        raise ValueError("k is 1 or more")
    place = F.dense_rank().over(W.partitionBy("pid").orderBy("distance_m", "title"))
    return rows.withColumn("rn", place).where(F.col("rn") <= k).dropDuplicates(["pid", "rn"])


def _chord(p: tuple, q: tuple) -> Column:
    """Straight distance of two unit vectors; like the angle it grows with the way and obeys the triangle rule."""
    d = [geo.col(x) - geo.col(y) for x, y in zip(p, q, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _reach(degrees: float) -> float:
    return 2 * math.sin(store.reach(degrees) / 2)


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to many tasks: few rows that each cost much. The stated number keeps adaptive execution from putting
    them together; twice the usual one keeps this shuffle apart from one by the same key before it."""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _boxes(rows: DataFrame, counted: Column) -> DataFrame:
    """(tile_id, cells): of each tile its cells with their centres and the number of ``counted`` rows."""
    x, y, z = store.cell_center("cell")
    counts = rows.groupBy("tile_id", "cell").agg(F.count_if(counted).alias("n"))
    return counts.groupBy("tile_id").agg(F.collect_list(F.struct("cell", x.alias("x"), y.alias("y"), z.alias("z"), "n")).alias("cells"))


def _bound(parts: Column, k: int) -> Column:
    """The least ``high`` by which ``parts(high, n)`` hold k, or null."""
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(None).cast("double").alias("bound"))
    step = lambda a, x: F.struct((a["held"] + x["n"]).alias("held"), F.when(a["bound"].isNull() & (a["held"] + x["n"] >= k), x["high"]).otherwise(a["bound"]).alias("bound"))
    return F.aggregate(F.sort_array(parts), start, step, lambda a: a["bound"])


def _ends(cells: str, p: tuple, more: float) -> Column:
    """(high, n) of each cell: no article of it is farther than ``high`` from any place within ``more`` of ``p``."""
    reach = _reach(CELL_DEG) + more + SLACK
    return F.transform(cells, lambda c: F.struct((_chord(p, (c["x"], c["y"], c["z"])) + reach).alias("high"), c["n"].cast("long").alias("n")))


def _near(cells: str, p: tuple, bound: str, more: float) -> Column:
    """The cells that begin within ``bound``."""
    reach = _reach(CELL_DEG) + more + SLACK
    return F.filter(cells, lambda c: F.col(bound).isNull() | (_chord(p, (c["x"], c["y"], c["z"])) - reach <= F.col(bound)))


def met(positions: DataFrame, chosen: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Pairs of positions and ``rows(tile_id, cell, native, ...)`` of their ``chosen(pid, tile_id)`` tiles, with distance_m;
    among them the k nearest titles of each position. Rows of a tile at one place are equally far from any position, so no more
    than its k first titles can be among them."""
    p, key = ("px", "py", "pz"), ["pid", "tile_id"]
    boxes = F.broadcast(_boxes(rows, F.col("native")))  # 2,592 tiles of 169 cells at most
    at = _spread(chosen.select(*key).join(pointed(positions), "pid"), "pid").join(boxes, "tile_id").withColumn("own", _bound(_ends("cells", p, 0.0), k))
    least = at.select(*key, *p, F.min("own").over(W.partitionBy("pid")).alias("bound"))
    kept = least.join(boxes, "tile_id").select("pid", *p, "tile_id", F.explode(F.transform(_near("cells", p, "bound", 0.0), lambda c: c["cell"])).alias("cell"))
    few = rows.withColumn("nth", F.dense_rank().over(W.partitionBy("tile_id", "cell", "x", "y", "z").orderBy("title"))).where(F.col("nth") <= k).drop("nth")
    return kept.join(few, ["tile_id", "cell"]).withColumn("distance_m", distance())


def by_place(positions: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found`` of one position a place, that with the least pid, given to every position there. ``found`` takes
    ``positions(pid, lat, lon)`` and gives rows with pid that depend on the place alone."""
    known = positions.where(F.col("pid").isNotNull()).select("pid", "lat", "lon").distinct()
    places = known.groupBy("lat", "lon").agg(F.min("pid").alias("at"))
    rows = found(places.select(F.col("at").alias("pid"), "lat", "lon"))
    held = known.join(places, ["lat", "lon"]).select("pid", "at")
    return held.join(rows.withColumnRenamed("pid", "at"), "at").select(*rows.columns)


POOL = ["tile_id", "cell", "native", "seq", "title", "x", "y", "z", "weight"]


def pairs(positions: DataFrame, index: store.Index, k: int, min_weight: int = 0) -> DataFrame:
    """Pairs of positions and members of their tiles that hold the k nearest."""
    return met(positions, tiling.for_positions(positions, index.codes), index.members.where(F.col("weight") >= min_weight).select(*POOL), k)


def tiled(positions: DataFrame, index: store.Index, k: int, min_weight: int = 0) -> DataFrame:
    """The k nearest articles of each position in its tiles (see ``tiling.for_positions``), of at least ``min_weight``."""
    return by_place(positions, lambda places: at_places(places, index, k, min_weight))


def at_places(places: DataFrame, index: store.Index, k: int, min_weight: int = 0) -> DataFrame:
    """``tiled`` of positions that are at different places."""
    return result(ranked(pairs(places, index, k, min_weight), k))


def nearby(positions: DataFrame, index: store.Index | None, k: int, min_weight: int = 0) -> DataFrame:
    """``tiled``, or no rows where there is no index yet."""
    if index is None:
        return positions.sparkSession.createDataFrame([], "pid long, rank int, title string, lat double, lon double, distance_m double, weight int")
    return tiled(positions, index, k, min_weight)


def everywhere(positions: DataFrame, index: store.Index, k: int, min_weight: int = 0) -> DataFrame:
    """The exact k nearest of all articles.

    Cells that hold positions (259,200 at most) stand for them: first the tiles, then the cells of the tiles left bound the
    k-th distance of every place of such a cell. Positions then join the articles of the cells that begin within it.
    """
    x, y, z = geo.cartesian("lat", "lon")
    rows = located(index.articles).where(F.col("weight") >= min_weight).select("tile_id", "cell", "seq", "title", "x", "y", "z", "weight")
    boxes = F.broadcast(_boxes(rows, F.lit(True)))  # 2,592 tiles of 100 cells at most
    own, q, more = _reach(CELL_DEG), ("qx", "qy", "qz"), _reach(GRID_DEG) + SLACK
    row, column = F.substring("tile_id", 1, 2).cast("int"), F.substring("tile_id", 4, 2).cast("int")
    center = geo.cartesian((row + 0.5) * GRID_DEG - 90, (column + 0.5) * GRID_DEG - 180)
    counts = boxes.select("tile_id", *[c.alias(n) for c, n in zip(center, "xyz", strict=True)], F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"))
    every = F.broadcast(counts.agg(F.collect_list(F.struct("tile_id", "x", "y", "z", "n")).alias("tiles")))  # one row
    at = positions.select("pid", store.cell().alias("q"), x.alias("px"), y.alias("py"), z.alias("pz"))
    cx, cy, cz = store.cell_center("q")
    cells = _spread(at.select("q").distinct(), "q").select("q", cx.alias("qx"), cy.alias("qy"), cz.alias("qz")).join(every)
    far = F.transform("tiles", lambda t: F.struct(t["tile_id"].alias("tile_id"), _chord(q, (t["x"], t["y"], t["z"])).alias("d"), t["n"].cast("long").alias("n")))
    cells = cells.select("q", *q, far.alias("far"))
    cells = cells.withColumn("coarse", _bound(F.transform("far", lambda t: F.struct((t["d"] + more + own).alias("high"), t["n"].alias("n"))), k))
    left = F.filter("far", lambda t: F.col("coarse").isNull() | (t["d"] - more - own <= F.col("coarse")))
    tiles = cells.select("q", *q, "coarse", F.explode(F.transform(left, lambda t: t["tile_id"])).alias("tile_id")).join(boxes, "tile_id")
    fine = tiles.select("q", *q, "tile_id", "coarse", _bound(_ends("cells", q, own), k).alias("fine"))
    bounded = fine.withColumn("bound", F.least("coarse", F.min("fine").over(W.partitionBy("q")))).drop("coarse", "fine")
    kept = bounded.join(boxes, "tile_id").select("q", "bound", "tile_id", F.explode(_near("cells", q, "bound", own)).alias("c"))
    reach = _reach(CELL_DEG) + SLACK
    sent = at.join(kept, "q").where(F.col("bound").isNull() | (_chord(("px", "py", "pz"), ("c.x", "c.y", "c.z")) - reach <= F.col("bound")))
    sent = sent.select("pid", "px", "py", "pz", "tile_id", F.col("c.cell").alias("cell"))
    return result(ranked(sent.join(rows, ["tile_id", "cell"]).withColumn("distance_m", distance()), k))


def one(index: store.Index, lat: float, lon: float, k: int, min_weight: int = 0) -> DataFrame:
    """The k nearest of one place among the members of its tile: one tile is read, a top-k without a full sort. k below one is
    one; k beyond the tile gives the whole tile."""
    x, y, z = geo.cartesian(F.lit(lat), F.lit(lon))
    row, column = min(int((lat + 90) // GRID_DEG), 180 // GRID_DEG - 1), min(int((lon + 180) // GRID_DEG), COLS - 1)
    rows = index.members.where((F.col("tile_row") == row) & (F.col("tile_col") == column) & (F.col("weight") >= min_weight))
    rows = rows.withColumn("distance_m", F.round(geo.metres(geo.chord_angle((x, y, z), ("x", "y", "z"))), 3))
    a, b = geo.latlon("x", "y", "z")
    return rows.orderBy("distance_m", "title").limit(max(1, k)).select("title", F.round(a, 6).alias("lat"), F.round(b, 6).alias("lon"), "distance_m", "weight")


def page(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Ranks start (from 0) to end of each position's ``rows(pid, title, distance_m)``."""
    rn = F.row_number().over(W.partitionBy("pid").orderBy("distance_m", "title"))
    return rows.withColumn("rn", rn).where((F.col("rn") > start) & (F.col("rn") <= end))


def ring_page(positions: DataFrame, index: store.Index, start: int, end: int) -> DataFrame:
    """Progressive page: rings are added until ``end`` distinct titles are held, then sorted and sliced. The page may miss
    a nearer article of the next ring; ``everywhere`` doesn't. Which rings those are depends on the tile of a position alone, so
    the pool is found once a tile (2,592 at most). Native rows are in one tile each: the ring at which their counts reach
    ``end`` bounds the rings whose members are read."""
    tile = ["tile_row", "tile_col"]
    natives = index.tiles.select(F.col("id").alias("tile_id"), "articles")  # 2,592 tiles at most
    by_ring = tiling.own_rings(positions, index.codes, MAX_RING)
    counted = by_ring.join(F.broadcast(natives), "tile_id")
    sums = counted.groupBy(*tile, "ring").agg(F.sum("articles").alias("n")).withColumn("held", F.sum("n").over(W.partitionBy(*tile).orderBy("ring")))
    bound = sums.groupBy(*tile).agg(F.coalesce(F.min(F.when(F.col("held") >= end, F.col("ring"))), F.lit(MAX_RING)).alias("bound"))
    by_ring = by_ring.join(bound, tile).where("ring <= bound").drop("bound")
    first = by_ring.join(index.members.select("tile_id", "seq"), "tile_id").groupBy(*tile, "seq").agg(F.min("ring").alias("ring"))
    upto = first.groupBy(*tile, "ring").agg(F.count("*").alias("n")).withColumn("held", F.sum("n").over(W.partitionBy(*tile).orderBy("ring")))
    enough = upto.groupBy(*tile).agg(F.coalesce(F.min(F.when(F.col("held") >= end, F.struct("ring", F.col("held")))), F.max(F.struct(F.lit(MAX_RING).alias("ring"), F.col("held")))).alias("e"))
    enough = enough.select(*tile, F.col("e.ring").alias("last"), F.col("e.held").alias("total"))
    wanted = by_ring.join(enough, tile).where("ring <= last").select(*tile, "tile_id")
    at = tiling.assigned(positions).select("pid", *tile)
    rows = index.members.select(*POOL)
    page_ = ranked(met(positions, at.join(wanted, tile).select("pid", "tile_id"), rows, end), end).where(F.col("rn") > start)
    return page_.join(at, "pid").join(enough, tile).select("pid", F.col("rn").alias("rank"), "title", "distance_m", F.col("last").alias("ring"), "total")


def merged_segments(segments: DataFrame) -> DataFrame:
    """Touching or overlapping [start, end) of each key as one."""
    order = W.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = segments.where("start < end").withColumn("before", before).withColumn("island", F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(order))
    return marked.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def pool_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Union of two pools by id; the local row wins."""
    both = local.withColumn("pool", F.lit(0)).unionByName(remote.withColumn("pool", F.lit(1)))
    return both.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("pool"))).where("rn = 1").drop("rn", "pool")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Titles of two results: reuse, new or removed."""
    a, b = old.select("pid", "title", F.lit(True).alias("was")), new.select("pid", "title", F.lit(True).alias("now"))
    return a.join(b, ["pid", "title"], "full_outer").select("pid", "title", _kind(F.col("was"), F.col("now")).alias("kind"))


def page_diff(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """``diff`` of two pages of one result ``rows(pid, title, ...)`` with each title once: those for which ``old`` and ``new``
    hold. No join, and the result is made once."""
    return rows.where(old | new).select("pid", "title", _kind(old, new).alias("kind"))


def _kind(was: Column, now: Column) -> Column:
    return F.when(was & now, "reuse").when(now, "new").otherwise("removed")
