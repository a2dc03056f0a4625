"""Queries of the position streams and meshes."""

from __future__ import annotations


from pyspark.sql import functions as F

from nearfield.constants import PAGE_INFINITE, SESSION_TTL_S
from nearfield.functions import paging
from nearfield.operators import knn, mesh, tiling
from nearfield.plans.registry import R, chosen, hav, members, query
from nearfield.plans.relational import D, _members, _shared, index
from nearfield.sources import blob
from nearfield.sources.views import VIEWS, ctes, view
from nearfield.streaming import positions as stream

FOLD = f"""WITH RECURSIVE {ctes('positions')[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM positions),
walk AS (SELECT user_id, n, event_id, ts, lat, lon, lat AS alat, lon AS alon, true AS taken FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.event_id, o.ts, o.lat, o.lon, CASE WHEN {hav('w.alat', 'w.alon', 'o.lat', 'o.lon')} * {R} >= 15 THEN o.lat ELSE w.alat END, CASE WHEN {hav('w.alat', 'w.alon', 'o.lat', 'o.lon')} * {R} >= 15 THEN o.lon ELSE w.alon END, {hav('w.alat', 'w.alon', 'o.lat', 'o.lon')} * {R} >= 15
  FROM walk w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)"""
TAKEN = f"{FOLD} SELECT user_id, event_id, ts, lat, lon FROM walk WHERE taken"


@query(TAKEN)
def requery_fold(spark, sf_dir):
    return stream.accepted(view(spark, sf_dir, "positions"))


def _run(spark, sf_dir, sink) -> None:
    """Run ``sink(events)`` (a writer) over the events as a file stream until all are read. Fails after ten minutes."""
    table, keep, columns = VIEWS["positions"]
    source = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(source).schema
    folder, pattern = source.rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    events = reader.option("pathGlobFilter", pattern).parquet(folder) if not _is_folder(spark, source) else reader.parquet(source)
    running = sink(events.where(keep).selectExpr(*columns)).option("checkpointLocation", _shared(spark, "stream-state")).trigger(availableNow=True).start()
    if not running.awaitTermination(600):
        running.stop()
        raise TimeoutError("the stream did not end")


def _replayed(spark, sf_dir, step):
    """The rows of ``step(events)`` as a stream gives them."""
    out = _shared(spark, "stream-out")
    _run(spark, sf_dir, lambda events: step(events).writeStream.format("parquet").option("path", out))
    return spark.read.parquet(out)


def _is_folder(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


@query(TAKEN)
def stream_requery(spark, sf_dir):
    return _replayed(spark, sf_dir, stream.accepted_stream).select("user_id", "event_id", "ts", "lat", "lon")


_ON = "positions_pts AS (SELECT event_id AS pid, lat, lon FROM positions)"


@query(f"{ctes('positions', 'articles_d')}, {_ON}, {members('articles_d')}, {chosen('positions_pts')} SELECT pid, tile_id, kind FROM chosen")
def stream_tiles(spark, sf_dir):
    """Tiles of every position, chosen inside the stream against the stored index's tiles."""
    codes = index(spark, sf_dir).codes
    return _replayed(spark, sf_dir, lambda s: tiling.for_positions(s.select(F.col("event_id").alias("pid"), "lat", "lon"), codes))


#: Seconds that suit the spacing of the test events; the rule's own default is a third of a second.
QUIET_S = 600


@query(f"{ctes('positions')} SELECT user_id, event_id FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM positions) WHERE gap IS NULL OR gap >= {QUIET_S * 1000000}")
def debounce(spark, sf_dir):
    return stream.debounced(view(spark, sf_dir, "positions"), QUIET_S).select("user_id", "event_id")


@query(f"{ctes('positions')} SELECT user_id, event_id FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM positions) WHERE gap IS NULL OR gap >= {QUIET_S * 1000000}")
def stream_debounce(spark, sf_dir):
    """The same rule inside a stream: sessions of the state store, the last event of each."""
    out = _shared(spark, "settled")

    def step(events):
        return stream.settled(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour"), QUIET_S)

    _run(spark, sf_dir, lambda events: step(events).writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)))
    return spark.read.parquet(out)


_MODES = ["event_id", "source", "event_id % 5 = 0 AS paused", "event_id % 700 AS known", "event_id % 300 AS loaded", "(event_id * 37 % 9000) / 1e0 AS top"]


@query(f"{ctes('positions')}, m AS (SELECT {', '.join(_MODES)} FROM positions), n AS (SELECT *, CASE WHEN source = 'picked' OR paused THEN 'infinite' ELSE 'viewport' END AS mode, CAST(CASE WHEN loaded = 0 THEN 0 ELSE greatest(known, loaded) END AS BIGINT) AS room FROM m) SELECT event_id, mode, room, CAST(CASE WHEN room = 0 THEN 0 ELSE greatest(0, floor(top / 60) - 5) END AS BIGINT) AS first, CAST(CASE WHEN room = 0 THEN 0 ELSE least(room, ceil((top + 800) / 60) + 5) END AS BIGINT) AS last, CASE WHEN mode = 'infinite' THEN {PAGE_INFINITE} ELSE 14 END AS page FROM n")
def scroll_modes(spark, sf_dir):
    """Mode, room and visible range of each event; a page is 200 in infinite mode, else what a viewport of 800 px shows."""
    rows = view(spark, sf_dir, "positions").selectExpr(*_MODES)
    rows = rows.select("event_id", "top", paging.scroll_mode("source", F.col("paused")).alias("mode"), paging.expected_count("known", "loaded").cast("long").alias("room"))
    first, last = paging.visible_range("top", F.lit(800.0), F.lit(60.0), "room")
    return rows.select("event_id", "mode", "room", first.alias("first"), last.alias("last"), F.when(F.col("mode") == "infinite", PAGE_INFINITE).otherwise(14).alias("page"))


_TURNS = ["event_id", "CASE WHEN event_id % 11 > 0 THEN (event_id * 53 % 3600) / 10e0 END AS shown", "CASE WHEN event_id % 13 > 0 THEN (event_id * 97 % 3600) / 10e0 END AS target", "(event_id * 7 % 400) / 1e0 AS ms", "event_id % 90 AS hops", "event_id % 40 AS steps", "event_id % 60 AS found"]


@query(f"WITH t AS (SELECT {', '.join(_TURNS)} FROM events), a AS (SELECT *, fmod(target - shown + 540, 360e0) - 180 AS arc, least(4000e0, greatest(600e0, hops * 70e0)) AS l, least(1500e0, greatest(300e0, steps * 70e0)) AS d, least(1500e0, greatest(300e0, found * 40e0)) AS b FROM t) SELECT event_id, round(CASE WHEN target IS NULL THEN shown WHEN shown IS NULL OR abs(arc) < 0.2 THEN target ELSE fmod(shown + arc * least(1e0, ms / 250) + 360, 360e0) END, 6) AS heading, l + d + b + 900 AS total_end, CAST(CASE WHEN hops <= 0 OR ms * 10 <= 0 THEN 0 WHEN ms * 10 >= l THEN hops ELSE least(hops, floor(ms * 10 / l * hops)) END AS BIGINT) AS drawn FROM a")
def heading_walk(spark, sf_dir):
    """One frame of a turning heading, and a replay's length and progress."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_TURNS)
    times = paging.walk_timeline("hops", "steps", "found")
    drawn = paging.phase_index(F.col("ms") * 10, F.lit(0.0), times["locate_end"], "hops")
    return rows.select("event_id", F.round(paging.turned("shown", "target", "ms"), 6).alias("heading"), times["total_end"].alias("total_end"), drawn.alias("drawn"))


@query("WITH e AS (SELECT user_id, event_id, event_id % 3 AS generation FROM events), c AS (SELECT DISTINCT user_id, user_id % 3 AS generation FROM events) SELECT e.* FROM e JOIN c USING (user_id, generation)")
def gen_filter(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    control = events.select("user_id", (F.col("user_id") % 3).alias("generation")).distinct()
    return stream.current_generation(events.select("user_id", "event_id", (F.col("event_id") % 3).alias("generation")), control)


@query(f"SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events WHERE epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) < {SESSION_TTL_S * 1000000} GROUP BY user_id")
def session_ttl(spark, sf_dir):
    return stream.fresh(spark.read.parquet(f"{sf_dir}/events.parquet"), "2024-01-20 00:00:00", SESSION_TTL_S).groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@query(f"{ctes('positions')} SELECT user_id, last = 'error' AS signal_lost, errors FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, CAST(count_if(event_type = 'error') AS BIGINT) AS errors FROM positions GROUP BY user_id)")
def gps_status(spark, sf_dir):
    return stream.last_status(view(spark, sf_dir, "positions"))


@query(f"{ctes('positions')}, m AS (SELECT *, CASE WHEN lag(source) OVER (PARTITION BY user_id ORDER BY ts, event_id) = source THEN 0 ELSE 1 END AS new FROM positions), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m) SELECT user_id, CAST(session AS BIGINT) AS session, source, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY ALL")
def source_sessions(spark, sf_dir):
    return stream.source_sessions(view(spark, sf_dir, "positions"))


def _points(spark, sf_dir):
    return knn.located(_members(spark, sf_dir)).select("tile_id", "seq", "title", "weight", "x", "y", "z")


@query(f"{D} SELECT tile_id, 2 * count(*) - 4 AS triangles, 3 * count(*) - 6 AS edges, count(*) AS vertices FROM members GROUP BY tile_id")
def hull_stats(spark, sf_dir):
    return mesh.stats(mesh.triangles(_points(spark, sf_dir)))


@query(f"{D} SELECT tile_id, count(*) AS vertices, 6 * count(*) - 12 AS degrees FROM members GROUP BY tile_id")
def mesh_neighbors(spark, sf_dir):
    """Degrees of all vertices: their sum is twice the number of edges."""
    edges = mesh.edges(mesh.triangles(_points(spark, sf_dir)))
    ends = edges.select("tile_id", F.explode(F.array("a", "b")).alias("v")).groupBy("tile_id", "v").agg(F.count("*").alias("degree"))
    return ends.groupBy("tile_id").agg(F.count("*").alias("vertices"), F.sum("degree").alias("degrees"))


@query()
def mesh_edges(spark, sf_dir):
    """Edges to draw, without the faces that close a patch behind."""
    path = _shared(spark, "meshes")  # each hull is made once
    blob.blobs(_points(spark, sf_dir)).write.parquet(path)
    tiles = spark.read.parquet(path)
    found, triangles = blob.vertices(tiles).select("tile_id", "v", "x", "y", "z"), blob.triangles(tiles)
    front = triangles.join(mesh.back_faces(triangles, found), ["tile_id", "t"], "left_anti")
    return mesh.drawn(front, found).select("tile_id", "a", "b")


@query(f"{D} SELECT tile_id, count(*) AS vertices, CAST(sum(seq) AS BIGINT) AS seqs FROM members GROUP BY tile_id")
def tile_blob(spark, sf_dir):
    """Blobs written and read back: every member is there again."""
    path = _shared(spark, "blobs")
    blob.blobs(_points(spark, sf_dir)).write.parquet(path)
    rows = blob.vertices(spark.read.parquet(path))
    return rows.groupBy("tile_id").agg(F.count("*").alias("vertices"), F.sum(F.regexp_replace("title", "Doc ", "").cast("long")).alias("seqs"))


