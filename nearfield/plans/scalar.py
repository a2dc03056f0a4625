"""Queries of the scalar library."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import geo, text
from nearfield.plans.registry import COL, R, ROW, chord, hav, kept, query, tid, vec, weight
from nearfield.sources.views import ctes, view

PAIRS = "pairs AS (SELECT seq, lat AS lat1, lon AS lon1, (seq * 6101 % 18001) / 100e0 - 90e0 AS lat2, (seq * 99991 % 36001) / 100e0 - 180e0 AS lon2 FROM articles_g)"
VECTORS = "vs AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS az, CAST(embedding[4] AS DOUBLE) AS bx, CAST(embedding[5] AS DOUBLE) AS b_y, CAST(embedding[6] AS DOUBLE) AS bz, CAST(embedding[7] AS DOUBLE) AS cx, CAST(embedding[8] AS DOUBLE) AS cy, CAST(embedding[9] AS DOUBLE) AS cz FROM embeddings)"
A, B, C = ("ax", "ay", "az"), ("bx", "b_y", "bz"), ("cx", "cy", "cz")
DOT = lambda a, b: " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True))
CROSS = lambda a, b: (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def pairs(spark, sf_dir):
    return view(spark, sf_dir, "articles_g").selectExpr("seq", "lat AS lat1", "lon AS lon1", "(seq * 6101 % 18001) / 100e0 - 90e0 AS lat2", "(seq * 99991 % 36001) / 100e0 - 180e0 AS lon2")


def vectors(spark, sf_dir):
    names = ["ax", "ay", "az", "bx", "b_y", "bz", "cx", "cy", "cz"]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])


_U = CROSS(A, B)


@query(f"WITH {VECTORS} SELECT vec_id, round(sqrt({DOT(A, A)}), 9) AS len, round({DOT(A, B)}, 9) AS dt, round({_U[0]}, 9) AS cx1, round({_U[1]}, 9) AS cy1, round({_U[2]}, 9) AS cz1, round(ax / sqrt({DOT(A, A)}), 9) AS nx FROM vs")
def vector_math(spark, sf_dir):
    c = geo.cross(A, B)
    return vectors(spark, sf_dir).select("vec_id", F.round(geo.length(A), 9).alias("len"), F.round(geo.dot(A, B), 9).alias("dt"), *[F.round(x, 9).alias(n) for x, n in zip(c, ("cx1", "cy1", "cz1"), strict=True)], F.round(geo.normalized(A)[0], 9).alias("nx"))


_V = vec("lat", "lon")


@query(f"{ctes('articles_g')} SELECT seq, round({_V[0]}, 9) AS x, round({_V[1]}, 9) AS y, round({_V[2]}, 9) AS z FROM articles_g")
def to_cartesian(spark, sf_dir):
    return view(spark, sf_dir, "articles_g").select("seq", *[F.round(v, 9).alias(n) for v, n in zip(geo.cartesian("lat", "lon"), "xyz", strict=True)])


@query(f"WITH {VECTORS} SELECT vec_id, round(degrees(asin(greatest(-1e0, least(1e0, az / sqrt({DOT(A, A)}))))), 6) AS lat, round(degrees(atan2(ay, ax)), 6) AS lon FROM vs")
def to_latlon(spark, sf_dir):
    lat, lon = geo.latlon(*geo.normalized(A))
    return vectors(spark, sf_dir).select("vec_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"WITH {VECTORS} SELECT vec_id, round({DOT(_U, C)}, 9) AS side, CAST(sign(round({DOT(_U, C)}, 9)) AS INTEGER) AS sgn FROM vs")
def gc_side(spark, sf_dir):
    side = F.round(geo.dot(geo.cross(A, B), C), 9)
    return vectors(spark, sf_dir).select("vec_id", side.alias("side"), F.signum(side).cast("int").alias("sgn"))


_P, _Q = vec("lat1", "lon1"), vec("lat2", "lon2")


@query(f"{ctes('articles_g')}, {PAIRS} SELECT seq, round(acos(greatest(-1e0, least(1e0, {DOT(_P, _Q)}))) * {R}, 1) AS acos_m, round({hav('lat1', 'lon1', 'lat2', 'lon2')} * {R}, 1) AS hav_m, round({chord(_P, _Q)} * {R}, 1) AS chord_m FROM pairs")
def dist_metrics(spark, sf_dir):
    p, q = geo.cartesian("lat1", "lon1"), geo.cartesian("lat2", "lon2")
    return pairs(spark, sf_dir).select("seq", F.round(geo.metres(geo.acos_angle(p, q)), 1).alias("acos_m"), F.round(geo.metres(geo.haversine("lat1", "lon1", "lat2", "lon2")), 1).alias("hav_m"), F.round(geo.metres(geo.chord_angle(p, q)), 1).alias("chord_m"))


_BEARING = "degrees(atan2(sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1))))"


@query(f"{ctes('articles_g')}, {PAIRS} SELECT seq, round(fmod({_BEARING} + 360, 360e0), 6) AS bearing FROM pairs")
def bearing(spark, sf_dir):
    return pairs(spark, sf_dir).select("seq", F.round(geo.bearing("lat1", "lon1", "lat2", "lon2"), 6).alias("bearing"))


_N = CROSS(tuple(f"({y} - {x})" for x, y in zip(A, B, strict=True)), tuple(f"({y} - {x})" for x, y in zip(A, C, strict=True)))


@query(f"WITH {VECTORS}, n AS (SELECT *, {_N[0]} AS nx, {_N[1]} AS ny, {_N[2]} AS nz FROM vs), u AS (SELECT *, nx / sqrt(nx * nx + ny * ny + nz * nz) AS ux, ny / sqrt(nx * nx + ny * ny + nz * nz) AS uy, nz / sqrt(nx * nx + ny * ny + nz * nz) AS uz FROM n), s AS (SELECT *, CASE WHEN ux * (ax + bx + cx) + uy * (ay + b_y + cy) + uz * (az + bz + cz) < 0 THEN -1 ELSE 1 END AS sg FROM u) SELECT vec_id, round(ux * sg, 9) AS x, round(uy * sg, 9) AS y, round(uz * sg, 9) AS z FROM s")
def circumcenter(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", *[F.round(v, 9).alias(n) for v, n in zip(geo.circumcenter(A, B, C), "xyz", strict=True)])


@query(f"{ctes('articles_g')}, c AS (SELECT seq, lon + (seq % 7 - 3) * 360 AS lon, (seq % 72) * 5 - 177.5e0 AS center FROM articles_g) SELECT seq, round(lon - 360 * (CASE WHEN lon - center > 180 THEN ceil((lon - center - 180) / 360) WHEN lon - center < -180 THEN -ceil((center - lon - 180) / 360) ELSE 0 END), 6) AS unwrapped, round(CASE WHEN lon - center > 180 THEN lon - 360 WHEN lon - center < -180 THEN lon + 360 ELSE lon END, 6) AS shifted FROM c")
def lon_unwrap(spark, sf_dir):
    rows = view(spark, sf_dir, "articles_g").selectExpr("seq", "lon + (seq % 7 - 3) * 360 AS lon", "(seq % 72) * 5 - 177.5e0 AS center")
    return rows.select("seq", F.round(geo.unwrapped_lon("lon", F.col("center")), 6).alias("unwrapped"), F.round(geo.shifted_lon("lon", F.col("center")), 6).alias("shifted"))


@query(f"{ctes('articles_g')} SELECT seq, {weight('len')} AS weight FROM articles_g")
def weight_class(spark, sf_dir):
    return view(spark, sf_dir, "articles_g").select("seq", geo.weight_class("len").alias("weight"))


@query(f"{ctes('articles_g')} SELECT seq, {kept(_V[0])} AS x, {kept(_V[1])} AS y, {kept(_V[2])} AS z FROM articles_g")
def quantize(spark, sf_dir):
    return view(spark, sf_dir, "articles_g").select("seq", *[geo.stored(v).alias(n) for v, n in zip(geo.cartesian("lat", "lon"), "xyz", strict=True)])


@query("SELECT p_partkey, replace(p_name, '_', ' ') AS title, replace(replace(replace(replace(url_encode(replace(p_name || ' & (' || p_brand || ')', ' ', '_')), '%28', '('), '%29', ')'), '%27', ''''), '%21', '!') AS slug FROM part")
def title_slug(spark, sf_dir):
    full = F.concat("p_name", F.lit(" & ("), "p_brand", F.lit(")"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.display_title("p_name").alias("title"), text.slug(full).alias("slug"))


@query(f"{ctes('articles_g')}, m AS (SELECT seq, (seq * 7919 % 2000003) / 16e0 AS m FROM articles_g), t AS (SELECT *, CAST(floor(m / 100 + 0.5) AS BIGINT) AS tenths FROM m) SELECT seq, CASE WHEN m < 1000 THEN CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR) || ' m' WHEN m >= 10000 THEN CAST(CAST(floor(m / 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' km' ELSE CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) || ' km' END AS label FROM t")
def format_distance(spark, sf_dir):
    return view(spark, sf_dir, "articles_g").selectExpr("seq", "(seq * 7919 % 2000003) / 16e0 AS m").select("seq", text.distance_label("m").alias("label"))


@query(f"{ctes('articles_g')}, t AS (SELECT DISTINCT {tid(ROW, COL)} AS id FROM articles_g) SELECT id, CAST(((((((((ascii(id[1]) * 31 + ascii(id[2])) * 31 + ascii(id[3])) * 31 + ascii(id[4])) * 31 + ascii(id[5])) + 2147483648) % 4294967296 - 2147483648) % 12 + 12) % 12) AS INTEGER) AS hue FROM t")
def tile_hue(spark, sf_dir):
    ids = view(spark, sf_dir, "articles_g").select(geo.tile_id(geo.tile_row("lat"), geo.tile_col("lon")).alias("id")).distinct()
    return ids.select("id", text.hue("id", 12).alias("hue"))


@query("WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 100 AS VARCHAR) WHEN 1 THEN 'soon' WHEN 2 THEN NULL WHEN 3 THEN '-5' ELSE '1.5' END AS v FROM events) SELECT event_id, CASE WHEN try_cast(v AS DOUBLE) > 0 THEN try_cast(v AS DOUBLE) * 1000 ELSE 1800000e0 END AS ms FROM v")
def retry_after(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN CAST(event_id % 100 AS STRING) WHEN 1 THEN 'soon' WHEN 2 THEN NULL WHEN 3 THEN '-5' ELSE '1.5' END AS v")
    return rows.select("event_id", text.retry_after_ms("v").alias("ms"))


_HEADINGS = ["event_id", "CASE WHEN event_id % 3 = 0 THEN event_id % 800 - 20e0 END AS webkit", "event_id % 2 = 0 AS absolute", "CASE WHEN event_id % 7 <> 0 THEN (event_id * 37 % 3600) / 10e0 END AS alpha"]


@query(f"WITH h AS (SELECT {', '.join(_HEADINGS)} FROM events) SELECT event_id, round(CASE WHEN webkit IS NOT NULL THEN CASE WHEN webkit >= 0 THEN fmod(webkit, 360e0) END WHEN absolute AND alpha IS NOT NULL THEN fmod(720e0 - alpha, 360e0) END, 6) AS heading FROM h")
def heading_norm(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_HEADINGS).select("event_id", F.round(text.heading("webkit", F.col("absolute"), "alpha"), 6).alias("heading"))


_LINK = "printf('#%.4f,%.4f', lat, lon) || '&lang=' || lang || CASE WHEN seq % 3 = 0 THEN '&filter=all' ELSE '' END"


@query(f"{ctes('articles_g')} SELECT seq, {_LINK} AS link, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang END AS lang, CASE WHEN seq % 3 = 0 THEN 'all' END AS mode FROM articles_g")
def permalink(spark, sf_dir):
    rows = view(spark, sf_dir, "articles_g")
    link = text.permalink("lat", "lon", "lang", F.when(F.col("seq") % 3 == 0, F.lit("all")).otherwise(F.lit("highlights")))
    out = rows.select("seq", link.alias("link"))
    return out.select("seq", "link", *[v.alias(k) for k, v in text.parsed_permalink("link").items()])


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.' || json_keys(props)[1])) AS first_values, CAST(sum(len(json_keys(props))) AS BIGINT) AS keys FROM events GROUP BY event_type")
def events_json(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("m", F.from_json("props", "map<string,string>"))
    first = F.element_at(F.map_values("m"), 1)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count(first).alias("first_values"), F.sum(F.size("m")).alias("keys"))
