"""Boundary rows, codecs and structural invariants."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import cli
from nearfield.functions import geo, paging, text
from nearfield.operators import extract, knn, mesh, store, tiling
from nearfield.plans.catalog import QUERIES
from nearfield.sources import blob, dump
from nearfield.streaming import positions


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


@pytest.mark.parametrize(("lat", "lon", "cell"), [(0.1, 0.1, (18, 36)), (-89, 0, (0, 36)), (89, 0, (35, 36)), (0, -170, (18, 2)), (59.33, 18.07, (29, 39)), (9.99, 0, (19, 36)), (90, 0, (35, 36)), (0, 180, (18, 71))])
def test_cells(spark, lat, lon, cell):
    assert tuple(one(spark, geo.tile_row(F.lit(float(lat))), geo.tile_col(F.lit(float(lon))))) == cell


@pytest.mark.parametrize(("size", "weight"), [(1024, 80), (8192, 104), (1, 1), (0, 0), (-5, 0), (None, 0), (10**30, 255)])
def test_weight_class(spark, size, weight):
    value = F.lit(None if size is None else float(size)).cast("double")
    assert one(spark, geo.weight_class(value))[0] == weight


def test_bearings(spark):
    b = lambda *p: one(spark, geo.bearing(*[F.lit(float(x)) for x in p]))[0]
    assert [round(b(*p), 6) for p in ((0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1), (0, 0, 0, -1), (0, 179.5, 0, -179.5))] == [0, 180, 90, 270, 90]
    assert abs(b(51.5074, -0.1278, 40.7128, -74.006) - 288.3) < 0.2


def test_radar_rings(spark):
    rings = lambda m: one(spark, text.radar_rings(F.lit(float(m))))[0]
    assert rings(3400) == [1000, 2000, 3000, 4000]
    assert rings(90) == [25, 50, 75, 100]
    assert rings(18000) == [5000, 10000, 15000, 20000]
    assert rings(0) == [250, 500, 750, 1000]


def test_permalinks(spark):
    links = ["#41.8902,12.4922&lang=en&filter=all", "", "#1,2,3", "#91,0", "#x,0", "#1,2&lang=xx&filter=no", "#1,2&lang"]
    rows = spark.createDataFrame([(x,) for x in links], "link string").select("link", *[v.alias(k) for k, v in text.parsed_permalink("link").items()]).collect()
    assert [tuple(r)[1:] for r in rows] == [(41.8902, 12.4922, "en", "all"), *[(None,) * 4] * 4, (1, 2, None, None), (1, 2, None, None)]


MEMBERS = [("inside", 12, 2), ("south", 9.8, 2), ("north", 15.3, 2), ("outside", 7, 2), ("edge", 10, 0), ("on-north", 15, 2), ("on-east", 12, 5)]


def test_tile_members_at_edges(spark):
    rows = spark.createDataFrame([(k, t, float(a), float(b), 100) for k, (t, a, b) in enumerate(MEMBERS)], "seq long, title string, lat double, lon double, len long")
    found = {r.title: r.native for r in tiling.members(rows).where("tile_id = '20-36'").collect()}
    assert found == {"inside": True, "south": False, "north": False, "edge": True, "on-north": False, "on-east": False}


def test_members_across_the_antimeridian(spark):
    rows = spark.createDataFrame([(k, str(b), 12.0, float(b), 1) for k, b in enumerate((-178, -177, -176, 179.8, 170, 180, 178, 177, -179.8))], "seq long, title string, lat double, lon double, len long")
    found = tiling.members(rows)
    first = {r.title: r.native for r in found.where("tile_id = '20-00'").collect()}
    assert first["179.8"] is False and "170.0" not in first and first["-178.0" if "-178.0" in first else "-178"] is True
    assert first["180"] is True  # exactly 180 counts for the first column


def test_invalid_coordinates(spark):
    rows = [(0.0, 0.0), (math.nan, 1.0), (91.0, 0.0), (90.0, 180.0), (None, 1.0), (0.0, 1.0)]
    kept = spark.createDataFrame(rows, "lat double, lon double").where(extract.valid_coordinate()).collect()
    assert [tuple(r) for r in kept] == [(90.0, 180.0), (0.0, 1.0)]


def test_extract_last_page_first_title(spark):
    pages = spark.createDataFrame([(1, 7, 0, 0, "Old", "5"), (2, 7, 0, 0, "New_name", "garbage"), (3, 8, 0, 1, "Gone", "1")], "seq long, page_id long, ns int, redirect int, title string, page_len string")
    places = spark.createDataFrame([(1, 7, "earth", 1, 2.0, 3.0), (2, 7, "earth", 1, 4.0, 5.0), (3, 8, "earth", 1, 1.0, 1.0), (4, 7, "moon", 1, 1.0, 1.0)], "seq long, page_id long, globe string, prim int, lat double, lon double")
    assert [tuple(r) for r in extract.extract(pages, places).collect()] == [(1, "New name", 2.0, 3.0, None)]


def test_dump_tuples():
    text_ = r"(1,'it\'s',NULL,-3.14),(2,'a,(b)','NULL',NULLABLE),(3,'x\n\\','',1);"
    assert list(dump.tuples(text_)) == [["1", "it's", None, "-3.14"], ["2", "a,(b)", "NULL", "NULLABLE"], ["3", "x\n\\", "", "1"]]


def test_dump_header_of_any_length(spark, tmp_path):
    path = tmp_path / "wide.sql"
    names = [f"c{k}" for k in range(700)]
    head = ["-- dump", "CREATE TABLE `geo` (", *[f"  `{x}` int," for x in names], "  PRIMARY KEY (`c0`)", ") ENGINE=InnoDB;", "CREATE TABLE `other` (", "  `later` int", ");"]
    path.write_text("\n".join([*head, f"INSERT INTO `geo` VALUES ({','.join(map(str, range(700)))});"]) + "\n")
    assert [(r.c699, r.c0) for r in dump.scan(spark, str(path), "geo", ["c699", "c0"]).collect()] == [("699", "0")]
    with pytest.raises(ValueError, match="later"):
        dump.scan(spark, str(path), "geo", ["later"])


def test_dump_needs_table_and_columns(spark, tmp_path):
    path = tmp_path / "t.sql.gz"
    path.write_bytes(gzip.compress(b"CREATE TABLE `geo` (\n  `a` int,\n  `b` int\n);\nINSERT INTO `geo` VALUES (1,2),(3,NULL);\n"))
    assert [(r.b, r.a) for r in dump.scan(spark, str(path), "geo", ["b", "a"]).orderBy("seq").collect()] == [("2", "1"), (None, "3")]
    with pytest.raises(ValueError, match="no table"):
        dump.scan(spark, str(path), "page", ["a"])
    with pytest.raises(ValueError, match="no column c"):
        dump.scan(spark, str(path), "geo", ["c"])


def test_dump_tuples_of_other_lengths(spark, tmp_path):
    """Values are taken by their place; a tuple that ends before one has null there, and none is dropped."""
    path = tmp_path / "t.sql.gz"
    path.write_bytes(gzip.compress(b"CREATE TABLE `geo` (\n  `a` int,\n  `b` int\n);\nINSERT INTO `geo` VALUES (1,2),(3),(4,5,6);\n"))
    assert [(r.a, r.b) for r in dump.scan(spark, str(path), "geo", ["a", "b"]).orderBy("seq").collect()] == [("1", "2"), ("3", None), ("4", "5")]


def test_arguments_and_dump_paths():
    assert cli.parsed([]) == cli.Options() and cli.parsed(["--limit=5", "--other", "--lang=de", "--bounds=1,2,3,4"]) == cli.Options("de", 5, {"west": 1, "south": 2, "east": 3, "north": 4})
    for bad in ("--limit=0", "--limit=x", "--limit=", "--lang=xx", "--bounds=1,2,3", "--bounds=1,2,3,nan"):
        with pytest.raises(ValueError):
            cli.parsed([bad])
    assert cli.dump_path("en", "page") == "data/dumps/enwiki-latest-page.sql.gz"
    with pytest.raises(ValueError, match="no dump"):
        cli.dump_path("en", "links")


def test_labels_and_stored_values(spark):
    size = lambda n: one(spark, text.bytes_label(F.lit(n)))[0]
    assert [size(n) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB"]
    way = lambda p: one(spark, text.directions(F.lit(1.5), F.lit(-2.0), F.lit(p)))[0]
    assert [way(p).split("1.5,-2.0")[0] for p in ("ios", "android", "web")] == ["https://maps.apple.com/?daddr=", "geo:", "https://www.google.com/maps/dir/?api=1&destination="]
    boost = lambda a, b: one(spark, text.sweep_boost(F.lit(float(a)), F.lit(float(b))))[0]
    assert (boost(10, 10), boost(10, 70), boost(10, 130), boost(350, 50), boost(10, 0)) == (1.0, 0.5, 0.0, 0.5, 0.0)
    stored = lambda v: one(spark, text.or_default(F.lit(v).cast("string"), ("en", "de"), "en"))[0]
    assert [stored(v) for v in ("de", "xx", None)] == ["de", "en", "en"]


def test_landmarks_are_required(spark):
    report = lambda *n: spark.createDataFrame([n], "matched long, missing long, mismatched long")
    extract.require_canary(report(1, 5, 0))
    extract.require_canary(report(0, 5, 0), bounded=True)
    for bad, bounded in ((report(0, 5, 0), False), (report(3, 0, 1), False), (report(3, 0, 1), True)):
        with pytest.raises(ValueError, match="landmark"):
            extract.require_canary(bad, bounded)


def test_windows_of_loaded_segments(spark):
    """Covered and missing ranges at their ends, and eviction from the farther end."""
    segments = F.expr("array(struct(0L AS start, 10L AS end), struct(20L AS start, 30L AS end))")
    at = lambda a, b: tuple(one(spark, paging.covered(segments, F.lit(a), F.lit(b)).alias("c"), paging.first_missing(segments, F.lit(a), F.lit(b)).alias("m")))
    assert [at(0, 10), at(3, 3), at(5, 15), at(10, 15), at(15, 40), at(25, 40), at(8, 25)] == [(True, None), (True, None), (False, (10, 15)), (False, (10, 15)), (False, (15, 20)), (False, (30, 40)), (False, (10, 20))]
    kept = lambda a, b, n: [tuple(x) for x in one(spark, paging.evicted(segments, F.lit(a), F.lit(b), n))[0]]
    assert kept(20, 30, 12) == [(8, 10), (20, 30)] and kept(0, 10, 12) == [(0, 10), (20, 22)] and kept(20, 30, 5) == [(25, 30)] and kept(0, 10, 99) == [(0, 10), (20, 30)]
    flying = one(spark, F.array_sort(paging.in_flight(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.array(F.lit("a")))))[0]
    assert flying == ["b", "c"]


def test_orientation_has_an_exact_sign():
    a, b, c = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
    assert mesh.orient(a, b, c, (0, 0, 0)) > 0 > mesh.orient(a, b, c, (1, 1, 1)) and mesh.orient(a, b, c, (1 / 4, 1 / 4, 1 / 2)) == 0
    tiny = 2.0**-60  # far below the rounding of the plain formula
    p, q, r = (0.1, 0.2, 0.3), (0.7, 0.1, 0.9), (0.4, 0.8, 0.5)
    flat = tuple((x + y + z) / 3 for x, y, z in zip(p, q, r, strict=True))
    from fractions import Fraction

    def exact(d):
        m = [[Fraction(y) - Fraction(x) for x, y in zip(p, v, strict=True)] for v in (q, r, d)]
        return -(m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    for d in (flat, (flat[0], flat[1], flat[2] + tiny), (flat[0] + 2e-17, flat[1], flat[2]), tuple(np.nextafter(flat, 1))):
        assert np.sign(mesh.orient(p, q, r, d)) == np.sign(float(exact(d)))


def test_triangles_have_empty_circles_and_hold_their_places():
    """The Delaunay property, circumcentres at one distance, and walks that end in the face that holds the place."""
    rng = np.random.default_rng(21)
    p = rng.normal(size=(250, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    v, nb = mesh.hull(p)
    centers, radii = mesh.circles(p, v)
    for k in range(3):
        assert np.allclose(np.arccos(np.clip((centers * p[v[:, k]]).sum(axis=1), -1, 1)), radii, atol=1e-4)
    assert (np.arccos(np.clip(centers @ p.T, -1, 1)).min(axis=1) > radii - 1e-4).all()
    for _ in range(50):
        place = rng.normal(size=3)
        way = mesh.walk(p, v, nb, place / np.linalg.norm(place), int(rng.integers(len(v))))
        a, b, c = p[v[way[-1]]]
        assert all(np.cross(x, y) @ place >= 0 for x, y in ((a, b), (b, c), (c, a))) and all(w in nb[u] for u, w in zip(way, way[1:], strict=False))
    points, faces, used = mesh.compacted(np.vstack([p[:1], p]), v + 1)
    assert (points == p).all() and (faces == v).all() and used.tolist() == list(range(1, 251))


def test_drawn_segments_and_neighbours(spark):
    rows = [("36-00", 0, 0.0, 179.9), ("36-00", 1, 0.5, -179.9), ("36-00", 2, -40.0, 0.0)]
    x, y, z = geo.cartesian("lat", "lon")
    vertices = spark.createDataFrame(rows, "tile_id string, v int, lat double, lon double").select("tile_id", "v", x.alias("x"), y.alias("y"), z.alias("z"))
    triangles = spark.createDataFrame([("36-00", 0, [0, 1, 2], [1, 1, 1]), ("36-00", 1, [1, 0, 2], [0, 0, 0])], "tile_id string, t int, v array<int>, n array<int>")
    found = mesh.segments(mesh.drawn(triangles, vertices), 178.0).collect()
    assert [(round(r.a_lon, 6), round(r.b_lon, 6)) for r in found] == [(179.9, 180.1)]  # the long edges are left out
    box = lambda w, e: {"south": -1, "north": 1, "west": w, "east": e}
    assert [mesh.segments(mesh.drawn(triangles, vertices), 178.0, box(*b)).count() for b in ((179, 180), (-180.5, -179.5), (0, 10))] == [1, 1, 0]
    assert {r.v: r.neighbours for r in mesh.vertex_neighbours(triangles).collect()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    masked = triangles.select("tile_id", "t")
    assert mesh.vertex_neighbours(triangles, masked).count() == 0


def test_blob_files_and_graphs(spark, tmp_path):
    p = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1.0]])
    v, nb = mesh.hull(p)
    data = blob.encode(p, v, nb, list("abcdef"), np.arange(6))
    tiles = spark.createDataFrame([("18-36", bytearray(data)), ("18-37", bytearray(data))], "tile_id string, data binary")
    assert len(blob.exported(tiles, str(tmp_path / "bin")).collect()) == 2
    read = blob.files(spark, str(tmp_path / "bin"))
    assert sorted((r.tile_id, bytes(r.data)) for r in read.collect()) == [("18-36", data), ("18-37", data)]
    assert blob.vertices(read).count() == 12
    tile = blob.decode(data)
    back = blob.arrays(blob.graph(tile))
    assert all((back[k] == tile[k]).all() for k in back)


@pytest.mark.parametrize("n", [4, 50, 400])
def test_hull_is_closed(n):
    rng = np.random.default_rng(n)
    p = rng.normal(size=(n, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    p[n // 2 :] = p[: n - n // 2] if n == 400 else p[n // 2 :]  # coincident points stay vertices
    v, nb = mesh.hull(p)
    assert len(v) == 2 * n - 4 and len(np.unique(v)) == n
    for t in range(len(v)):
        for e in range(3):
            other = nb[t, e]
            back = [k for k in range(3) if nb[other, k] == t]
            assert any({v[other, k], v[other, (k + 1) % 3]} == {v[t, e], v[t, (e + 1) % 3]} for k in back)


def crowded(places, copies):
    """Places of a hundredth of a degree in one tile, each with copies."""
    rng = np.random.default_rng(places)
    lat, lon = np.radians(45 + rng.integers(0, 600, places) / 100), np.radians(5 + rng.integers(0, 600, places) / 100)
    p = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    return np.tile(p.astype(np.float32).astype(float), (copies, 1))


@pytest.mark.parametrize(("places", "copies"), [(300, 40), (2, 1500), (20, 500)])
def test_hull_of_many_copies(places, copies):
    p = crowded(places, copies)
    v, nb = mesh.hull(p)
    assert len(v) == 2 * len(p) - 4 and len(np.unique(v)) == len(p)
    sides = {(int(x), int(y)): t for t, c in enumerate(v) for x, y in zip(c, np.roll(c, -1), strict=True)}
    assert len(sides) == 3 * len(v) and all(nb[t, e] == sides[int(v[t, (e + 1) % 3]), int(v[t, e])] for t in range(len(v)) for e in range(3))
    q = mesh.projected(mesh.spread(p)).tolist()
    for t in range(0, len(v), 7):  # no neighbour lies in a face's circle
        for other in nb[t]:
            assert all(mesh.in_circle(*[q[x] for x in v[t]], q[w]) <= 0 for w in v[other])


@pytest.mark.parametrize("turned", [False, True])
def test_edges_beside_left_out_faces_are_drawn(spark, turned):
    p = crowded(30, 2)
    v, nb = mesh.hull(p)
    if turned:  # the same mesh, its faces numbered from the end
        v, nb = v[::-1], len(v) - 1 - nb[::-1]
    data = blob.encode(p, v, nb, [str(k) for k in range(len(p))], np.ones(len(p)))
    tiles = spark.createDataFrame([("27-37", bytearray(data))], "tile_id string, data binary")
    triangles, vertices = blob.triangles(tiles), blob.vertices(tiles).select("tile_id", "v", "x", "y", "z")
    assert [(r.t, r.v, r.n) for r in triangles.orderBy("t").collect()] == [(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(v, nb, strict=True))]
    back = mesh.back_faces(triangles, vertices)
    hidden = {r.t for r in back.collect()}
    drawn = mesh.drawn(triangles.join(back, ["tile_id", "t"], "left_anti"), vertices).collect()
    wanted = {(min(x, y), max(x, y)) for t, c in enumerate(v.tolist()) if t not in hidden for x, y in zip(c, c[1:] + c[:1], strict=True)}
    assert hidden and len(drawn) == len(wanted) and {(r.a, r.b) for r in drawn} == wanted


def crowded_members(spark, places, copies):
    rows = [("27-37", k, f"Doc {k}", k % 256, *map(float, x)) for k, x in enumerate(crowded(places, copies))]
    return spark.createDataFrame(rows, "tile_id string, seq long, title string, weight int, x double, y double, z double")


def test_statistics_make_each_hull_once(spark, capsys):
    found = mesh.stats(mesh.triangles(crowded_members(spark, 2, 1500)))
    found.explain()
    assert capsys.readouterr().out.count("FlatMapGroupsIn") == 1
    assert [tuple(r) for r in found.collect()] == [("27-37", 2 * 3000 - 4, 3 * 3000 - 6, 3000)]


def test_neighbours_of_many_copies(spark):
    triangles = mesh.triangles(crowded_members(spark, 20, 200))
    ends = mesh.edges(triangles).select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
    assert ends.agg(F.count("*"), F.sum("count"), F.min("count") >= 3).head()[:] == (4000, 6 * 4000 - 12, True)
    around = {r.v: r.neighbours for r in mesh.vertex_neighbours(triangles).collect()}
    assert {r.v: r["count"] for r in ends.collect()} == {v: len(w) for v, w in around.items()}
    assert all(v in around[w] for v, near in around.items() for w in near)


def test_blob_of_many_copies(spark):
    members = crowded_members(spark, 10, 300)
    row = blob.blobs(members).head()
    tile = blob.decode(bytes(row.data))
    assert row.bytes == len(row.data) and tile["titles"] == [f"Doc {k}" for k in range(3000)] and tile["weights"].tolist() == [k % 256 for k in range(3000)]
    assert (tile["points"] == crowded(10, 300)).all() and len(tile["faces"]) == 2 * 3000 - 4
    assert all(v in tile["faces"][t] for v, t in enumerate(tile["incident"]))


def test_circle_test_has_an_exact_sign():
    a, b, c = (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)
    assert mesh.in_circle(a, b, c, (1.0, 1.0)) == 0
    assert mesh.in_circle(a, b, c, (1.0, 1 - 2.0**-53)) > 0 > mesh.in_circle(a, b, c, (1.0, 1 + 2.0**-52))
    assert mesh.in_circle(a, c, b, (1.0, 1 - 2.0**-53)) < 0 < mesh.in_circle(a, c, b, (1.0, 1 + 2.0**-52))


def test_hull_needs_space():
    with pytest.raises(ValueError, match="four"):
        mesh.hull(np.eye(3))


def test_blob_round_trip_and_damage():
    p = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1.0]])
    v, nb = mesh.hull(p)
    data = blob.encode(p, v, nb, list("abcdéf"), np.arange(6))
    back = blob.decode(data)
    assert back["titles"] == list("abcdéf") and (back["faces"] == v).all() and (back["neighbours"] == nb).all() and (back["points"] == p).all()
    for bad in (data[:10], b"XXXX" + data[4:], data[:4] + b"\1" + data[5:], data[:8] + b"\xff\xff\xff\x0f" + data[12:], data[:-1], data[:-1] + b"x"):
        with pytest.raises(blob.BlobError):
            blob.decode(bad)


def test_movement_rule(spark):
    rows = [(1, k, lat, lon) for k, (lat, lon) in enumerate([(48.8584, 2.2945), (48.85841, 2.29451), (48.8586, 2.2948)])]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, lat double, lon double").withColumn("ts", F.timestamp_seconds("event_id"))
    assert sorted(r.event_id for r in positions.accepted(frame).collect()) == [0, 2]


def test_k_must_be_positive(spark):
    rows = spark.createDataFrame([], "pid long, title string, seq long, distance_m double")
    with pytest.raises(ValueError, match="k is 1"):
        knn.ranked(rows, 0)


def test_segments(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 12), (1, 11, 11), (2, 3, 4)], "key long, start long, end long")
    assert sorted(map(tuple, knn.merged_segments(rows).collect())) == [(1, 0, 9), (1, 10, 12), (2, 3, 4)]


def places(rng, n, spots):
    """Places around the given spots: poles and the antimeridian included."""
    out = []
    for _ in range(n):
        lat, lon = spots[rng.integers(len(spots))]
        out.append((float(np.clip(lat + rng.normal() * 3, -90, 90)), float((lon + rng.normal() * 4 + 180) % 360 - 180)))
    return out


def nearest_by_all_pairs(articles, at, k):
    """Titles by distance over the vectors as they are kept."""
    def vector(lat, lon):
        a, b = math.radians(lat), math.radians(lon)
        return np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])

    kept = {t: np.floor(vector(*p) * 1e8 + 0.5).astype(float) / 1e8 for t, p in articles}
    kept = {t: v.astype(np.float32).astype(float) for t, v in kept.items()}
    far = [(round(2 * math.asin(min(1.0, float(np.linalg.norm(vector(*at) - v)) / 2)) * 6_371_000, 3), t) for t, v in kept.items()]
    return sorted(far)[:k]


def test_neighbours_equal_all_pairs(spark, tmp_path):
    """Global and tiled search over a stored index against all pairs: dense and empty regions, poles, the antimeridian."""
    rng = np.random.default_rng(12)
    spots = [(89, 10), (-88, 170), (10, 179.5), (48.8, 2.3), (48.8, 2.3), (0, 0)]
    held = [(f"t{k}", p) for k, p in enumerate(places(rng, 500, spots))]
    rows = spark.createDataFrame([(k, t, *p, 100 * k) for k, (t, p) in enumerate(held)], "seq long, title string, lat double, lon double, len long")
    index = store.build(rows, str(tmp_path / "index"))
    asked = places(rng, 40, [*spots, (-40, -100)]) + [(90.0, 0.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    at = spark.createDataFrame([(k, *p) for k, p in enumerate(asked)], "pid long, lat double, lon double")
    for k in (1, 7):
        got = {}
        for r in knn.everywhere(at, index, k).orderBy("pid", "rank").collect():
            got.setdefault(r.pid, []).append((r.distance_m, r.title))
        for pid, p in enumerate(asked):
            want = nearest_by_all_pairs(held, p, k)
            assert [t for _, t in got[pid]] == [t for _, t in want] and np.allclose([d for d, _ in got[pid]], [d for d, _ in want], atol=0.01)
    chosen = {}
    for r in tiling.for_positions(at, index.codes).collect():
        chosen.setdefault(r.pid, set()).add(r.tile_id)
    pool = {}
    for r in index.members.collect():
        pool.setdefault(r.tile_id, set()).add(r.title)
    known = dict(held)
    got = {}
    for r in knn.tiled(at, index, 5).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append(r.title)
    for pid, p in enumerate(asked):
        titles = set().union(*[pool[t] for t in chosen[pid]])
        assert got[pid] == [t for _, t in nearest_by_all_pairs([(t, known[t]) for t in titles], p, 5)]


def test_pages_of_one_result_differ_without_a_join(spark, capsys):
    rows = spark.createDataFrame([(p, r, f"t{p * 7 + r}") for p in (1, 2) for r in range(1, 16 if p == 1 else 8)], "pid long, rank int, title string")
    old, new = F.col("rank") <= 10, F.col("rank") > 5
    want = sorted(map(tuple, knn.diff(rows.where(old), rows.where(new)).collect()))
    assert sorted(map(tuple, knn.page_diff(rows, old, new).collect())) == want and len(want) == 22
    assert sorted(map(tuple, knn.page_diff(rows, F.col("rank") < 3, F.col("rank") == 5).collect())) == sorted(map(tuple, knn.diff(rows.where("rank < 3"), rows.where("rank = 5")).collect()))
    QUERIES["result_diff"](spark, "/root/testdata/sf0.001").explain()
    assert "FullOuter" not in capsys.readouterr().out


def test_copies_of_places_are_read_once(spark, tmp_path):
    """Many articles and positions at few places: one position a place is asked, few articles a place are read, results are whole."""
    spots = [(48.1, 2.1), (48.2, 2.2), (48.9, 2.9), (49.9, 4.9)]
    held = [(f"t{k:03d}", spots[k % 4]) for k in range(400)]
    index = store.build(spark.createDataFrame([(k, t, *p, 100 * (k % 9)) for k, (t, p) in enumerate(held)], "seq long, title string, lat double, lon double, len long"), str(tmp_path / "index"))
    asked = [(48.15, 2.15), (49.95, 4.95)]
    at = spark.createDataFrame([(k, *asked[k % 2]) for k in range(200)] + [(None, *asked[0]), (7, *asked[1])], "pid long, lat double, lon double")
    assert knn.pairs(at.limit(2), index, 3).groupBy("pid", "tile_id", "x").count().agg(F.max("count")).head()[0] == 3
    stands = []

    def found(places):
        stands.append(sorted((r.pid, r.lat, r.lon) for r in places.collect()))
        return knn.at_places(places, index, 103)

    got = {}
    for r in knn.by_place(at, found).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append(r.title)
    assert stands == [[(k, *p) for k, p in enumerate(asked)]] and sorted(got) == list(range(200))
    assert all(got[k] == [t for _, t in nearest_by_all_pairs(held, asked[k % 2], 103)] for k in got)
    changed = {r.pid: (r.change, r.set_differs) for r in knn.by_place(at, lambda p: positions.result_change(knn.at_places(p, index, 5), knn.at_places(p, index, 5, 1))).collect()}
    assert changed == {k: (("distances", False) if k % 2 else ("list", True)) for k in range(200)}  # t000 has no weight


def test_manifest_shape(spark, tmp_path):
    """No manifest, no JSON or another shape is no index; a title is kept once."""
    import json

    path = tmp_path / "index"
    assert store.read(spark, str(path)) is None and knn.nearby(spark.createDataFrame([(1, 0.0, 0.0)], "pid long, lat double, lon double"), None, 3).count() == 0
    rows = spark.createDataFrame([(k, f"t{k % 5}", 1.0 + k / 10, 1.0, 10) for k in range(9)], "seq long, title string, lat double, lon double, len long")
    built = store.build(rows, str(path))
    held = store.read(spark, str(path))
    assert held.manifest == built.manifest and held.tiles.count() == 1 and held.members.count() == held.articles.count() == 5
    assert held.manifest["hash"] == store.combined([t["hash"] for t in held.manifest["tiles"]])
    good = held.manifest
    bad = ["{", "[]", "null", json.dumps({**good, "version": 99}), json.dumps({**good, "tiles": {}}), json.dumps({**good, "gridDeg": 10}), json.dumps({k: v for k, v in good.items() if k != "hash"})]
    bad += [json.dumps({**good, "tiles": [{**good["tiles"][0], **x}]}) for x in ({"row": 36}, {"col": -1}, {"articles": "5"}, {"bytes": None}, {"hash": 7})]
    for text_ in bad:
        spark.createDataFrame([(text_,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        assert store.read(spark, str(path)) is None
    again = store.build(rows, str(path))
    assert again.manifest["hash"] == good["hash"] and again.manifest["members"] != good["members"]
    empty = store.build(rows.limit(0), str(tmp_path / "none"))
    assert empty.tiles.count() == 0 and store.read(spark, empty.path).members.count() == 0
    at = spark.createDataFrame([(1, 0.0, 0.0)], "pid long, lat double, lon double")
    assert knn.tiled(at, empty, 3).count() == 0 and knn.everywhere(at, empty, 3).count() == 0


def test_entry_without_the_corpus_package():
    """A copy of the tree without the corpus folders still imports, and its other queries are there."""
    import shutil
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as copy:
        shutil.copytree(root / "nearfield", f"{copy}/nearfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", copy)
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), 'knn_tiled' in q, any(n.startswith('op') or n == 'pipeline' for n in q), set(s) <= set(q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1:] == ["True", "False", "True"]
