"""Per-tile spherical meshes: convex hull of unit vectors, its triangle graph, and the drawing filters.

The hull of points on a sphere is their Delaunay triangulation. Coincident points are moved apart by a tiny fixed pseudo-random
step and then put on a plane by stereographic projection, which keeps the hull's faces: a point sees a face if it lies in the
circle of its corners. Places of one plane stay distinct however near they are, and the circle test has an exact sign, so every
row is a vertex. Points are inserted one at a time, near ones after each other in rounds that double: the nearest vertex is found
by steps from the last one, the faces that see the point are found from there, and the hole's border is fanned to the point.
One task handles one tile.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.constants import BACK_DET, DEGENERATE_DET, MAX_EDGE_RAD
from nearfield.functions import geo

TRIANGLES = "tile_id string, t int, v array<int>, n array<int>"
STEP = 1e-6
#: Chord of one degree, squared.
WIDE = (2 * np.sin(np.radians(0.5))) ** 2


def spread(points: np.ndarray) -> np.ndarray:
    """Points moved by a fixed pseudo-random step of at most ``STEP`` and put back on the sphere."""
    moved = points + np.random.default_rng(0x9E3779B9).uniform(-STEP, STEP, points.shape)
    return moved / np.linalg.norm(moved, axis=1, keepdims=True)


def projected(p: np.ndarray) -> np.ndarray:
    """Distinct places of unit vectors on a plane, projected from a direction that is far from all of them; seen from outside,
    turns stay turns."""
    mean, rng = p.mean(axis=0), np.random.default_rng(0x9E3779B9)
    poles = np.vstack([-mean if mean.any() else np.eye(3)[:1], rng.normal(size=(32, 3))])
    poles /= np.linalg.norm(poles, axis=1, keepdims=True)
    pole = poles[(p @ poles.T).max(axis=0).argmin()]
    right = np.cross(np.eye(3)[np.abs(pole).argmin()], pole)
    right /= np.linalg.norm(right)
    q = np.stack([p @ right, p @ np.cross(right, pole)], axis=1) / (1 - p @ pole)[:, None]
    while len(np.unique(q[:, 0] + 1j * q[:, 1])) < len(q):
        q += rng.uniform(-STEP, STEP, q.shape)
    return q


def in_circle(a, b, c, d) -> float:
    """Positive where d lies in the circle of the counter-clockwise a, b, c; its sign is exact: where rounding could change it,
    whole fractions decide."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    al, bl, cl = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    p, q, r, s, t, u = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    value = al * (p - q) + bl * (r - s) + cl * (t - u)
    limit = 2e-15 * (al * (abs(p) + abs(q)) + bl * (abs(r) + abs(s)) + cl * (abs(t) + abs(u)))
    if value > limit or value < -limit:
        return value
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(x) - Fraction(d[0]), Fraction(y) - Fraction(d[1])) for x, y in (a, b, c))
    exact = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    return (exact > 0) - (exact < 0)


def insertion_order(q: np.ndarray) -> np.ndarray:
    """Fixed pseudo-random rounds that double, each along a space-filling curve."""
    low = q.min(axis=0)
    grid = ((q - low) / max(float((q - low).max()), 1e-300) * (2**31 - 1)).astype(np.uint64)
    key = np.zeros(len(q), np.uint64)
    for bit in range(31):
        for axis in (0, 1):
            key |= (grid[:, axis] >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit + axis)
    place = np.random.default_rng(len(q)).permutation(len(q))
    return np.lexsort((key, np.log2(place + 1).astype(int)))


def hull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Faces (vertex triples, outward) and neighbours: n[e] lies across the edge from v[e] to v[e + 1].

    ValueError for fewer than four points, or points in one plane.
    """
    n = len(points)
    if n < 4:
        raise ValueError("a hull needs four points")
    p = spread(points)
    a = 0
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    c = int((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(1).argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.abs((p - p[a]) @ normal).argmax())
    if abs((p[d] - p[a]) @ normal) < 1e-20:
        raise ValueError("the points lie in one plane")
    flat = projected(p)
    order = insertion_order(flat).tolist()
    q = [tuple(x) for x in flat.tolist()]
    side = in_circle(q[a], q[b], q[c], q[d])
    if side == 0:
        raise ValueError("the points lie in one plane")
    if side > 0:
        b, c = c, b
    v = [(a, b, c), (a, d, b), (b, d, c), (c, d, a)]
    nb = [[1, 2, 3], [3, 2, 0], [1, 3, 0], [2, 1, 0]]
    face = {a: 0, b: 0, c: 0, d: 1}  # one face of each vertex

    def sees(k: int, f: int) -> bool:
        x, y, z = v[f]
        return in_circle(q[x], q[y], q[z], q[k]) > 0

    def around(vertex: int):
        """The faces of a vertex, each with the vertex that follows it there."""
        f = first = face[vertex]
        while True:
            corners = v[f]
            e = corners.index(vertex)
            yield f, corners[e - 2]
            f = nb[f][e - 1]
            if f == first:
                return

    last = a
    for k in order:
        if k in face:
            continue
        kx, ky = q[k]
        least = (q[last][0] - kx) ** 2 + (q[last][1] - ky) ** 2
        while True:  # some neighbour of a vertex that isn't the nearest is nearer
            at = last
            for _, w in around(at):
                x, y = q[w]
                away = (x - kx) ** 2 + (y - ky) ** 2
                if away < least:
                    last, least = w, away
            if last == at:
                break
        start = next((f for f, _ in around(last) if sees(k, f)), None)
        if start is None:  # two vertices as near by rounding
            start = next(f for f in range(len(v)) if sees(k, f))
        visible, hidden, border, stack = {start}, set(), {}, [start]
        while stack:
            f = stack.pop()
            corners = v[f]
            for e in (0, 1, 2):
                other = nb[f][e]
                if other in visible:
                    continue
                if other not in hidden:
                    if sees(k, other):
                        visible.add(other)
                        stack.append(other)
                        continue
                    hidden.add(other)
                border[corners[e]] = corners[e - 2], other
        free, made = list(visible), {}
        if len(border) != len(free) + 2:
            raise AssertionError("the visible faces are no disc")
        for at, (to, other) in border.items():
            if free:
                f = free.pop()
                v[f], nb[f] = (at, to, k), [other, -1, -1]
            else:
                f = len(v)
                v.append((at, to, k))
                nb.append([other, -1, -1])
            nb[other][v[other].index(to)] = f
            made[at] = face[at] = f
        for f in made.values():
            following = made[v[f][1]]
            nb[f][1], nb[following][2] = following, f
        last, face[k] = k, f
    return np.array(v, np.int64), np.array(nb, np.int64)


def orient(a, b, c, d) -> float:
    """Six times the signed volume of a tetrahedron, positive where d lies behind a, b, c as seen counter-clockwise from the
    front; its sign is exact: where rounding could change it, whole fractions decide."""
    rows = [[float(y) - float(x) for x, y in zip(a, p, strict=True)] for p in (b, c, d)]
    terms = [(rows[0][i], rows[1][j], rows[2][k], s) for i, j, k, s in ((0, 1, 2, 1), (1, 2, 0, 1), (2, 0, 1, 1), (0, 2, 1, -1), (1, 0, 2, -1), (2, 1, 0, -1))]
    value = -sum(s * x * y * z for x, y, z, s in terms)
    if abs(value) > 1e-14 * sum(abs(x * y * z) for x, y, z, _ in terms):
        return value
    exact = [[Fraction(float(y)) - Fraction(float(x)) for x, y in zip(a, p, strict=True)] for p in (b, c, d)]
    return -float(sum(s * exact[0][i] * exact[1][j] * exact[2][k] for i, j, k, s in ((0, 1, 2, 1), (1, 2, 0, 1), (2, 0, 1, 1), (0, 2, 1, -1), (1, 0, 2, -1), (2, 1, 0, -1))))


def circles(points: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Circumcentre (on the sphere, outward) and angular radius of each face."""
    a, b, c = (points[faces[:, k]] for k in range(3))
    normal = np.cross(b - a, c - a)
    normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
    return normal, np.arccos(np.clip((normal * a).sum(axis=1), -1, 1))


def compacted(points: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points that a face has, faces renumbered, and each kept point's old number."""
    used = np.unique(faces)
    return points[used], np.searchsorted(used, faces), used


def walk(points: np.ndarray, faces: np.ndarray, neighbours: np.ndarray, place, start: int = 0) -> list[int]:
    """The faces crossed from ``start`` to the one that holds ``place``: the way of a query, last the face found."""
    way = [start]
    while len(way) <= max(len(faces), 100):
        v = points[faces[way[-1]]]
        sides = [float(np.cross(v[e], v[(e + 1) % 3]) @ place) for e in range(3)]
        out = next((e for e in range(3) if sides[e] < 0), None)
        if out is None:
            break
        way.append(int(neighbours[way[-1]][out]))
    return way


def mesh_of(tile: pd.DataFrame) -> pd.DataFrame:
    """Triangles of one tile's rows (x, y, z) in order of seq; none where the points give no hull."""
    rows = tile.sort_values(["seq", "title"])
    try:
        v, nb = hull(rows[["x", "y", "z"]].to_numpy())
    except ValueError:
        return pd.DataFrame({"tile_id": [], "t": [], "v": [], "n": []})
    return pd.DataFrame({"tile_id": rows["tile_id"].iloc[0], "t": np.arange(len(v), dtype=np.int32), "v": [x.astype(np.int32) for x in v], "n": [x.astype(np.int32) for x in nb]})


def triangles(members: DataFrame) -> DataFrame:
    """One row a triangle of ``members(tile_id, seq, title, x, y, z)``."""
    return members.select("tile_id", "seq", "title", "x", "y", "z").groupBy("tile_id").applyInPandas(mesh_of, TRIANGLES)


def stats(mesh: DataFrame) -> DataFrame:
    """Vertices, triangles and edges of each tile; each edge once by neighbour > own. ``mesh`` is read once."""
    corners = mesh.select("tile_id", "t", F.explode(F.expr("transform(sequence(0, 2), e -> struct(e, v[e] AS v1, n[e] AS other))")).alias("c"))
    return corners.groupBy("tile_id").agg(F.count_if(F.col("c.e") == 0).alias("triangles"), F.count_if(F.col("c.other") > F.col("t")).alias("edges"), F.countDistinct("c.v1").alias("vertices"))


def edges(mesh: DataFrame, whole: bool = True) -> DataFrame:
    """(tile_id, a, b) of each mesh edge once, a < b. Where faces were left out (not ``whole``), an edge beside a gap has one face
    only, whichever its number; such meshes are counted by edge."""
    sides = mesh.select("tile_id", "t", F.explode(F.expr("transform(sequence(0, 2), e -> struct(v[e] AS p, v[(e + 1) % 3] AS q, n[e] AS other))")).alias("e"))
    ends = (sides.where("e.other > t") if whole else sides).select("tile_id", F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b"))
    return ends if whole else ends.distinct()


def drawn(mesh: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges of ``mesh``, which may lack faces, no longer than a lens allows, with both ends' vectors. ``vertices(tile_id, v, x, y, z)``."""
    a = vertices.select("tile_id", F.col("v").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = vertices.select("tile_id", F.col("v").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    chord = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"))
    return edges(mesh, whole=False).join(a, ["tile_id", "a"]).join(b, ["tile_id", "b"]).where(2 * F.asin(F.least(F.lit(1.0), chord / 2)) <= MAX_EDGE_RAD)


def segments(edges_: DataFrame, center, clip: dict | None = None) -> DataFrame:
    """``drawn`` edges as pairs of places with longitudes unwrapped around ``center``; with ``clip`` those of which an end lies in
    the box, whole turns of longitude aside."""
    out = edges_
    for end in "ab":
        lat, lon = geo.latlon(f"{end}x", f"{end}y", f"{end}z")
        out = out.withColumns({f"{end}_lat": lat, f"{end}_lon": geo.unwrapped_lon(lon, geo.col(center))})
    if clip:
        out = out.where(geo.in_view("a_lat", "a_lon", clip) | geo.in_view("b_lat", "b_lon", clip))
    return out.select("tile_id", "a", "b", "a_lat", "a_lon", "b_lat", "b_lon")


def vertex_neighbours(mesh: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(tile_id, v, neighbours): vertices that share a triangle, those of ``masked(tile_id, t)`` aside."""
    kept = mesh if masked is None else mesh.join(masked, ["tile_id", "t"], "left_anti")
    pairs = kept.select("tile_id", F.explode(F.expr("flatten(transform(sequence(0, 2), e -> array(struct(v[e] AS v, v[(e + 1) % 3] AS w), struct(v[e] AS v, v[(e + 2) % 3] AS w))))")).alias("p"))
    return pairs.groupBy("tile_id", F.col("p.v").alias("v")).agg(F.array_sort(F.collect_set("p.w")).alias("neighbours"))


def back_faces(mesh: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles that close the lens behind a patch: turned away, or flat with an edge over a degree."""
    out = mesh.select("tile_id", "t", *[F.col("v")[k].alias(f"v{k}") for k in range(3)])
    for k in range(3):
        out = out.join(vertices.select("tile_id", F.col("v").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), ["tile_id", f"v{k}"])
    det = F.expr("x0 * (y1 * z2 - z1 * y2) - y0 * (x1 * z2 - z1 * x2) + z0 * (x1 * y2 - y1 * x2)")
    side = lambda p, q: sum((F.col(f"{c}{p}") - F.col(f"{c}{q}")) * (F.col(f"{c}{p}") - F.col(f"{c}{q}")) for c in "xyz")
    wide = (side(0, 1) > WIDE) | (side(1, 2) > WIDE) | (side(2, 0) > WIDE)
    return out.where((det < BACK_DET) | ((det < DEGENERATE_DET) & wide)).select("tile_id", "t")
