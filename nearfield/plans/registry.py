"""Names, plans and DuckDB SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: SQL pieces that several queries share.
R = 6371000


def vec(lat: str, lon: str) -> tuple[str, str, str]:
    return f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"


def kept(x: str) -> str:
    return f"CAST(CAST(floor(({x}) * 1e8 + 0.5) / 1e8 AS FLOAT) AS DOUBLE)"


def located(source: str, more: str = "") -> str:
    x, y, z = map(kept, vec("lat", "lon"))
    return f"SELECT *, {x} AS x, {y} AS y, {z} AS z, {weight('len')} AS weight{more} FROM {source}"


def weight(x: str) -> str:
    return f"CAST(CASE WHEN {x} > 0 THEN greatest(1, least(255, floor(8 * log2({x}) + 0.5))) ELSE 0 END AS INTEGER)"


def hav(a: str, b: str, c: str, d: str) -> str:
    u, v = f"sin((radians({c}) - radians({a})) / 2)", f"sin((radians({d}) - radians({b})) / 2)"
    return f"2 * asin(sqrt(least(1e0, {u} * {u} + cos(radians({a})) * cos(radians({c})) * {v} * {v})))"


def chord(a: tuple, b: tuple) -> str:
    return f"2 * asin(least(1e0, sqrt({' + '.join(f'({x} - {y}) * ({x} - {y})' for x, y in zip(a, b, strict=True))}) / 2))"


ROW, COL = "CAST(least(floor((lat + 90) / 5), 35) AS INTEGER)", "CAST(least(floor((lon + 180) / 5), 71) AS INTEGER)"


def tid(r: str, c: str) -> str:
    return f"lpad(CAST({r} AS VARCHAR), 2, '0') || '-' || lpad(CAST({c} AS VARCHAR), 2, '0')"


def ring(r1: str, c1: str, r2: str, c2: str) -> str:
    return f"greatest(abs({r1} - {r2}), least(abs({c1} - {c2}), 72 - abs({c1} - {c2})))"


def members(source: str) -> str:
    """CTEs own, populated, near and members over a view of articles."""
    return f"""
own AS (SELECT *, {ROW} AS own_row, {COL} AS own_col FROM {source}),
populated AS (SELECT DISTINCT own_row AS tile_row, own_col AS tile_col FROM own),
near AS (SELECT o.*, p.tile_row, p.tile_col, p.tile_row * 5 - 90e0 AS s, p.tile_col * 5 - 180e0 AS w,
    CASE WHEN lon - (p.tile_col * 5 - 177.5e0) > 180 THEN lon - 360 WHEN lon - (p.tile_col * 5 - 177.5e0) < -180 THEN lon + 360 ELSE lon END AS nlon
  FROM own o JOIN populated p ON abs(p.tile_row - o.own_row) <= 1 AND least(abs(p.tile_col - o.own_col), 72 - abs(p.tile_col - o.own_col)) <= 1),
inside AS (SELECT *, {tid('tile_row', 'tile_col')} AS tile_id, lat >= s AND lat < s + 5 AND nlon >= w AND nlon < w + 5 AS native
  FROM near WHERE lat BETWEEN s - 0.5 AND s + 5.5 AND nlon BETWEEN w - 0.5 AND w + 5.5),
members AS (SELECT * FROM inside WHERE tile_id IN (SELECT tile_id FROM inside GROUP BY tile_id HAVING count(*) >= 4))"""


def chosen(points: str = "queries_pts") -> str:
    """CTEs tiles, rings and chosen(pid, tile_id, kind) for the positions of a view, after ``members``."""
    near = "(p.lat - (p.r * 5 - 90) < 1 OR t.tile_row >= p.r) AND (p.r * 5 - 85 - p.lat < 1 OR t.tile_row <= p.r)"
    dc = "((t.tile_col - p.c + 36 + 72) % 72 - 36)"
    side = f"({dc} <> -1 OR p.lon - (p.c * 5 - 180) < 1) AND ({dc} <> 1 OR p.c * 5 - 175 - p.lon < 1)"
    return f"""
tiles AS (SELECT DISTINCT tile_row, tile_col, tile_id FROM members),
pts AS (SELECT pid, lat, lon, {ROW} AS r, {COL} AS c FROM {points}),
direct AS (SELECT p.pid, t.tile_id, CASE WHEN t.tile_row = p.r AND t.tile_col = p.c THEN 'primary' ELSE 'adjacent' END AS kind
  FROM pts p JOIN tiles t ON abs(t.tile_row - p.r) <= 1 AND abs({dc}) <= 1 AND {near} AND {side}),
found AS (SELECT pid FROM direct WHERE kind = 'primary'),
rings AS (SELECT p.pid, t.tile_id, {ring('p.r', 'p.c', 't.tile_row', 't.tile_col')} AS ring FROM pts p, tiles t),
lost AS (SELECT pid, tile_id, 'ring' AS kind FROM (SELECT *, rank() OVER (PARTITION BY pid ORDER BY ring) AS rk FROM rings WHERE pid NOT IN (SELECT pid FROM found)) WHERE rk = 1),
chosen AS (SELECT * FROM direct WHERE pid IN (SELECT pid FROM found) UNION ALL SELECT * FROM lost)"""


def distances(points: str = "queries_pts") -> str:
    """CTE q: positions as vectors."""
    x, y, z = vec("lat", "lon")
    return f"q AS (SELECT pid, {x} AS px, {y} AS py, {z} AS pz FROM {points})"


DIST = f"round({chord(('px', 'py', 'pz'), ('x', 'y', 'z'))} * {R}, 3)"
PLACE = "round(degrees(asin(greatest(-1e0, least(1e0, z)))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon"


def best(pool: str, k: int) -> str:
    """Top-k per position of rows (pid, seq, title, x, y, z, weight, distance_m), one a title."""
    return f"""SELECT pid, CAST(rn AS INTEGER) AS rank, title, {PLACE}, distance_m, weight FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance_m, title, seq) AS rn FROM
  (SELECT *, row_number() OVER (PARTITION BY pid, title ORDER BY distance_m, seq) AS dup FROM {pool}) WHERE dup = 1) WHERE rn <= {k}"""
