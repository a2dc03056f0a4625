"""Spherical geometry as Column expressions: no UDF, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.constants import BUFFER_DEG, COLS, EARTH_RADIUS_M, GRID_DEG, ROWS


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def cartesian(lat, lon) -> tuple[Column, Column, Column]:
    """Unit vector of degrees."""
    a, b = F.radians(col(lat)), F.radians(col(lon))
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def latlon(x, y, z) -> tuple[Column, Column]:
    """Degrees of a unit vector; the sine is clamped."""
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(z))))), F.degrees(F.atan2(col(y), col(x)))


def dot(a, b) -> Column:
    return col(a[0]) * col(b[0]) + col(a[1]) * col(b[1]) + col(a[2]) * col(b[2])


def cross(a, b) -> tuple[Column, Column, Column]:
    a, b = [col(x) for x in a], [col(x) for x in b]
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a) -> tuple[Column, ...]:
    """Unit vector; the zero vector stays."""
    n = length(a)
    return tuple(F.when(n == 0, F.lit(0.0)).otherwise(col(x) / F.nullif(n, F.lit(0.0))) for x in a)


def stored(x) -> Column:
    """A coordinate as it is kept: rounded to 8 decimals half up, then to single precision."""
    return (F.floor(col(x) * 1e8 + 0.5) / F.lit(1e8)).cast("float").cast("double")


def chord_angle(a, b) -> Column:
    """Angle from the chord; the metric of all queries, precise for near points."""
    d = [col(x) - col(y) for x, y in zip(a, b, strict=True)]
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 2))


def acos_angle(a, b) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Angle between two places in degrees."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    u, v = F.sin((b - a) / 2), F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    h = u * u + F.cos(a) * F.cos(b) * v * v
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def metres(angle) -> Column:
    return col(angle) * EARTH_RADIUS_M


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2)) - F.radians(col(lon1))
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def circumcenter(a, b, c) -> tuple[Column, ...]:
    """Unit normal of a triangle's plane, on the side of its centroid."""
    n = normalized(cross([col(y) - col(x) for x, y in zip(a, b, strict=True)], [col(y) - col(x) for x, y in zip(a, c, strict=True)]))
    centroid = [col(x) + col(y) + col(z) for x, y, z in zip(a, b, c, strict=True)]
    sign = F.when(dot(n, centroid) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(x * sign for x in n)


def tile_row(lat) -> Column:
    return F.least(F.floor((col(lat) + 90) / GRID_DEG), F.lit(ROWS - 1)).cast("int")


def tile_col(lon) -> Column:
    return F.least(F.floor((col(lon) + 180) / GRID_DEG), F.lit(COLS - 1)).cast("int")


def wrapped_col(c) -> Column:
    return F.pmod(col(c), F.lit(COLS)).cast("int")


def tile_id(row, column) -> Column:
    pad = lambda x: F.lpad(col(x).cast("string"), 2, "0")
    return F.concat(pad(row), F.lit("-"), pad(column))


def tile_bounds(row, column) -> dict[str, Column]:
    """Core rectangle and buffered rectangle; latitude is clamped, longitude is not."""
    s, w = (col(row) * GRID_DEG - 90).cast("double"), (col(column) * GRID_DEG - 180).cast("double")
    n, e = s + GRID_DEG, w + GRID_DEG
    return {
        "south": s, "west": w, "north": n, "east": e,
        "outer_south": F.greatest(F.lit(-90.0), s - BUFFER_DEG), "outer_west": w - BUFFER_DEG,
        "outer_north": F.least(F.lit(90.0), n + BUFFER_DEG), "outer_east": e + BUFFER_DEG,
    }


def shifted_lon(lon, center) -> Column:
    """Longitude moved by one turn at most to lie within 180 degrees of ``center``."""
    d = col(lon) - col(center)
    return F.when(d > 180, col(lon) - 360).when(d < -180, col(lon) + 360).otherwise(col(lon))


def unwrapped_lon(lon, center) -> Column:
    """Longitude moved by whole turns to within 180 degrees of ``center``; exactly 180 stays on its side."""
    d = col(lon) - col(center)
    turns = F.when(d > 180, F.ceil((d - 180) / 360)).when(d < -180, -F.ceil((-d - 180) / 360)).otherwise(F.lit(0))
    return col(lon) - turns * 360


def in_view(lat, lon, box: dict) -> Column:
    """Inside of a box, whole turns of longitude aside."""
    west, east = F.lit(float(box["west"])), F.lit(float(box["east"]))
    turns = [(col(lon) + turn).between(west, east) for turn in (0, 360, -360)]
    return col(lat).between(F.lit(float(box["south"])), F.lit(float(box["north"]))) & (turns[0] | turns[1] | turns[2])


def ring(row1, col1, row2, col2) -> Column:
    """Chebyshev distance of two tiles; columns wrap."""
    dr, dc = F.abs(col(row1) - col(row2)), F.abs(col(col1) - col(col2))
    return F.greatest(dr, F.least(dc, F.lit(COLS) - dc))


def weight_class(size) -> Column:
    """Eight steps an octave of page length, 1 to 255; 0 where unknown or not positive."""
    x = col(size).cast("double")
    known = x.isNotNull() & (x > 0) & (x < math.inf)
    step = F.floor(8 * F.log2(F.when(known, x)) + 0.5)
    return F.when(known, F.greatest(F.lit(1), F.least(F.lit(255), step))).otherwise(F.lit(0)).cast("int")
