"""Formatting, codecs and radar arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.constants import LANGUAGES, RADAR_DEFAULT_M, RETRY_AFTER_MS
from nearfield.functions.geo import col


def display_title(title) -> Column:
    return F.translate(col(title), "_", " ")


def slug(title) -> Column:
    """Title as part of an address: blanks are underscores, other signs percent-encoded but for the unreserved marks."""
    out = F.replace(F.url_encode(F.translate(col(title), " ", "_")), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def distance_label(m) -> Column:
    """Whole metres under a kilometre, tenths under ten, then whole kilometres; halves go up."""
    m = col(m)
    tenths = F.floor(m / 100 + 0.5)
    return (
        F.when(m < 1000, F.concat(F.floor(m + 0.5).cast("string"), F.lit(" m")))
        .when(m >= 10_000, F.concat(F.floor(m / 1000 + 0.5).cast("string"), F.lit(" km")))
        .otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" km")))
    )


def bytes_label(n) -> Column:
    n = col(n).cast("double")
    return F.when(n < 1024, F.format_string("%.0f B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).when(n < 1 << 30, F.format_string("%.1f MB", n / (1 << 20))).otherwise(F.format_string("%.1f GB", n / (1 << 30)))


def directions(lat, lon, platform) -> Column:
    place = F.concat(col(lat).cast("string"), F.lit(","), col(lon).cast("string"))
    return (
        F.when(col(platform) == "ios", F.concat(F.lit("https://maps.apple.com/?daddr="), place))
        .when(col(platform) == "android", F.concat(F.lit("geo:"), place, F.lit("?q="), place))
        .otherwise(F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), place))
    )


def hue(text, n: int) -> Column:
    """Polynomial hash of the signs in 32-bit arithmetic, folded into [0, n)."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    codes = F.transform(F.split(col(text), ""), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)), F.lit(n)).cast("int")


def retry_after_ms(value) -> Column:
    """Seconds of a header as milliseconds; half an hour where it is no positive number."""
    seconds = col(value).try_cast("double")
    return F.coalesce(F.when((seconds > 0) & (seconds < float("inf")), seconds * 1000), F.lit(float(RETRY_AFTER_MS)))


def heading(webkit, absolute, alpha) -> Column:
    """Degrees clockwise from north, or null."""
    webkit, alpha = col(webkit), col(alpha)
    return F.when(webkit.isNotNull(), F.when(webkit >= 0, webkit % 360)).when(col(absolute) & alpha.isNotNull(), (F.lit(360) - alpha + 360) % 360)


def permalink(lat, lon, lang, mode) -> Column:
    return F.concat(F.lit("#"), F.format_string("%.4f", col(lat)), F.lit(","), F.format_string("%.4f", col(lon)), F.lit("&lang="), col(lang), F.when(col(mode) == "all", F.lit("&filter=all")).otherwise(F.lit("")))


def parsed_permalink(link) -> dict[str, Column]:
    """lat, lon, lang and mode of a link; all null where the place is no valid pair, unknown values alone are null."""
    raw = F.regexp_replace(col(link), "^#", "")
    parts = F.split(raw, "&")
    pair = F.split(F.element_at(parts, 1), ",")
    lat, lon = (F.trim(F.try_element_at(pair, F.lit(k))).try_cast("double") for k in (1, 2))
    valid = (F.size(pair) == 2) & lat.between(-90, 90) & lon.between(-180, 180)
    last = lambda key, known: F.try_element_at(F.filter(F.transform(F.filter(parts, lambda p: p.startswith(f"{key}=")), lambda p: F.substring_index(p, "=", -1)), lambda v: v.isin(*known)), F.lit(-1))
    return {"lat": F.when(valid, lat), "lon": F.when(valid, lon), "lang": F.when(valid, last("lang", LANGUAGES)), "mode": F.when(valid, last("filter", ("all", "highlights")))}


def or_default(value, known, default) -> Column:
    return F.when(col(value).isin(*known), col(value)).otherwise(F.lit(default))


def radar_step(m) -> Column:
    """The least of 1, 2, 2.5 and 5 times a power of ten of which four cover ``m``."""
    target = F.when((col(m) > 0) & (col(m) < float("inf")), col(m)).otherwise(F.lit(float(RADAR_DEFAULT_M)))
    steps = F.array(*[F.lit(float(a * 10**k)) for k in range(9) for a in (1, 2, 2.5, 5)])
    return F.coalesce(F.element_at(F.filter(steps, lambda s: s * 4 >= target), 1), F.lit(5e8))


def radar_rings(m) -> Column:
    target = F.when((col(m) > 0) & (col(m) < float("inf")), col(m)).otherwise(F.lit(float(RADAR_DEFAULT_M)))
    step = radar_step(m)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(3), F.ceil(target / step)).cast("int")), lambda i: i * step)


def radar_radius(d, full, pixels) -> Column:
    r = F.when(col(full) > 0, col(pixels) * F.sqrt(F.greatest(F.lit(0.0), col(d)) / F.nullif(col(full), F.lit(0.0))))
    return F.coalesce(F.least(r, col(pixels).cast("double")), F.lit(0.0))


def blip(bearing, d, heading, full, pixels) -> tuple[Column, Column]:
    """Offset from the centre, x to the right and y down."""
    r, a = radar_radius(d, full, pixels), F.radians(col(bearing) - col(heading))
    return r * F.sin(a), -r * F.cos(a)


def sweep_boost(angle, sweep, trail: float = 120.0) -> Column:
    lag = F.pmod(col(sweep) - col(angle), F.lit(360.0))
    return F.when(lag <= trail, 1 - lag / trail).otherwise(F.lit(0.0))
