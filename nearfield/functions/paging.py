"""Lists and windows of ranked results as Column expressions: visible ranges, loaded segments, modes, and replay timing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.constants import HEADING_MS, OVERSCAN, WALK_BFS_MS, WALK_DESCENT_MS, WALK_LOCATE_MS, WALK_PULSE_MS
from nearfield.functions.geo import col

SEGMENTS = "array<struct<start:bigint,end:bigint>>"


def visible_range(top, height, item, total, overscan=OVERSCAN) -> tuple[Column, Column]:
    """First and last (exclusive) item that a viewport shows, with ``overscan`` more on either side; nothing of an empty list."""
    top, height, item, total = map(col, (top, height, item, total))
    start = F.greatest(F.lit(0).cast("long"), F.floor(top / item) - overscan)
    end = F.least(total.cast("long"), F.ceil((top + height) / item) + overscan)
    return F.when(total == 0, F.lit(0)).otherwise(start).cast("long"), F.when(total == 0, F.lit(0)).otherwise(end).cast("long")


def expected_count(known, loaded) -> Column:
    """Rows to leave room for: none before anything is loaded, else what is known or loaded."""
    return F.when(col(loaded) == 0, F.lit(0)).otherwise(F.greatest(col(known), col(loaded)))


def scroll_mode(source, paused) -> Column:
    """``infinite`` for picked places and while paused, else ``viewport``."""
    return F.when((col(source) == "picked") | F.coalesce(col(paused), F.lit(False)), F.lit("infinite")).otherwise(F.lit("viewport"))


def covered(segments, start, end) -> Column:
    """Whether one of the disjoint ``segments(start, end)`` holds [start, end); an empty range is covered."""
    start, end = col(start), col(end)
    return (start >= end) | F.exists(col(segments), lambda s: (s["start"] <= start) & (s["end"] >= end))


def first_missing(segments, start, end) -> Column:
    """The first part of [start, end) that no segment holds, as (start, end), or null. Segments are merged and disjoint."""
    start, end = col(start).cast("long"), col(end).cast("long")
    around = F.filter(col(segments), lambda s: (s["start"] <= start) & (s["end"] > start))
    cursor = F.coalesce(F.try_element_at(around, F.lit(1))["end"], start)
    following = F.array_min(F.transform(F.filter(col(segments), lambda s: s["start"] > cursor), lambda s: s["start"]))
    return F.when(cursor < end, F.struct(cursor.alias("start"), F.least(F.coalesce(following, end), end).alias("end")))


def evicted(segments, start, end, window: int) -> Column:
    """``segments`` (by start) cut to ``window`` items: from the low end where the request [start, end) is as far or farther from
    it, else from the high end."""
    held = col(segments)
    size = lambda s: s["end"] - s["start"]
    total = F.aggregate(held, F.lit(0).cast("long"), lambda a, s: a + size(s))
    excess = F.greatest(F.lit(0).cast("long"), total - window)
    low = (col(start) - F.element_at(held, 1)["start"]) >= (F.element_at(held, -1)["end"] - col(end))
    upto = lambda i: F.aggregate(F.slice(held, 1, i), F.lit(0).cast("long"), lambda a, s: a + size(s))
    cut = lambda before, s: F.least(size(s), F.greatest(F.lit(0).cast("long"), excess - before))
    from_low = F.transform(held, lambda s, i: F.struct((s["start"] + cut(upto(i), s)).alias("start"), s["end"].alias("end")))
    from_high = F.transform(held, lambda s, i: F.struct(s["start"].alias("start"), (s["end"] - cut(total - upto(i + 1), s)).alias("end")))
    kept = F.filter(F.when(low, from_low).otherwise(from_high), lambda s: s["start"] < s["end"])
    return F.when(F.size(held) == 0, held).otherwise(kept).cast(SEGMENTS)


def in_flight(held, started, ended) -> Column:
    """Ids being loaded after ``started`` begin and ``ended`` arrive or fail."""
    return F.array_except(F.array_union(col(held), col(started)), col(ended))


def turned(shown, target, ms) -> Column:
    """A shown heading one frame of ``ms`` later: a share of the shortest arc to the target; the first and the last step snap."""
    shown, target, ms = col(shown), col(target), col(ms)
    arc = F.pmod(target - shown + 540, F.lit(360.0)) - 180
    moved = F.pmod(shown + arc * F.least(F.lit(1.0), ms / HEADING_MS) + 360, F.lit(360.0))
    return F.when(target.isNull(), shown).when(shown.isNull() | (F.abs(arc) < 0.2), target).otherwise(moved)


def walk_timeline(locate, descent, breadth) -> dict[str, Column]:
    """Ends of a replay's phases in ms; each phase's time is bounded, so the whole is, whatever the counts."""
    spans = [F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(n) * float(step))) for n, (step, low, high) in zip((locate, descent, breadth), (WALK_LOCATE_MS, WALK_DESCENT_MS, WALK_BFS_MS), strict=True)]
    ends = [spans[0], spans[0] + spans[1], spans[0] + spans[1] + spans[2]]
    return dict(zip(("locate_end", "descent_end", "bfs_end", "total_end"), [*ends, ends[2] + WALK_PULSE_MS], strict=True))


def phase_index(elapsed, start, span, count) -> Column:
    """How many of a phase's items are drawn at ``elapsed``: in proportion, none before, all after."""
    elapsed, start, span, count = map(col, (elapsed, start, span, count))
    part = F.least(count.cast("long"), F.floor((elapsed - start) / F.nullif(span, F.lit(0.0)) * count))
    return F.when((count <= 0) | (elapsed <= start), F.lit(0)).when((span <= 0) | (elapsed >= start + span), count).otherwise(part).cast("long")
