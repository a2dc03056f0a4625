"""Streams of positions: the movement rule, debounce, stale and expired rows, source sessions.

Each rule has a batch form over stored events. The movement rule carries state (the last accepted place): its batch form reads a
user's events in order, its streaming form is ``applyInPandasWithState``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.constants import EARTH_RADIUS_M, REQUERY_M
from nearfield.functions import geo


def micros(ts):
    """Microseconds since 1970; a time without zone is taken in the session's zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def accepted(positions: DataFrame, metres: float = REQUERY_M) -> DataFrame:
    """Events that query anew: the first of a user, then each at least ``metres`` from the last accepted one.

    Users' events are dealt by user and sorted; a task reads them in order and holds one place, however long a history is.
    """

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last = None, None
        for batch in batches:
            keep = []
            for who, lat, lon in zip(*[batch.column(x).to_pylist() for x in ("user_id", "lat", "lon")], strict=True):
                new = last is None or who != user or _moved(last, (lat, lon)) >= metres
                if new:
                    user, last = who, (lat, lon)
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = positions.select("user_id", "event_id", "ts", "lat", "lon")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInArrow(rule, rows.schema)


def _moved(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    u, v = math.sin((q - p) / 2), math.sin((math.radians(b[1]) - math.radians(a[1])) / 2)
    return 2 * math.asin(math.sqrt(min(1.0, u * u + math.cos(p) * math.cos(q) * v * v))) * EARTH_RADIUS_M


def accepted_stream(stream: DataFrame, metres: float = REQUERY_M) -> DataFrame:
    """The same rule on a stream; state is the last accepted place of a user. Within a batch, events go in order of time."""

    def rule(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        keep = []
        for lat, lon in zip(rows["lat"], rows["lon"], strict=True):
            new = last is None or _moved(last, (lat, lon)) >= metres
            keep.append(new)
            if new:
                last = (lat, lon)
        if last is not None:
            state.update(tuple(map(float, last)))
        yield rows[keep][["user_id", "event_id", "ts", "lat", "lon"]]

    return stream.groupBy("user_id").applyInPandasWithState(rule, "user_id long, event_id long, ts timestamp, lat double, lon double", "lat double, lon double", "append", "NoTimeout")


def debounced(events: DataFrame, seconds: float) -> DataFrame:
    """Trailing edge: events that no other of the user follows within ``seconds``."""
    following = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = micros(following) - micros("ts")
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= int(seconds * 1_000_000))).drop("gap")


def settled(stream: DataFrame, seconds: float) -> DataFrame:
    """``debounced`` on a stream with a watermark on ts: the last event of each session that a pause of ``seconds`` ends."""
    runs = stream.groupBy("user_id", F.session_window("ts", f"{int(seconds * 1000)} milliseconds").alias("w"))
    return runs.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("user_id", "event_id")


def result_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a new result of ``rows(pid, rank, title)`` asks for: ``distances`` where the ordered titles are the same, else
    ``list``; and whether the sets of titles differ. Rows of both results that agree in rank and title are counted, so no
    result is gathered."""
    a = old.select("pid", F.col("rank").alias("old_rank"), "title")
    b = new.select("pid", F.col("rank").alias("new_rank"), "title")
    both = a.join(b, ["pid", "title"], "full_outer")
    one_sided = F.col("old_rank").isNull() | F.col("new_rank").isNull()
    moved = F.coalesce(F.col("old_rank") != F.col("new_rank"), F.lit(True))
    out = both.groupBy("pid").agg(F.max(moved).alias("moved"), F.max(one_sided).alias("set_differs"))
    return out.select("pid", F.when(F.col("moved"), F.lit("list")).otherwise(F.lit("distances")).alias("change"), "set_differs")


def enrich_queue(rows: DataFrame, most: int = 200) -> DataFrame:
    """Of each ``rows(pid, rank, title)`` the distinct titles in order of rank, ``most`` ranks at most a page."""
    page = rows.where(F.col("rank") <= most).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("page"))
    return page.select("pid", F.array_distinct(F.transform("page", lambda x: x["title"])).alias("titles"))


def current_generation(rows: DataFrame, control: DataFrame) -> DataFrame:
    """Rows of their user's current generation; others are stale."""
    return rows.join(control, ["user_id", "generation"], "left_semi")


def fresh(sessions: DataFrame, now: str, seconds: int) -> DataFrame:
    """Rows younger than ``seconds`` at ``now``."""
    return sessions.where(micros(F.lit(now)) - micros("ts") < seconds * 1_000_000)


def last_status(events: DataFrame) -> DataFrame:
    """Each user's last event: signal lost if it is an error."""
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return last.select("user_id", (F.col("last") == "error").alias("signal_lost"), "errors")


def source_sessions(events: DataFrame) -> DataFrame:
    """Runs of one position source; a change of source begins a new session."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events.withColumn("new", F.when(F.lag("source").over(order) == F.col("source"), 0).otherwise(1))
    return marked.withColumn("session", F.sum("new").over(order)).groupBy("user_id", "session", "source").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))
