"""Latest state per vessel: row building, upsert, listing, ageing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import geo, times, vessel
from tidewake.schemas import STATE_SCHEMA, TRACK_SCHEMA

STATE_COLUMNS = ["mmsi", "ship_name", "latitude", "longitude", "sog_knots", "cog_degrees",
                 "true_heading", "nav_status", "status", "last_seen_at"]
ARRIVAL = ("ingested_at", "event_id")
# What a state row is made from, beside its place in the order of arrival.
EVENT_COLUMNS = ("mmsi", "ship_name", "latitude", "longitude", "sog_knots", "cog_degrees", "true_heading", "rate_of_turn",
                 "nav_status", "event_time", "ingested_at")


def placed(events: DataFrame) -> DataFrame:
    """Events with a position and a vessel; the others are dropped silently."""
    return events.filter("latitude IS NOT NULL AND longitude IS NOT NULL AND mmsi <> ''")


def build_state_rows(events: DataFrame, now=None, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """State rows with ``_arrival``, the order in which they arrived."""
    now = times.as_of_column(now)
    extra = {
        "position": geo.point(),
        "status": vessel.derive_status(),
        "last_seen_at": times.effective_time("event_time", "ingested_at", now),
        "updated_at": now,
    }
    return placed(events).select(
        *[extra.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA],
        F.struct(*arrival).alias("_arrival"))


def timed(events: DataFrame, now=None) -> DataFrame:
    """Adds ``_at``, the instant a track row has."""
    return events.withColumn("_at", times.effective_time("event_time", "ingested_at", times.as_of_column(now)))


def build_track_rows(events: DataFrame, now=None, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """Track rows with ``_arrival``; events that are ``timed`` already keep their instant."""
    extra = {"position": geo.point(), "event_time": F.col("_at"),
             "partition_hour": F.date_trunc("hour", "_at")}
    events = events if "_at" in events.columns else timed(events, now)
    return placed(events).select(
        *[extra.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in TRACK_SCHEMA],
        F.struct(*arrival).alias("_arrival"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Column,
              columns: Sequence[str] | None = None) -> DataFrame:
    """The last row per key. Partial aggregation leaves one row per key and task to shuffle, so a
    key holding most of the rows costs no more than any other."""
    columns = list(columns or df.columns)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return last.select(*[F.col("_row")[c].alias(c) for c in columns])


def first_by(df: DataFrame, keys: Sequence[str], order: Column,
             columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return first.select(*[F.col("_row")[c].alias(c) for c in columns])


def _order(order: str) -> Column:
    if order == "arrival":
        return F.struct("_arrival")
    if order == "event_time":
        return F.struct("last_seen_at", "_arrival")
    raise ValueError(f"unknown order {order!r}")


def latest_state(rows: DataFrame, order: str = "arrival", with_arrival: bool = False) -> DataFrame:
    """One row per vessel: the last to arrive, or with ``event_time`` the latest report."""
    extra = ["_arrival"] if with_arrival else []
    return latest_by(rows, ["mmsi"], _order(order), [*STATE_SCHEMA.names, *extra])


def latest_events(events: DataFrame, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """The last placed event of each vessel, as it arrived."""
    rank = F.col(arrival[0]) if len(arrival) == 1 else F.struct(*arrival)
    return latest_by(placed(events), ["mmsi"], rank, sorted({*EVENT_COLUMNS, *arrival}))


def current_state(events: DataFrame, now=None, order: str = "arrival",
                  arrival: Sequence[str] = ARRIVAL, with_arrival: bool = False) -> DataFrame:
    """State after applying all events to an empty table; on request with ``_arrival``.

    By arrival the events are reduced first, so times are parsed and statuses derived once per
    vessel instead of once per report.
    """
    if order == "arrival":
        rows = build_state_rows(latest_events(events, arrival), now, arrival)
        return rows if with_arrival else rows.drop("_arrival")
    return latest_state(build_state_rows(events, now, arrival), order, with_arrival)


def upsert_state(state: DataFrame, batch: DataFrame, order: str = "arrival") -> DataFrame:
    """Insert or replace whole rows by vessel: one shuffle for reducing the batch and merging.

    ``batch`` is the output of ``build_state_rows``. By arrival any batch row beats the stored
    one, also an older report; by event time the later report wins.
    """
    names = STATE_SCHEMA.names
    stored = state.select(*names, F.lit(None).cast(batch.schema["_arrival"].dataType).alias("_arrival"),
                          F.lit(0).alias("_new"))
    fresh = batch.select(*names, "_arrival", F.lit(1).alias("_new"))
    rank = (F.struct("_new", "_arrival") if order == "arrival"
            else F.struct("last_seen_at", "_new", "_arrival"))
    return latest_by(stored.unionByName(fresh), ["mmsi"], rank, names)


def list_vessels(state: DataFrame) -> DataFrame:
    return state.select(*STATE_COLUMNS).orderBy("mmsi")


def vessel_detail(state: DataFrame, mmsi: str) -> DataFrame:
    """The vessel's row, or none."""
    return (state.filter(F.col("mmsi") == F.lit(mmsi))
            .select(*STATE_COLUMNS, "rate_of_turn", "updated_at"))


def mark_stale(state: DataFrame, as_of=None, minutes: int = vessel.FRESH_MINUTES) -> DataFrame:
    """Set STALE on vessels silent for longer than ``minutes``; a null status stays null."""
    return state.withColumn("status", F.when(stale_now(as_of, minutes), F.lit("STALE"))
                            .otherwise(F.col("status")))


def stale_now(as_of=None, minutes: int = vessel.FRESH_MINUTES) -> Column:
    """Rows that ``mark_stale`` changes."""
    silent = F.col("last_seen_at") < times.minutes_ago(times.as_of_column(as_of), minutes)
    return F.coalesce(silent & (F.col("status") != "STALE"), F.lit(False))


def older_than(column: str, as_of=None, hours: int = 24) -> Column:
    """Strictly older; unknown times are not."""
    old = F.col(column) < times.hours_ago(times.as_of_column(as_of), hours)
    return F.coalesce(old, F.lit(False))


def purge_state(state: DataFrame, as_of=None, hours: int = 0) -> DataFrame:
    """Remove vessels last seen more than ``hours`` ago; 0 turns it off."""
    return state if hours <= 0 else state.filter(~older_than("last_seen_at", as_of, hours))
