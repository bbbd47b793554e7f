"""Position history: de-duplicated append, the track of a vessel, GeoJSON lines, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions import times
from tidewake.operators.state import first_by, older_than
from tidewake.schemas import TRACK_SCHEMA

# ---- Fixed values -------------------------------------------------------------------------
TRACK_WINDOW_HOURS = 12
TRACK_RETENTION_HOURS = 24
# -------------------------------------------------------------------------------------------

KEY = ["event_id", "mmsi"]  # rows are sorted by it: ids differ early, the numbers of vessels late
KEYS_BROADCAST_BYTES = 32 * 1024 * 1024


def dedup_track(rows: DataFrame) -> DataFrame:
    """First arrival per (vessel, event id)."""
    return first_by(rows, KEY, F.col("_arrival"), TRACK_SCHEMA.names)


def append_track(track: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows to append: the batch's first per key, without keys the track already has."""
    return dedup_track(rows).join(track.select(*KEY), KEY, "left_anti")


def append_small_batch(track: DataFrame, rows: DataFrame,
                       max_bytes: int = KEYS_BROADCAST_BYTES) -> DataFrame:
    """``append_track`` for a micro-batch against a long track.

    ``rows`` should be persisted: one job measures its keys. Only if they are small enough they
    are broadcast, which finds the keys already stored while scanning the track in place;
    otherwise both sides are shuffled.
    """
    measured = rows.agg(F.sum(F.octet_length("mmsi") + F.octet_length("event_id") + 32)).first()[0]
    if measured is None or measured > max_bytes:
        return append_track(track, rows)
    keys = rows.select(*KEY).distinct()
    known = track.select(*KEY).join(F.broadcast(keys), KEY, "left_semi")
    return dedup_track(rows).join(known, KEY, "left_anti")


def vessel_track(track: DataFrame, mmsi: str, as_of=None,
                 hours: int = TRACK_WINDOW_HOURS) -> DataFrame:
    """A vessel's last hours, oldest first. The hour bound prunes folders of a stored track."""
    since = times.hours_ago(times.as_of_column(as_of), hours)
    return (track.filter(F.col("mmsi") == F.lit(mmsi))
            .filter(F.col("partition_hour") >= F.date_trunc("hour", since))
            .filter(F.col("event_time") > since)
            .orderBy("event_time", "event_id")
            .select("event_time", "latitude", "longitude", "sog_knots"))


def track_points(track: DataFrame) -> DataFrame:
    """Number of points per vessel."""
    return track.groupBy("mmsi").agg(F.count("*").alias("points"))


def track_linestring(track: DataFrame, grain: str = "hour") -> DataFrame:
    """GeoJSON LineString features, one row per vessel and event ``grain`` (hour or day) with points.

    The grain is the same for every vessel, so a row holds what a vessel can report in that time, however
    long its track is. Points are in order of (event time, event id).
    """
    if grain not in ("hour", "day"):
        raise ValueError(f"unknown grain {grain!r}")
    point = F.struct("event_time", "event_id", "longitude", "latitude")
    lines = (track.groupBy("mmsi", F.date_trunc(grain, "event_time").alias("since"))
             .agg(F.array_sort(F.collect_list(point)).alias("_p")))
    coordinates = F.transform("_p", lambda p: F.array(p["longitude"], p["latitude"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                                 F.create_map().cast("map<string,string>").alias("properties")))
    return lines.select("mmsi", "since", F.size("_p").alias("points"), feature.alias("feature"))


def expire_track(track: DataFrame, as_of=None, hours: int = TRACK_RETENTION_HOURS) -> DataFrame:
    """Track rows that stay; rows without a time stay."""
    return track.filter(~older_than("event_time", as_of, hours))


def hourly_counts(track: DataFrame) -> DataFrame:
    """Reports per event hour."""
    return track.groupBy("partition_hour").agg(F.count("*").alias("events"))
