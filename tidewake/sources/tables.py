"""The stored state and track tables: plain Parquet folders that are appended to.

State: every row is a vessel's state with its place in the order of arrival, in a folder of the hour it was written in. A reader keeps
the last row per vessel, so neither the borders nor the order of batches matter, and rows stored twice by a replay
change nothing. Clean-up appends too: a row marked STALE or purged ranks just above the report it ages. It also carries what is
still current out of old hours into the present one and then drops those hours; if it stops half-way, rows are stored twice.
With a table format that has MERGE, ``operators.state.upsert_state`` is the merge source instead.

Track: append-only, one folder per event hour, so windows prune and expiry drops whole folders.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.functions import times
from tidewake.operators.state import latest_by
from tidewake.operators.track import expire_track as kept_rows
from tidewake.schemas import STATE_SCHEMA, TRACK_SCHEMA, empty_track
from tidewake.session import counted, scratch
from tidewake.sources import paths
from tidewake.sources.archive import bloom

REPORTED, AGED, PURGED = 0, 1, 2
# The place in the order of arrival: time and id, or the log's offset; then what clean-up made of the report.
_PLACE = T.StructType([T.StructField("_at", T.DoubleType()), T.StructField("_id", T.StringType()),
                       T.StructField("_mark", T.IntegerType())])
_PLACED = T.StructType(STATE_SCHEMA.fields + _PLACE.fields)
_STORED = T.StructType([*_PLACED.fields, T.StructField("order", T.StringType()), T.StructField("written", T.StringType())])
# Hours that may still be written to, and days for which a purged vessel's mark keeps its replayed reports out.
OPEN_HOURS = 2
PURGED_DAYS = 4


def _hour(at: datetime) -> str:
    return (at if at.tzinfo is None else at.astimezone(timezone.utc)).strftime("%Y%m%d%H")


def _now() -> datetime:
    return datetime.now(timezone.utc)


def stored_order(spark: SparkSession, path: str) -> str | None:
    """The order by which a vessel's last row is told; all jobs on a table share it. None for an empty table."""
    orders = {n.split("=", 1)[1] for n in paths.folders(spark, path) if n.startswith("order=")}
    if len(orders) > 1:
        raise ValueError(f"{path} holds rows of several orders: {sorted(orders)}")
    return orders.pop() if orders else None


def _checked_order(spark: SparkSession, path: str, order: str | None) -> str:
    stored = stored_order(spark, path)
    if order and stored and order != stored:
        raise ValueError(f"{path} is kept in {stored!r} order, not {order!r}")
    return order or stored or "arrival"


def append_state(rows: DataFrame, path: str, order: str | None = None, now: datetime | None = None) -> int:
    """Store states in the present hour and return their number, each with ``_arrival`` (as ``operators.state`` gives it) or with its place already."""
    order = _checked_order(rows.sparkSession, path, order)
    if "_mark" not in rows.columns:
        arrival = rows.schema["_arrival"].dataType.names if "_arrival" in rows.columns else []
        place = [F.col("_arrival")[n] for n in arrival] + [F.lit(None)] * 2
        rows = rows.select(*STATE_SCHEMA.names, place[0].cast("double").alias("_at"), place[1].cast("string").alias("_id"),
                           F.lit(REPORTED).alias("_mark"))
    rows = rows.select(*_PLACED.names, F.lit(order).alias("order"), F.lit(_hour(now or _now())).alias("written"))
    rows, seen = counted(rows.hint("rebalance"))
    rows.write.mode("append").partitionBy("order", "written").parquet(path)
    return seen.get["n"]


def state_snapshot(spark: SparkSession, path: str, order: str | None = None, purged: bool = False) -> DataFrame:
    """The last row of every vessel with its place; vessels that were purged only on request."""
    order = _checked_order(spark, path, order)
    if not paths.folders(spark, path):
        return spark.createDataFrame([], _PLACED)
    seen = [] if order == "arrival" else ["last_seen_at"]
    rows = spark.read.schema(_STORED).parquet(path)
    last = latest_by(rows, ["mmsi"], F.struct(*seen, *_PLACE.names), _PLACED.names)
    return last if purged else last.where(F.col("_mark") != PURGED)


def read_state(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """The current state: the last to arrive of every vessel, or by ``event_time`` its latest report."""
    return state_snapshot(spark, path, order).select(*STATE_SCHEMA.names)


def carry_state(spark: SparkSession, path: str, now: datetime | None = None, open_hours: int = OPEN_HOURS) -> list[str]:
    """Append what is current in hours that nobody writes to any more to the present hour, then drop them; returns them.

    Needed now and then, so that a reader finds little more than a row per vessel. One clean-up at a time; a reader
    that still lists a dropped hour fails and is to be run again.
    """
    order, now = stored_order(spark, path), now or _now()
    if order is None:
        return []
    limit = "written=" + _hour(now - timedelta(hours=open_hours))
    closed = [n for n in paths.folders(spark, f"{path}/order={order}") if n < limit]
    if closed:
        old = spark.read.schema(_STORED).parquet(path).where(F.col("written").isin([n.split("=", 1)[1] for n in closed]))
        current = state_snapshot(spark, path, purged=True)
        keep = (F.col("_mark") != PURGED) | (F.col("updated_at") > F.lit(now - timedelta(days=PURGED_DAYS)))
        carried = current.where(keep).join(old.select("mmsi").distinct(), "mmsi", "left_semi")
        append_state(carried, path, order, now)
    for name in closed:
        paths.delete(spark, f"{path}/order={order}/{name}")
    return closed


def append_track_rows(rows: DataFrame, path: str) -> int:
    """Append track rows and return their number."""
    rows, seen = counted(rows.select(*TRACK_SCHEMA.names).hint("rebalance", "partition_hour")
                         .sortWithinPartitions("partition_hour", "mmsi", "event_time"))
    (rows.write.mode("append").options(**bloom("mmsi")).partitionBy("partition_hour").parquet(path))
    return seen.get["n"]


def read_track(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Track rows; ``since`` prunes whole hours."""
    if not paths.folders(spark, path):
        return empty_track(spark)
    df = spark.read.schema(TRACK_SCHEMA).parquet(path).select(*TRACK_SCHEMA.names)
    return df if since is None else df.filter(F.col("partition_hour") >= F.date_trunc("hour", since))


def _hour_of(folder: str) -> datetime | None:
    text = folder.split("=", 1)[-1].replace("%3A", ":").replace("%20", " ")
    try:
        return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None


def expire_track(spark: SparkSession, path: str, as_of: datetime, hours: int) -> None:
    """Drop hours that ended before the limit and rewrite the one hour it falls into.

    The track job appends to hours of up to its lateness ago, so less than that cannot be kept.
    """
    if hours * 3600 <= times.STALE_TOLERANCE_S + times.FUTURE_TOLERANCE_S:
        raise ValueError(f"{hours} h of track: late reports still arrive that old")
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    limit = as_of - timedelta(hours=hours)
    for folder in paths.folders(spark, path):
        start = _hour_of(folder)
        if start is None or start >= limit:
            continue
        if start + timedelta(hours=1) <= limit:
            paths.delete(spark, f"{path}/{folder}")
            continue
        hour = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        kept = kept_rows(read_track(spark, path).filter(F.col("partition_hour") == hour), as_of, hours)
        copy = scratch(spark, "track-hour")
        kept.write.parquet(copy)
        rows = spark.read.schema(TRACK_SCHEMA).parquet(copy)
        if rows.isEmpty():
            paths.delete(spark, f"{path}/{folder}")
        else:
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("partition_hour").parquet(path))
        paths.delete(spark, copy)
