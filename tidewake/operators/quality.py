"""Data quality and latency of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewake.functions import times
from tidewake.operators.ranking import rank_select
from tidewake.session import stored
from tidewake.sources.archive import cutoff_of

# ---- Fixed values -------------------------------------------------------------------------
DEFAULT_WINDOW_HOURS = 24
MAX_WINDOW_HOURS = 168
# -------------------------------------------------------------------------------------------


QUALITY = ("window_hours int, events_processed long, parquet_files long, latency struct<avg_s: double, p50_s: double, "
           "p95_s: double, max_s: double, events_negative_latency: long>, missing_position long, missing_sog long, "
           "missing_cog long, invalid_coordinates long")


def _check(window_hours: int) -> None:
    if not 0 < window_hours <= MAX_WINDOW_HOURS:
        raise ValueError(f"window_hours must be within 1 and {MAX_WINDOW_HOURS}, got {window_hours}")


def in_archive_window(archive: DataFrame, as_of=None,
                      window_hours: int = DEFAULT_WINDOW_HOURS) -> DataFrame:
    """Hour folders of the window; rows are not yet compared."""
    return archive.filter(times.in_window("dt", "HH", cutoff_of(as_of, window_hours)))


def arrived_in_window(archive: DataFrame, as_of=None,
                      window_hours: int = DEFAULT_WINDOW_HOURS) -> DataFrame:
    cutoff = times.epoch_seconds(cutoff_of(as_of, window_hours))
    return in_archive_window(archive, as_of, window_hours).filter(F.col("ingested_at") >= cutoff)


def source_latency() -> Column:
    """Seconds from event to arrival; NULL when the event time cannot be read."""
    return F.col("ingested_at") - times.epoch_seconds(times.parse_event_time_as_utc("event_time"))


def latency_ranks(latencies: DataFrame, column: str = "latency") -> DataFrame:
    """Rows (rank_name, k, value) for p50 and p95, picked by index from the sorted values."""
    return rank_select(latencies, column, {
        "p50": F.floor(F.col("n") / 2),
        "p95": F.floor(F.col("n") * F.lit(0.95)),
    })


def _seen_once(rows: DataFrame, label: str, *counters: Column) -> tuple[DataFrame, dict]:
    """The non-negative values of ``latency`` as a stored column, and the counters, of one pass over ``rows``."""
    seen = Observation()
    kept = rows.observe(seen, *counters).select(F.when(F.col("latency") >= 0, F.col("latency")).alias("latency"))
    return stored(kept, label), seen.get


def _latency_counters() -> list[Column]:
    known = F.when(F.col("latency") >= 0, F.col("latency"))
    return [F.bround(F.avg(known), 1).alias("avg_s"), F.max(known).alias("max_s"),
            F.count_if(F.col("latency") < 0).alias("events_negative_latency")]


def _percentiles(latencies: DataFrame) -> dict:
    return {r.rank_name: r.value for r in latency_ranks(latencies).collect()}


def latency_stats(archive: DataFrame, as_of=None,
                  window_hours: int = DEFAULT_WINDOW_HOURS) -> DataFrame:
    """One row: avg (1 decimal), p50, p95, max of the non-negative latencies, and the negative ones.

    The archive is read once, when this is called: it leaves the latencies as one stored column, which the ranks are read from.
    """
    _check(window_hours)
    rows = arrived_in_window(archive, as_of, window_hours).select(source_latency().alias("latency"))
    latencies, seen = _seen_once(rows, "latency", *_latency_counters())
    ranks = _percentiles(latencies)
    return archive.sparkSession.createDataFrame(
        [(seen["avg_s"], ranks.get("p50"), ranks.get("p95"), seen["max_s"], seen["events_negative_latency"])],
        "avg_s double, p50_s double, p95_s double, max_s double, events_negative_latency long")


def files_scanned(archive: DataFrame, as_of=None, window_hours: int = DEFAULT_WINDOW_HOURS,
                  file: str = "file") -> DataFrame:
    """Number of archive files in the window's folders."""
    return in_archive_window(archive, as_of, window_hours).agg(
        F.count_distinct(file).alias("parquet_files"))


def data_quality(archive: DataFrame, as_of=None, window_hours: int = DEFAULT_WINDOW_HOURS,
                 file: str = "file") -> DataFrame:
    """One row: events, files, latency and what is missing, over the window's arrivals.

    Without a ``file`` column in the archive the number of files is NULL.

    The counters and the latencies come from one pass over seven columns of the pruned hours, when this is called.
    """
    _check(window_hours)
    window = arrived_in_window(archive, as_of, window_hours)
    rows = window.select("latitude", "longitude", "sog_knots", "cog_degrees",
                         source_latency().alias("latency"))
    no_position = F.col("latitude").isNull() | F.col("longitude").isNull()
    inside = F.col("latitude").between(-90.0, 90.0) & F.col("longitude").between(-180.0, 180.0)
    latencies, seen = _seen_once(
        rows, "quality",
        F.count(F.lit(1)).alias("events_processed"),
        F.count_if(no_position).alias("missing_position"),
        F.count_if(F.col("sog_knots").isNull()).alias("missing_sog"),
        F.count_if(F.col("cog_degrees").isNull()).alias("missing_cog"),
        F.count_if(~no_position & ~inside).alias("invalid_coordinates"), *_latency_counters())
    ranks = _percentiles(latencies)
    files = files_scanned(archive, as_of, window_hours, file).first()[0] if file in archive.columns else None
    latency = (seen["avg_s"], ranks.get("p50"), ranks.get("p95"), seen["max_s"], seen["events_negative_latency"])
    counts = [seen[c] for c in ("missing_position", "missing_sog", "missing_cog", "invalid_coordinates")]
    return archive.sparkSession.createDataFrame(
        [(int(window_hours), seen["events_processed"], files, latency, *counts)], QUALITY)


def missing_motion(report: DataFrame) -> DataFrame:
    """The report card's sum of missing speeds and courses."""
    return report.select((F.col("missing_sog") + F.col("missing_cog")).alias("missing_motion"))
