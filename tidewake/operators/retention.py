"""The periodic clean-up cycle: report, apply to frames, apply to stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.vessel import FRESH_MINUTES
from tidewake.operators import state as st
from tidewake.operators.track import TRACK_RETENTION_HOURS
from tidewake.session import stored
from tidewake.sources import archive, tables


def retention_report(state: DataFrame, track: DataFrame, as_of=None,
                     track_hours: int = TRACK_RETENTION_HOURS, stale_minutes: int = FRESH_MINUTES,
                     purge_hours: int = 0) -> DataFrame:
    """Dry run, one row. The STALE candidates include vessels that already are STALE."""
    seen = F.col("last_seen_at") < (st.times.minutes_ago(st.times.as_of_column(as_of), stale_minutes))
    purge = (F.count_if(st.older_than("last_seen_at", as_of, purge_hours)) if purge_hours > 0
             else F.lit(None).cast("long"))
    aging = track.agg(F.count_if(st.older_than("event_time", as_of, track_hours))).scalar()
    counts = state.agg(F.count_if(seen).alias("stale_candidates"),
                       purge.alias("stale_purge_candidates"))
    return counts.select(F.lit(True).alias("dry_run"), aging.alias("track_aging_count"),
                         "stale_candidates", "stale_purge_candidates")


def retention_outcome(state: DataFrame, track: DataFrame, as_of=None,
                      track_hours: int = TRACK_RETENTION_HOURS, stale_minutes: int = FRESH_MINUTES,
                      purge_hours: int = 0) -> DataFrame:
    """What a cycle changes, one row: deleted track rows, vessels newly STALE, vessels purged."""
    purge = (F.count_if(st.older_than("last_seen_at", as_of, purge_hours)) if purge_hours > 0
             else F.lit(None).cast("long"))
    deleted = track.agg(F.count_if(st.older_than("event_time", as_of, track_hours))).scalar()
    counts = state.agg(F.count_if(st.stale_now(as_of, stale_minutes)).alias("stale_marked"),
                       purge.alias("stale_purged"))
    return counts.select(F.lit(False).alias("dry_run"), deleted.alias("track_deleted"),
                         "stale_marked", "stale_purged")


def aged_states(state: DataFrame, as_of=None, stale_minutes: int = FRESH_MINUTES, purge_hours: int = 0) -> DataFrame:
    """The stored states that a cycle changes: newly STALE, or purged, with the time of the purge."""
    purge = st.older_than("last_seen_at", as_of, purge_hours) if purge_hours > 0 else F.lit(False)
    stale = st.stale_now(as_of, stale_minutes)
    mark = F.when(purge, tables.PURGED).when(stale, tables.AGED)
    return state.withColumns({
        "_mark": mark, "status": F.when(stale, F.lit("STALE")).otherwise(F.col("status")),
        "updated_at": F.when(purge, F.current_timestamp()).otherwise(F.col("updated_at"))}).where("_mark is not null")


def run_retention(spark: SparkSession, state_path: str, track_path: str, as_of: datetime,
                  track_hours: int = TRACK_RETENTION_HOURS, stale_minutes: int = FRESH_MINUTES,
                  purge_hours: int = 0, archive_path: str | None = None,
                  archive_days: int = archive.ARCHIVE_RETENTION_DAYS, dry_run: bool = False) -> dict:
    """One cycle on the stored tables; returns its record. Run it from any scheduler."""
    state = stored(tables.state_snapshot(spark, state_path), "state")
    track = tables.read_track(spark, track_path)
    report = retention_report if dry_run else retention_outcome
    result = report(state, track, as_of, track_hours, stale_minutes, purge_hours).first().asDict()
    if purge_hours <= 0:
        result = {k: v for k, v in result.items() if not k.startswith("stale_purge")}
    if not dry_run:
        tables.expire_track(spark, track_path, as_of, track_hours)
        tables.append_state(aged_states(state, as_of, stale_minutes, purge_hours), state_path)
        tables.carry_state(spark, state_path)
    if archive_path:
        result["archive_days_expired"] = len(
            archive.expire_archive(spark, archive_path, as_of, archive_days, dry_run))
    return result
