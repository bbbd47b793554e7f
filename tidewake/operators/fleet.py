"""Reports over the latest state: counts, speed, navigation status, courses, turning vessels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions import times, vessel
from tidewake.operators.ranking import interpolated
from tidewake.operators.track import TRACK_WINDOW_HOURS

# ---- Fixed values -------------------------------------------------------------------------
MOVING_KNOTS = 0.5
SPEED_TOP = 20
SPEED_BUCKETS = 20
MANEUVERING_LIMIT = 100
MANEUVERING_MIN_DEG_MIN = 5.0
# -------------------------------------------------------------------------------------------


def valid_vessels(state: DataFrame) -> DataFrame:
    return state.filter(vessel.valid_mmsi())


def fleet_kpis(state: DataFrame, as_of=None) -> DataFrame:
    """All fleet counters in one pass. ``fresh`` and ``stale`` are separate measures."""
    speed = F.coalesce("sog_knots", F.lit(0.0))
    recent = F.col("last_seen_at") > times.minutes_ago(times.as_of_column(as_of), vessel.FRESH_MINUTES)
    return valid_vessels(state).agg(
        F.count("*").alias("total"),
        F.count_if(recent).alias("fresh"),
        F.count_if(F.col("status") == "STALE").alias("stale"),
        F.count_if(speed > MOVING_KNOTS).alias("moving"),
        F.count_if(speed <= MOVING_KNOTS).alias("idle"),
        F.count_if(F.col("status") == "ANCHORED").alias("anchored"),
        F.count_if(F.col("status") == "MOORED").alias("moored"),
        F.avg("sog_knots").alias("avg_sog"),
        F.max("sog_knots").alias("max_sog"))


def events_window(track: DataFrame, as_of=None, hours: int = TRACK_WINDOW_HOURS) -> DataFrame:
    """Track rows of the last hours, of every vessel, valid or not."""
    since = times.hours_ago(times.as_of_column(as_of), hours)
    recent = (F.col("partition_hour") >= F.date_trunc("hour", since)) & (F.col("event_time") > since)
    return track.filter(recent).agg(F.count("*").alias("events_window"))


def status_counts(state: DataFrame) -> DataFrame:
    return (valid_vessels(state).groupBy("status").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "status"))


def fastest_vessel(state: DataFrame) -> DataFrame:
    return (valid_vessels(state).orderBy(F.desc_nulls_last("sog_knots"), "mmsi").limit(1)
            .select("mmsi", "ship_name", "sog_knots"))


def fleet_summary(state: DataFrame, track: DataFrame, as_of=None) -> DataFrame:
    """One row: the counters, the window count, the fastest vessel and the list by status.

    ``state`` is read three times; pass a stored or cached one.
    """
    one = fastest_vessel(state).select(F.struct("mmsi", "ship_name", "sog_knots").alias("v"))
    # One entry per status value, of which there are six.
    listed = (valid_vessels(state).groupBy("status").agg(F.count("*").alias("count"))
              .agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "status", "count")))
                   .alias("l"))
              .select(F.transform("l", lambda s: F.struct(
                  s["status"].alias("status"), s["count"].alias("count"))).alias("l")))
    kpis = fleet_kpis(state, as_of)
    first = ["total", "fresh", "stale", "moving", "idle", "anchored", "moored"]
    return kpis.select(*first, events_window(track, as_of).scalar().alias("events_window"),
                       "avg_sog", "max_sog", one.scalar().alias("fastest"),
                       listed.scalar().alias("by_status"))


def _with_speed(state: DataFrame) -> DataFrame:
    return valid_vessels(state).filter("sog_knots IS NOT NULL")


def speed_histogram(state: DataFrame) -> DataFrame:
    """Vessels per knot; below 0 and from 20 up are open buckets; empty buckets are left out."""
    bucket = F.width_bucket("sog_knots", F.lit(0.0), F.lit(float(SPEED_TOP)), F.lit(SPEED_BUCKETS))
    counted = _with_speed(state).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"))
    top = F.when(F.col("bucket") <= SPEED_BUCKETS, F.col("bucket").cast("double"))
    return counted.select((F.col("bucket") - 1).cast("double").alias("bucket_min"),
                          top.alias("bucket_max"), "count").orderBy("bucket_min")


def speed_stats(state: DataFrame, exact: bool = True) -> DataFrame:
    """Average, interpolated median, maximum and number of known speeds.

    The median works on the count per distinct speed, so it does not depend on how many vessels
    share one. ``exact=False`` uses the approximate percentile instead.
    """
    known = _with_speed(state)
    if not exact:
        return known.agg(F.avg("sog_knots").alias("avg_sog"),
                         F.percentile_approx("sog_knots", 0.5).alias("p50_sog"),
                         F.max("sog_knots").alias("max_sog"), F.count("*").alias("sample_n"))
    counts = known.groupBy("sog_knots").agg(F.count("*").alias("vessels"))
    median = interpolated(counts, "sog_knots", 0.5, weight="vessels").scalar()
    return known.agg(F.avg("sog_knots").alias("avg_sog"), F.max("sog_knots").alias("max_sog"),
                     F.count("*").alias("sample_n")).select(
        "avg_sog", median.alias("p50_sog"), "max_sog", "sample_n")


def speed_distribution(state: DataFrame) -> DataFrame:
    """One row: the histogram as a list (at most 22 buckets) with the statistics."""
    listed = speed_histogram(state).agg(F.array_sort(F.collect_list(
        F.struct("bucket_min", "bucket_max", "count"))))
    return speed_stats(state).select(listed.scalar().alias("buckets"), "*")


def nav_distribution(state: DataFrame) -> DataFrame:
    """Vessels per navigation-status label, largest first, with the commonest code of each label."""
    by_code = valid_vessels(state).groupBy("nav_status").agg(F.count("*").alias("n"))
    return (by_code.groupBy(vessel.nav_label().alias("label"))
            .agg(F.max_by("nav_status", F.struct("n", -F.col("nav_status"))).alias("code"),
                 F.sum("n").alias("count"))
            .select("code", "label", "count").orderBy(F.desc("count"), "label"))


def bucket_total(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def _listed(buckets: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """One row of (buckets, total) from a report of a fixed, small number of buckets."""
    key = F.struct(*order).alias("k")
    ordered = F.array_sort(F.collect_list(F.struct(key, F.struct(*columns).alias("v"))))
    return buckets.agg(F.transform(ordered, lambda s: s["v"]).alias("buckets"),
                       F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def nav_report(state: DataFrame) -> DataFrame:
    return _listed(nav_distribution(state), [(-F.col("count")).alias("n"), F.col("label")],
                   ["code", "label", "count"])


def flow_rose(state: DataFrame) -> DataFrame:
    """Vessels and mean speed per 16-point course sector; silent vessels and bad courses are out."""
    sailing = valid_vessels(state).filter(
        ~vessel.is_stale() & (F.col("cog_degrees") >= 0) & (F.col("cog_degrees") < 360))
    sectors = sailing.groupBy(vessel.compass_sector().alias("sector")).agg(
        F.count("*").alias("count"), F.avg("sog_knots").alias("avg_sog"))
    return sectors.select((F.col("sector") * 22.5).cast("double").alias("sector_deg"),
                          vessel.compass_label("sector").alias("label"), "count",
                          "avg_sog").orderBy("sector_deg")


def flow_report(state: DataFrame) -> DataFrame:
    return _listed(flow_rose(state), [F.col("sector_deg")], ["sector_deg", "label", "count", "avg_sog"])


def maneuvering(state: DataFrame, min_rot_deg_min: float = MANEUVERING_MIN_DEG_MIN,
                limit: int = MANEUVERING_LIMIT, mode: str = "reference") -> DataFrame:
    """Turning vessels: the strongest coded turn rates first, then the threshold on what they mean."""
    if not 0 <= min_rot_deg_min <= 180:
        raise ValueError(f"min_rot_deg_min must be within 0 and 180, got {min_rot_deg_min}")
    top = (valid_vessels(state).filter("rate_of_turn IS NOT NULL")
           .select("mmsi", "ship_name", "rate_of_turn", "sog_knots", "nav_status")
           .orderBy(F.desc(F.abs("rate_of_turn")), "mmsi").limit(limit))
    return (top.withColumn("r", vessel.decode_rot("rate_of_turn", mode))
            .filter(F.col("r.effective") >= F.lit(float(min_rot_deg_min)))
            .select("mmsi", "ship_name", "rate_of_turn", "r.rot_deg_min", "r.direction",
                    "sog_knots", "nav_status"))
