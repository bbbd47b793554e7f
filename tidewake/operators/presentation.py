"""Data preparation for maps and charts. The chart functions take finished reports of a few rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import vessel
from tidewake.operators.state import STATE_COLUMNS

# ---- Fixed values -------------------------------------------------------------------------
SECTORS = 16
ROSE_STEPS = 5
TABLE_ROWS = 20
# -------------------------------------------------------------------------------------------


def visible(state: DataFrame, show_stale: bool = True) -> DataFrame:
    """All vessels, or those not STALE; an unknown status stays visible."""
    return state if show_stale else state.filter(~vessel.is_stale())


def visible_count(state: DataFrame, show_stale: bool = True) -> DataFrame:
    return visible(state, show_stale).agg(F.count("*").alias("visible"))


def to_geojson_features(state: DataFrame, show_stale: bool = True,
                        selected_mmsi: str | None = None) -> DataFrame:
    """One GeoJSON Feature per vessel as (mmsi, feature): line-delimited, so it scales."""
    rows = visible(state, show_stale)
    chosen = F.col("mmsi") == F.lit(selected_mmsi or "")
    properties = F.struct(*[F.col(c) for c in STATE_COLUMNS], chosen.alias("selected"))
    geometry = F.struct(F.lit("Point").alias("type"),
                        F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                       properties.alias("properties"))
    return rows.select("mmsi", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def map_symbols(state: DataFrame) -> DataFrame:
    """Colour, rotation and name of each vessel's symbol."""
    return state.select("mmsi", vessel.display_name().alias("name"),
                        vessel.status_color().alias("color"),
                        vessel.icon_rotation().alias("rotation"))


def dense_sectors(spark: SparkSession, rose: DataFrame) -> DataFrame:
    """All 16 sectors, with count 0 where the rose has none."""
    sectors = spark.range(SECTORS).select((F.col("id") * 22.5).cast("double").alias("sector_deg"),
                                          vessel.compass_label("id").alias("label"))
    counts = rose.select("sector_deg", "count", "avg_sog")
    return (sectors.join(counts, "sector_deg", "left")
            .select("sector_deg", "label", F.coalesce("count", F.lit(0)).alias("count"), "avg_sog")
            .orderBy("sector_deg"))


def cumulative_share(report: DataFrame, label: str = "label", count: str = "count") -> DataFrame:
    """Start and end angle of each donut slice, largest first from twelve o'clock."""
    running = W.orderBy(F.desc(count), label).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(count).over(W.partitionBy(F.lit(0)))
    upto = F.sum(count).over(running)

    def angle(part):
        return part / total * F.lit(2 * math.pi) - F.lit(math.pi / 2)

    return report.select("*", angle(upto - F.col(count)).alias("start_angle"),
                         angle(upto).alias("end_angle"))


def share_of_max(report: DataFrame, count: str = "count") -> DataFrame:
    """Share of the largest count (bar height, rose radius) and its 5-step colour index."""
    top = F.greatest(F.max(count).over(W.partitionBy(F.lit(0))), F.lit(1))
    share = F.col(count) / top
    step = F.least(F.lit(ROSE_STEPS - 1), F.floor(share * ROSE_STEPS).cast("int"))
    return report.select("*", share.alias("share"), step.alias("color_index"))


def table_rows(report: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """What the table shows of an ordered report."""
    return report.limit(rows)
