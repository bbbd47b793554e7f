"""Frames to canonical events: type gate, validation, normalising, skew gate and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import frames as fr
from tidewake.functions import times, vessel
from tidewake.functions.times import as_column
from tidewake.schemas import EVENT_SCHEMA
from tidewake.sources import log

# ---- Fixed values -------------------------------------------------------------------------
SCHEMA_VERSION = "1.0"
FEED_SOURCE = "aisstream"
VALIDATION_FAILED = "validation_failed"
ROW_BUILD_FAILED = "row_build_failed"
DB_INSERT_FAILED = "db_insert_failed"
SERIALIZATION_FAILED = "parquet_serialization_failed"
INGEST_SERVICE = "ingestion"
STATE_SERVICE = "stream_processor"
ARCHIVE_SERVICE = "raw_sink"
TRACK_SERVICE = "track_writer"
# -------------------------------------------------------------------------------------------


def position_reports(frames: DataFrame) -> DataFrame:
    """Type gate: any other message type is dropped without a trace."""
    frame = F.col("frame") if "frame" in frames.columns else fr.frame_variant("value")
    return frames.filter(fr.as_string_only(fr.field(frame, "$.MessageType")) == fr.POSITION_REPORT)


def validate(frames: DataFrame) -> DataFrame:
    """Adds ``errors`` (sorted) and ``valid``."""
    checked = fr.with_errors(fr.with_fields(frames))
    return checked.select(*frames.columns, F.col("_errors").alias("errors"),
                          (F.size("_errors") == 0).alias("valid"))


def event_id(frame="frame", received_at=None, text=None) -> Column:
    """md5 of the key-sorted frame with its arrival stamp; without one, of the frame alone.

    With the stamp a frame received twice has two ids; leave it out to identify content. ``text``, the frame's JSON, spares
    looking for a stamp where it can hold none: neither its name nor an escaped letter.
    """
    frame = as_column(frame)
    keys = F.try_variant_get(frame, "$", "map<string,variant>")
    stamped = fr.field(frame, "$._received_at").isNotNull()
    if text is not None:
        text = as_column(text)
        stamped = F.when(text.contains("_received_at") | text.contains("\\"), stamped).otherwise(F.lit(False))
    bare = F.map_filter(keys, lambda k, _: k != "_received_at")
    canonical = F.when(stamped, F.to_json(bare)).otherwise(F.to_json(frame))
    if received_at is None:
        return F.md5(canonical)
    return F.md5(F.concat(canonical, F.lit("|"), as_column(received_at).cast("string")))


def canonical_columns() -> list[Column]:
    """The 18 canonical fields, over the columns of ``with_fields`` and ``_whole``, the frame as VARIANT."""
    columns = {
        "event_id": event_id("_whole", "received_at", "value"),
        "schema_version": F.lit(SCHEMA_VERSION),
        "message_type": F.col("message_type"),
        "mmsi": F.coalesce("_mmsi", F.lit("None")),
        "ship_name": F.btrim("_name", F.lit(" \t\r\n")),
        "latitude": F.col("_Latitude"),
        "longitude": F.col("_Longitude"),
        "sog_knots": F.col("_Sog"),
        "cog_degrees": F.col("_Cog"),
        "true_heading": vessel.heading("_TrueHeading"),
        "rate_of_turn": vessel.rate_of_turn("_RateOfTurn"),
        "nav_status": F.col("_nav"),
        "position_accuracy": F.col("_accuracy"),
        "raim": F.col("_raim"),
        "event_time": F.col("_time"),
        "ingested_at": F.col("received_at"),
        "source": F.lit(FEED_SOURCE),
        "raw": fr.stamped_text("value", "received_at"),
    }
    return [columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA]


def normalize(frames: DataFrame) -> DataFrame:
    """Frames to the canonical 18 columns."""
    return fr.with_fields(frames).withColumn("_whole", fr.whole_frame()).select(*canonical_columns())


def ingest(frames: DataFrame, future_s: float = times.FUTURE_TOLERANCE_S,
           stale_s: float = times.STALE_TOLERANCE_S) -> DataFrame:
    """Canonical columns of every frame plus ``_route``, ``_reason``, ``_errors``, ``_latency_ms``.

    ``_route`` is ``skip`` (other message types), ``dlq`` or ``publish``. An absent or null time
    is quarantined as unparseable. One pass, no shuffle.
    """
    checked = fr.with_errors(fr.with_fields(frames)).withColumn("_whole", fr.whole_frame()).select(
        *canonical_columns(), "_errors", "_event_ts")
    is_report = F.coalesce(F.col("message_type") == fr.POSITION_REPORT, F.lit(False))
    reason = (F.when(~is_report, F.lit(None))
              .when(F.size("_errors") > 0, F.lit(VALIDATION_FAILED))
              .otherwise(times.classify_skew("_event_ts", "ingested_at", future_s, stale_s)))
    routed = checked.withColumn("_reason", reason)
    route = (F.when(~is_report, "skip").when(F.col("_reason").isNotNull(), "dlq")
             .otherwise("publish"))
    return routed.select(*EVENT_SCHEMA.names, route.alias("_route"), "_reason", "_errors",
                         times.latency_ms("_event_ts", "ingested_at").alias("_latency_ms"))


def published(routed: DataFrame) -> DataFrame:
    return routed.filter("_route = 'publish'").select(*EVENT_SCHEMA.names)


def quarantined(routed: DataFrame, now=None) -> DataFrame:
    """Invalid frames as received, skewed ones in canonical form."""
    event = F.when(F.col("_reason") == VALIDATION_FAILED, F.col("raw")).otherwise(log.event_json())
    return log.to_dlq(routed.filter("_route = 'dlq'"), event, F.col("_reason"), INGEST_SERVICE, now)


def ingest_records(routed: DataFrame, raw_topic: str = log.RAW_TOPIC,
                   dlq_topic: str = log.DLQ_TOPIC) -> DataFrame:
    """Published and quarantined rows as (key, value, topic) in one pass, ready for one sink."""
    to_quarantine = F.col("_route") == "dlq"
    rows = routed.filter("_route <> 'skip'").select(
        "mmsi", "_route", log.event_json().alias("_canonical"), "raw",
        F.col("_reason").alias("_dlq_reason"), F.lit(INGEST_SERVICE).alias("_dlq_source"),
        times.epoch_seconds(F.current_timestamp()).alias("_dlq_timestamp"))
    rows = rows.withColumn("event", F.when(F.col("_dlq_reason") == VALIDATION_FAILED, F.col("raw"))
                           .otherwise(F.col("_canonical")))
    return rows.select(
        F.when(~to_quarantine, F.col("mmsi")).alias("key"),
        F.when(to_quarantine, log.dlq_value()).otherwise(F.col("_canonical")).alias("value"),
        F.when(to_quarantine, F.lit(dlq_topic)).otherwise(F.lit(raw_topic)).alias("topic"))


# ---- Rows a sink cannot take --------------------------------------------------------------

def poison_reason(target: str) -> Column:
    """Why a decoded event cannot enter the ``archive`` or the ``state`` tables; NULL when it can."""
    bad = F.col("_bad")
    if target == "archive":
        return F.when(F.size(bad) > 0, F.lit(SERIALIZATION_FAILED))
    if target != "state":
        raise ValueError(f"unknown target {target!r}")
    failed = F.lit(ROW_BUILD_FAILED + ": ")
    dropped = (F.col("latitude").isNull() | F.col("longitude").isNull()
               | (F.coalesce(F.col("mmsi"), F.lit("")) == ""))
    dropped = dropped & ~F.arrays_overlap(bad, F.array(F.lit("latitude"), F.lit("longitude")))
    return (F.when(F.array_contains(bad, "value"), F.concat(failed, F.lit("value")))
            .when(F.array_contains(bad, "sog_knots") & F.col("nav_status").isin(0, 8),
                  F.concat(failed, F.lit("sog_knots")))
            .when(F.array_contains(bad, "ingested_at")
                  & times.parse_event_time("event_time").isNull(),
                  F.concat(failed, F.lit("ingested_at")))
            .when(dropped, F.lit(None))
            .when((F.size(F.array_remove(bad, "ingested_at")) > 0) | F.col("event_id").isNull(),
                  F.lit(DB_INSERT_FAILED)))


def mark_poison(decoded: DataFrame, target: str) -> DataFrame:
    """Adds ``_poison``, the reason, and ``_broken`` in place of ``_bad``. Only rows that have a reason keep their text, so a
    batch that is cached does not hold the others twice.
    """
    marked = decoded.withColumn("_poison", poison_reason(target))
    return marked.withColumns({"_value": F.when(F.col("_poison").isNotNull(), F.col("_value")),
                               "_broken": F.size("_bad") > 0}).drop("_bad")


def split_poison(decoded: DataFrame, target: str, now=None,
                 service: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored, quarantine rows); one bad row never holds up the others."""
    marked = decoded if "_poison" in decoded.columns else decoded.withColumn("_poison", poison_reason(target))
    service = service or (ARCHIVE_SERVICE if target == "archive" else STATE_SERVICE)
    good = marked.filter("_poison IS NULL").drop("_poison", "_bad", "_broken", "_value")
    bad = log.to_dlq(marked.filter("_poison IS NOT NULL"), F.col("_value"), F.col("_poison"),
                     service, now)
    return good, bad
