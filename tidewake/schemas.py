"""Declared schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POSITION = T.StructType([
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("message_type", T.StringType()),
    T.StructField("mmsi", T.StringType()),
    T.StructField("ship_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("sog_knots", T.DoubleType()),
    T.StructField("cog_degrees", T.DoubleType()),
    T.StructField("true_heading", T.DoubleType()),
    T.StructField("rate_of_turn", T.DoubleType()),
    T.StructField("nav_status", T.IntegerType()),
    T.StructField("position_accuracy", T.BooleanType()),
    T.StructField("raim", T.BooleanType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("ingested_at", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw", T.StringType()),
])

ARCHIVE_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [
    T.StructField("dt", T.StringType()),
    T.StructField("HH", T.StringType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("mmsi", T.StringType()),
    T.StructField("ship_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("sog_knots", T.DoubleType()),
    T.StructField("cog_degrees", T.DoubleType()),
    T.StructField("true_heading", T.DoubleType()),
    T.StructField("rate_of_turn", T.DoubleType()),
    T.StructField("nav_status", T.IntegerType()),
    T.StructField("position", POSITION),
    T.StructField("status", T.StringType()),
    T.StructField("last_seen_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

TRACK_SCHEMA = T.StructType([
    T.StructField("mmsi", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("sog_knots", T.DoubleType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("position", POSITION),
    T.StructField("partition_hour", T.TimestampType()),
])

DLQ_SCHEMA = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("_dlq_reason", T.StringType()),
    T.StructField("_dlq_source", T.StringType()),
    T.StructField("_dlq_timestamp", T.DoubleType()),
])

# One row per published record; the same three columns feed a Kafka sink or a folder of files.
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
])

FRAME_SCHEMA = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("received_at", T.DoubleType()),
])


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def empty_track(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRACK_SCHEMA)
