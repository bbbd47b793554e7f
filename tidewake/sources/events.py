"""Vessel reports derived from the ``events`` table by plain arithmetic.

The test tables hold no ship positions, so every registered query works on one of three views of
``events``, each with as many rows as the table:

* ``positions`` - canonical events, many per vessel (``user_id`` is the vessel);
* ``fleet`` - one vessel per event, a third of them crowded into one small harbour;
* ``frames`` - the raw JSON frames, with every kind of defect among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.schemas import EVENT_SCHEMA
from tidewake.sources.log import BATCH_BYTES, bounded

# Expressions over event_id, user_id, value and ts (timestamp); integers until the last step, so
# that any engine gets the same double.
POSITION_EXPR = {
    "event_id": "cast(event_id as string)",
    "schema_version": "'1.0'",
    "message_type": "'PositionReport'",
    "mmsi": "case when user_id % 25 = 0 then concat('BAD', cast(user_id as string)) "
            "else cast(200000000 + user_id as string) end",
    "ship_name": "case when user_id % 10 = 3 then null else concat('VESSEL ', cast(user_id as string)) end",
    "latitude": "(1200000 + ((user_id * 37) % 40) * 3000 + (event_id % 7) * 500) / 1e6",
    "longitude": "(103600000 + ((user_id * 53) % 40) * 3000 + (event_id % 5) * 500) / 1e6",
    "sog_knots": "case when event_id % 17 = 0 then null else value % 25d end",
    "cog_degrees": "case when event_id % 19 = 0 then null else ((event_id * 45) % 7400) / 20d end",
    "true_heading": "case when event_id % 23 = 0 then null else cast(event_id % 360 as double) end",
    "rate_of_turn": "case when event_id % 257 = 0 then null else cast(event_id % 257 - 128 as double) end",
    "nav_status": "case when (event_id * 5) % 17 = 16 then null else cast((event_id * 5) % 17 as int) end",
    "position_accuracy": "case when event_id % 3 = 0 then null else event_id % 3 = 1 end",
    "raim": "event_id % 2 = 0",
    "event_time": "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), ' +0000 UTC')",
    "ingested_at": "unix_micros(ts) / 1e6 + value - 5d",
    "source": "'aisstream'",
    "raw": "cast(null as string)",
}
FLEET_EXPR = {
    "mmsi": "cast(200000000 + event_id as string)",
    "latitude": "case when event_id % 3 = 0 then (1250000 + (k * k * 31 + k * 17) % 3989 * 2) / 1e6 "
                "else (1000000 + (k * k * 31 + k * 17) % 3989 * 500) / 1e6 end",
    "longitude": "case when event_id % 3 = 0 then (103750000 + (k * k * 13 + k * 7) % 4001 * 2) / 1e6 "
                 "else (103000000 + (k * k * 13 + k * 7) % 4001 * 500) / 1e6 end",
}


SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
          "props STRING")


def _columns(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four columns the views need, with ``ts`` as a UTC instant."""
    return _columns(spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def as_positions(events: DataFrame) -> DataFrame:
    return events.select(*[F.expr(POSITION_EXPR[f.name]).cast(f.dataType).alias(f.name)
                           for f in EVENT_SCHEMA], F.col("event_id").alias("seq"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events plus ``seq``, the order of arrival."""
    return as_positions(read_events(spark, sf_dir))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of one vessel each."""
    events = read_events(spark, sf_dir).withColumn("k", F.expr("event_id % 1000003"))
    expr = {**POSITION_EXPR, **FLEET_EXPR}
    return events.select(*[F.expr(expr[f.name]).cast(f.dataType).alias(f.name)
                           for f in EVENT_SCHEMA], F.col("event_id").alias("seq"))


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The last event's instant, as a scalar subquery."""
    events = spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return events.agg(F.max("ts").cast("timestamp")).scalar()


def as_frames(events: DataFrame) -> DataFrame:
    """Raw frames ``(event_id, value, received_at)``; ``event_id % 23`` picks the defect."""
    kind = F.col("event_id") % 23
    p = events.select(F.col("event_id"), F.col("ts"), *[
        F.expr(POSITION_EXPR[n]).alias("_" + n) for n in
        ("mmsi", "ship_name", "latitude", "longitude", "sog_knots", "cog_degrees", "true_heading",
         "rate_of_turn", "nav_status", "ingested_at")])
    shift = F.when(kind == 4, 7200).when(kind == 5, -25200).otherwise(0)
    moved = F.timestamp_micros(F.unix_micros("ts") + shift.cast("long") * 1000000)
    time_utc = (F.when(kind == 3, F.lit("not-a-date")).when(kind == 13, F.lit(None))
                .otherwise(F.concat(F.date_format(moved, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                                    F.lit(" +0000 UTC"))))

    def pair(key: str, value: Column, present: Column | None = None) -> Column:
        text = F.concat(F.lit(f'"{key}":'), value)
        return text if present is None else F.when(present, text)

    def obj(*pairs: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("null"))

    def quoted(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))

    latitude = (F.when(kind == 2, F.lit("95.0")).when(kind == 15, F.lit('"1.2"'))
                .otherwise(number(F.col("_latitude"))))
    longitude = F.when(kind == 10, F.lit("null")).otherwise(number(F.col("_longitude")))
    sog = F.when(kind == 8, F.lit("-1")).otherwise(number(F.col("_sog_knots")))
    cog = F.when(kind == 1, F.lit("null")).otherwise(number(F.col("_cog_degrees")))
    position = obj(
        pair("NavigationalStatus", number(F.col("_nav_status"))),
        pair("RateOfTurn", number(F.coalesce(F.col("_rate_of_turn").cast("int"), F.lit(-128)))),
        pair("Sog", sog), pair("PositionAccuracy", number(F.col("event_id") % 2)),
        pair("Longitude", longitude), pair("Latitude", latitude),
        pair("Cog", cog, kind != 0),
        pair("TrueHeading", number(F.coalesce(F.col("_true_heading").cast("int"), F.lit(511)))),
        pair("Raim", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")))
    name = F.concat(F.lit("  "), F.col("_ship_name"), F.lit(" "))
    meta = F.when(kind == 11, F.lit('"none"')).otherwise(obj(
        pair("MMSI", quoted(F.col("_mmsi"))), pair("ShipName", quoted(name)),
        pair("time_utc", quoted(time_utc))))
    message = F.when(kind == 12, F.lit("{}")).otherwise(obj(pair("PositionReport", position)))
    label = (F.when(kind == 6, "ShipStaticData").when(kind == 14, "Bogus").otherwise("PositionReport"))
    whole = obj(pair("MessageType", quoted(label)), pair("MetaData", meta, kind != 7),
                pair("Message", message))
    return p.select("event_id", F.when(kind == 9, F.lit("not json")).otherwise(whole).alias("value"),
                    F.col("_ingested_at").alias("received_at"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames, dealt out to all cores: decoding is far dearer than moving four columns."""
    events = read_events(spark, sf_dir)
    return as_frames(events.repartition(spark.sparkContext.defaultParallelism))


def by_arrival(events: DataFrame, tasks: int) -> DataFrame:
    """Events dealt out to ``tasks`` by their time of arrival, so that records of one time lie together."""
    return events.repartitionByRange(tasks, F.expr(POSITION_EXPR["ingested_at"]))


def stream_events(spark: SparkSession, sf_dir: str, max_files: int | None = None,
                  max_bytes: int | None = BATCH_BYTES) -> DataFrame:
    """The ``events`` table as a file stream of bounded micro-batches."""
    reader = bounded(spark.readStream.schema(SCHEMA), max_files, max_bytes)
    return _columns(reader.option("pathGlobFilter", "events*.parquet").parquet(sf_dir))
