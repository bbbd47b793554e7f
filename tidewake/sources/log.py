"""The record log: keyed JSON records on a Kafka topic, or the same rows in a folder of files."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import frames as fr
from tidewake.functions.times import as_of_column, epoch_seconds
from tidewake.schemas import DLQ_SCHEMA, EVENT_SCHEMA, RECORD_SCHEMA

# ---- Fixed values -------------------------------------------------------------------------
RAW_TOPIC = "ais.raw"
DLQ_TOPIC = "ais.dlq"
# -------------------------------------------------------------------------------------------

# What one micro-batch reads at most, unless the caller says otherwise.
BATCH_BYTES = 256 << 20
BATCH_OFFSETS = 500_000
# A row group is what one task reads at least; smaller ones than usual let a batch of few files go to all cores.
ROW_GROUP_BYTES = 16 << 20

KEEP_NULLS = {"ignoreNullFields": "false"}
_TEXT_FIELDS = [f.name for f in EVENT_SCHEMA if f.dataType.simpleString() == "string"]
_NUMBER_FIELDS = [f.name for f in EVENT_SCHEMA if f.dataType.simpleString() in ("double", "int")]
_FLAG_FIELDS = [f.name for f in EVENT_SCHEMA if f.dataType.simpleString() == "boolean"]


def event_json(columns=None) -> Column:
    """A canonical event as JSON text, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in (columns or EVENT_SCHEMA.names)]), KEEP_NULLS)


def to_log_records(events: DataFrame, topic: str = RAW_TOPIC) -> DataFrame:
    """Records keyed by vessel, so one vessel's reports stay in order on one partition."""
    return events.select(F.col("mmsi").alias("key"), event_json().alias("value"),
                         F.lit(topic).alias("topic"))


def to_dlq(df: DataFrame, event: Column, reason: Column, source: str, now=None) -> DataFrame:
    """Quarantine rows: the event's JSON text with reason, source and time."""
    return df.select(event.alias("event"), reason.alias("_dlq_reason"),
                     F.lit(source).alias("_dlq_source"),
                     epoch_seconds(as_of_column(now)).alias("_dlq_timestamp"))


def dlq_value() -> Column:
    """The quarantine envelope as one JSON object with the event nested in it."""
    as_string = F.try_variant_get(F.to_variant_object(F.array("event")), "$[0]", "variant")
    nested = F.coalesce(F.try_parse_json("event"), as_string)
    return F.to_json(F.struct(nested.alias("event"), *[F.col(c) for c in DLQ_SCHEMA.names[1:]]),
                     KEEP_NULLS)


def to_dlq_records(dlq: DataFrame, topic: str = DLQ_TOPIC) -> DataFrame:
    return dlq.select(F.lit(None).cast("string").alias("key"), dlq_value().alias("value"),
                      F.lit(topic).alias("topic"))


def bounded(reader, max_files: int | None = None, max_bytes: int | None = BATCH_BYTES):
    """A file stream reader with a bound per micro-batch: a number of files, or bytes."""
    if max_files:
        return reader.option("maxFilesPerTrigger", max_files)
    return reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader


def read_records(spark: SparkSession, source: str | dict, streaming: bool = False,
                 max_files: int | None = None, max_bytes: int | None = BATCH_BYTES) -> DataFrame:
    """Records of a folder (path) or of Kafka (a dict of its reader options).

    A stream's micro-batches are bounded: by ``max_files``, else by ``max_bytes``; on Kafka by
    ``maxOffsetsPerTrigger``. Kafka needs its connector on the class path; there (partition,
    offset) give the arrival order.
    """
    reader = spark.readStream if streaming else spark.read
    if isinstance(source, dict):
        bound = {"maxOffsetsPerTrigger": str(BATCH_OFFSETS)} if streaming else {}
        df = reader.format("kafka").options(**{"startingOffsets": "earliest", **bound, **source}).load()
        return df.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic",
                         "partition", "offset")
    reader = bounded(reader, max_files, max_bytes) if streaming else reader
    return reader.schema(RECORD_SCHEMA).parquet(source).select(*RECORD_SCHEMA.names)


def decode_events(records: DataFrame) -> DataFrame:
    """Canonical columns of log records, plus ``_value`` and ``_bad``.

    Empty records are skipped. ``_bad`` names every field that is present and not null but
    cannot take its column's type. Two tiers: a record that a typed read and ``event_json`` give back letter by letter, as all
    that the ingest job wrote, is as its types say; only any other one is parsed as VARIANT.
    """
    staged = records.filter("value IS NOT NULL").withColumn("_typed", F.from_json("value", EVENT_SCHEMA))
    staged = staged.withColumn("_certain", F.coalesce(F.to_json("_typed", KEEP_NULLS) == F.col("value"), F.lit(False)))
    v = staged.withColumn("_v", F.when(~F.col("_certain"), F.try_parse_json("value")))
    v = v.withColumn("_found", F.when(~F.col("_certain"), F.try_variant_get("_v", "$", "map<string,variant>")))
    raw = {n: F.try_element_at("_found", F.lit(n)) for n in EVENT_SCHEMA.names}

    def typed(f) -> Column:
        value = raw[f.name]
        if f.name in _FLAG_FIELDS:
            return fr.truth(value)
        if f.name in _TEXT_FIELDS:
            return fr.as_text(value)
        return F.try_variant_get(value, "$", f.dataType.simpleString())

    bad = [F.when(raw[n].isNotNull() & ~F.is_variant_null(raw[n])
                  & F.try_variant_get(raw[n], "$", EVENT_SCHEMA[n].dataType.simpleString()).isNull(),
                  F.lit(n)) for n in _NUMBER_FIELDS]
    bad.append(F.when(F.col("_v").isNull(), F.lit("value")))
    none = F.array().cast("array<string>")
    fields = F.when(F.col("_certain"), F.struct(
        *[F.col(f"_typed.{n}").alias(n) for n in EVENT_SCHEMA.names], none.alias("_bad"))).otherwise(F.struct(
            *[typed(f).alias(f.name) for f in EVENT_SCHEMA], F.array_compact(F.array(*bad)).alias("_bad")))
    extra = [c for c in ("partition", "offset") if c in records.columns]
    decoded = v.withColumn("_fields", fields).select(
        *[F.col(f"_fields.{n}").alias(n) for n in EVENT_SCHEMA.names], F.col("value").alias("_value"),
        F.col("_fields._bad").alias("_bad"), *extra)
    return fr.evaluated_once(decoded)


def read_log(spark: SparkSession, source: str | dict, streaming: bool = False,
             topic: str = RAW_TOPIC, max_files: int | None = None,
             max_bytes: int | None = BATCH_BYTES) -> DataFrame:
    """Decoded canonical events from the log, from the earliest record on."""
    records = read_records(spark, source, streaming, max_files, max_bytes)
    return decode_events(records.filter(F.col("topic") == topic))


def read_dlq(spark: SparkSession, source: str | dict, topic: str = DLQ_TOPIC) -> DataFrame:
    records = read_records(spark, source).filter(F.col("topic") == topic)
    v = F.try_parse_json("value")
    return records.select(
        F.to_json(fr.field(v, "$.event")).alias("event"),
        fr.as_text(fr.field(v, "$._dlq_reason")).alias("_dlq_reason"),
        fr.as_text(fr.field(v, "$._dlq_source")).alias("_dlq_source"),
        fr.as_double(fr.field(v, "$._dlq_timestamp")).alias("_dlq_timestamp"))


def write_records(records: DataFrame, path: str) -> None:
    """Append records to a folder log; every call has a place of its own."""
    publish(records, path, uuid.uuid4().hex, 0)


def publish(records: DataFrame, sink: str | dict, run: str, batch: int) -> None:
    """One job's micro-batch to the log: a folder (path) or Kafka (a dict of its options).

    In a folder ``run`` and ``batch`` name the records' place, so a replay of the batch replaces its own
    records and no others; on Kafka a replay repeats them.
    """
    if isinstance(sink, dict):
        records.write.format("kafka").options(**sink).save()
        return
    (records.withColumns({"run": F.lit(run), "batch": F.lit(int(batch)).cast("long")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP_BYTES)
     .partitionBy("topic", "run", "batch").parquet(sink))
