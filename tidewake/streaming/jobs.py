"""The pipeline as independent, restartable streams: ingest, archive, state and track.

Each job has its own checkpoint and its own sink, like separate consumer groups on one log. Micro-batches
are bounded by the readers (``log.read_records``). A replayed batch repeats nothing in a folder, also under a new
checkpoint with other batch borders: log records have their place by job and batch, archive and track rows are looked
up by id, and of a vessel's stored states the last to arrive counts. A failing sink fails the micro-batch, which is replayed from the checkpoint.
Rows that can never be stored go to the log's quarantine topic, so one bad row neither holds up the others nor is lost.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewake.functions import times
from tidewake.functions.vessel import FRESH_MINUTES
from tidewake.operators import ingest as ing
from tidewake.operators import state as st
from tidewake.operators import track as tr
from tidewake.schemas import STATE_SCHEMA
from tidewake.sources import archive, log, paths, tables

# ---- Fixed values -------------------------------------------------------------------------
STATE_FLUSH_ROWS = 500
STATE_FLUSH_SECONDS = 5
STALE_SECONDS = 300
# -------------------------------------------------------------------------------------------

SILENCE_DELAY = "10 minutes"
MARKS = ("_poison", "_broken", "_value")


def _trigger(seconds: float | None) -> dict:
    """Every ``seconds``, or with None everything available and then stop."""
    return {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}


def kafka_flush_options(rows: int, seconds: int, most: int = log.BATCH_OFFSETS) -> dict:
    """Kafka reader options for "flush at so many rows or after so many seconds", and a bound."""
    return {"minOffsetsPerTrigger": str(rows), "maxTriggerDelay": f"{seconds}s",
            "maxOffsetsPerTrigger": str(most)}


def kafka_archive_options() -> dict:
    return kafka_flush_options(archive.FLUSH_MAX_ROWS, archive.FLUSH_MAX_SECONDS)


def kafka_state_options() -> dict:
    return kafka_flush_options(STATE_FLUSH_ROWS, STATE_FLUSH_SECONDS)


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave to the query of a checkpoint; another one for every new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_ingest(frames: DataFrame, sink: str | dict, checkpoint: str,
                 seconds: float | None = None, future_s: float = times.FUTURE_TOLERANCE_S,
                 stale_s: float = times.STALE_TOLERANCE_S, name: str = "ingest",
                 spread: int | None = None) -> StreamingQuery:
    """Frames to the log: canonical events on one topic, quarantined ones on the other.

    Both topics leave in one pass with the topic as a column: to a folder of files (path) or
    Kafka (a dict of its options). ``spread`` deals frames out to so many tasks first, by their time of arrival, so that
    records of one time lie together; for sources of few splits, since decoding is far dearer than moving the text.
    """
    routed = ing.ingest(frames.repartitionByRange(spread, "received_at") if spread else frames, future_s, stale_s).observe(
        name, F.count("*").alias("frames"),
        F.count_if(F.col("_route") == "publish").alias("published"),
        F.count_if(F.col("_route") == "dlq").alias("quarantined"),
        F.count_if(F.col("_route") == "skip").alias("skipped"))

    def flush(batch: DataFrame, batch_id: int) -> None:
        log.publish(batch, sink, run_of(batch.sparkSession, checkpoint), batch_id)

    return _for_each(ing.ingest_records(routed), flush, checkpoint, name, seconds)


def start_archive(events: DataFrame, path: str, checkpoint: str, dlq: str | dict,
                  seconds: float | None = archive.FLUSH_MAX_SECONDS,
                  name: str = "archive", metrics: str | None = None) -> StreamingQuery:
    """Decoded log events to the hour-partitioned archive; known events are not stored again."""
    def store(good: DataFrame) -> int:
        return archive.write_archive(good, path)

    return _start_sink(events, "archive", archive.dated, store, path, checkpoint, dlq, name, seconds, metrics)


def _start_sink(events: DataFrame, target: str, prepare, store, path: str, checkpoint: str, dlq: str | dict, name: str,
                seconds: float | None, metrics: str | None, service: str | None = None) -> StreamingQuery:
    """A consumer of the log: ``store(good)`` writes the rows that can be stored below ``path`` and returns their number; the
    others went to the quarantine topic before.

    ``prepare`` leaves or adds the columns that ``store`` reads, before the batch is cached, so each is made once and no
    others are kept. With ``metrics``, a folder, every batch leaves a row of counters there (``read_metrics``).
    """
    def flush(batch: DataFrame, batch_id: int) -> None:
        batch = prepare(ing.mark_poison(batch, target)).persist()
        try:
            spark, run = batch.sparkSession, run_of(batch.sparkSession, checkpoint)
            rows, poisoned, refused = batch.agg(F.count(F.lit(1)), F.count_if("_broken"), F.count("_poison")).first()
            good, bad = ing.split_poison(batch, target, service=service)
            if refused:
                # few files: the log's consumers read them again, and bound their batches by files
                log.publish(log.to_dlq_records(bad).hint("rebalance"), dlq, run, batch_id)
            some = rows > refused  # a batch without a row to store leaves the sink alone
            if metrics is None:
                if some:
                    store(good)
                return
            before = paths.total(spark, path)
            written = store(good) if some else 0
            files, size = (now - then for now, then in zip(paths.total(spark, path), before))
            spark.createDataFrame([(name, run, batch_id, rows, poisoned, written, files, size)], METRICS).withColumn(
                "at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(metrics)
        finally:
            batch.unpersist()

    return _for_each(_observed(events, name), flush, checkpoint, name, seconds)


METRICS = "job string, run string, batch long, rows long, poisoned long, written long, files long, bytes long"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per job and batch: rows read, poisoned and written, new files and their bytes.

    ``written`` counts archive rows, changed vessels or track points, by job. Of a batch that was replayed the greatest figures
    count: what it had stored already is not written again.
    """
    rows = spark.read.schema(METRICS + ", at timestamp").parquet(path)
    most = [F.max(c).alias(c) for c in ("rows", "poisoned", "written", "files", "bytes")]
    return rows.groupBy("job", "run", "batch").agg(*most, F.max("at").alias("at"))


def _observed(events: DataFrame, name: str) -> DataFrame:
    """Counts rows and poisoned rows into the query's progress."""
    return events.observe(name, F.count("*").alias("rows"),
                          F.count_if(F.size("_bad") > 0).alias("poisoned"))


def _for_each(events: DataFrame, flush, checkpoint: str, name: str,
              seconds: float | None, mode: str = "append") -> StreamingQuery:
    return (events.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode(mode)
            .trigger(**_trigger(seconds)).foreachBatch(flush).start())


def _arrival(events: DataFrame) -> tuple[str, ...]:
    """Kafka's own order where there is one, else arrival time and id."""
    return ("offset",) if "offset" in events.columns else st.ARRIVAL


def start_state(events: DataFrame, path: str, checkpoint: str, dlq: str | dict,
                seconds: float | None = STATE_FLUSH_SECONDS, order: str = "arrival",
                name: str = "state", metrics: str | None = None) -> StreamingQuery:
    """Latest state per vessel: each batch is reduced to its last row per vessel, and these are appended. What is
    written grows with the batch, not with the table; a batch stored twice changes nothing.

    A vessel's records share one Kafka partition, so the offset orders them.
    """
    arrival = _arrival(events)

    def prepare(marked: DataFrame) -> DataFrame:
        return marked.select(*sorted({*st.EVENT_COLUMNS, *arrival}), *MARKS)

    def store(good: DataFrame) -> int:
        return tables.append_state(st.current_state(good, None, order, arrival, with_arrival=True), path, order)

    return _start_sink(events, "state", prepare, store, path, checkpoint, dlq, name, seconds, metrics)


def start_track(events: DataFrame, path: str, checkpoint: str, dlq: str | dict,
                seconds: float | None = STATE_FLUSH_SECONDS, name: str = "track",
                metrics: str | None = None) -> StreamingQuery:
    """Track rows, first (vessel, event id) wins.

    Keys are looked up in the batch's own event hours: an event id digests the whole frame, time
    and arrival included, so the same id means the same hour.
    """
    arrival = _arrival(events)

    def prepare(marked: DataFrame) -> DataFrame:
        columns = {*tr.KEY, "latitude", "longitude", "sog_knots", "_at", *arrival}
        return st.timed(marked).select(*sorted(columns), *MARKS)

    def store(good: DataFrame) -> int:
        rows = st.build_track_rows(good, arrival=arrival)
        stored = archive.within(tables.read_track(good.sparkSession, path), rows, ["partition_hour"])
        return tables.append_track_rows(tr.append_small_batch(stored, rows), path)

    return _start_sink(events, "state", prepare, store, path, checkpoint, dlq, name, seconds, metrics, ing.TRACK_SERVICE)


# ---- Stateful streams over the decoded log ---------------------------------------------------

def stale_transitions(events: DataFrame, minutes: int = FRESH_MINUTES, delay: str = SILENCE_DELAY) -> DataFrame:
    """The moments at which vessels fell silent: (mmsi, silent_since, stale_at, reports).

    A vessel's reports with at most ``minutes`` between their arrivals are one session; the session that the watermark has
    passed is a vessel that went STALE at its end. A later report begins another one. ``delay`` is how far arrivals may be out of
    order in the log. State is a row per open session. Reports without position, vessel or arrival are left out.
    """
    arrived = (st.placed(events).select("mmsi", F.timestamp_seconds("ingested_at").alias("arrived")).where("arrived is not null")
               .withWatermark("arrived", delay))
    sessions = arrived.groupBy("mmsi", F.session_window("arrived", f"{int(minutes)} minutes").alias("open")).agg(
        F.max("arrived").alias("silent_since"), F.count(F.lit(1)).alias("reports"))
    return sessions.select("mmsi", "silent_since", F.col("open.end").alias("stale_at"), "reports")


def start_stale(events: DataFrame, path: str, checkpoint: str, seconds: float | None = STALE_SECONDS,
                minutes: int = FRESH_MINUTES, delay: str = SILENCE_DELAY, name: str = "stale") -> StreamingQuery:
    """STALE transitions, each written once, to a folder of Parquet files."""
    return (stale_transitions(events, minutes, delay).writeStream.queryName(name).format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(**_trigger(seconds)).start())


def start_hourly(events: DataFrame, path: str, checkpoint: str, seconds: float | None = STATE_FLUSH_SECONDS,
                 name: str = "hourly") -> StreamingQuery:
    """Running counts of positions per event hour, as the log delivers them, late ones included.

    State is one counter per hour. Each batch appends the new totals of the hours it changed, so a replayed batch appends the
    same again and nothing is counted twice; ``read_hourly`` takes the greatest.
    """
    placed = st.build_track_rows(events).groupBy(F.window("event_time", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("events"))

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("hour.start").alias("partition_hour"), "events").hint("rebalance").write.mode("append").parquet(path)

    return _for_each(placed, flush, checkpoint, name, seconds, "update")


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Positions per event hour. One checkpoint per folder."""
    rows = spark.read.schema("partition_hour timestamp, events long").parquet(path)
    return rows.groupBy("partition_hour").agg(F.max("events").alias("events"))


# ---- The latest state as a stateful stream, for sinks that take updates --------------------

def latest_state_stream(events: DataFrame) -> DataFrame:
    """Latest state by arrival for ``outputMode("update")``."""
    rows = st.build_state_rows(events, arrival=_arrival(events))
    last = rows.groupBy("mmsi").agg(F.max_by(F.struct(*STATE_SCHEMA.names), "_arrival").alias("_r"))
    return last.select("_r.*")


def batch_metrics(query: StreamingQuery) -> list[dict]:
    """Per finished batch: its id, input rows and the observed counters."""
    out = []
    for progress in query.recentProgress:
        row = {"batch": progress.batchId, "input_rows": progress.numInputRows}
        for values in progress.observedMetrics.values():
            row.update(values.asDict())
        out.append(row)
    return out


def run_to_end(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an ``availableNow`` query; without a limit unless the caller sets one."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {query.name} did not finish in {timeout_s} s")
    return query


def consume(spark: SparkSession, source: str | dict, max_files: int | None = None,
            max_bytes: int | None = log.BATCH_BYTES) -> DataFrame:
    """The log as a stream of decoded events, from the earliest record on, in bounded batches."""
    return log.read_log(spark, source, streaming=True, max_files=max_files, max_bytes=max_bytes)
