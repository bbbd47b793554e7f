import json
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.helpers import ARRIVED, T0, feed_time, frame, meta, minutes, position
from tidewake.operators import ingest as ing
from tidewake.operators import retention
from tidewake.operators import state as st
from tidewake.operators import track as tr
from tidewake.schemas import EVENT_SCHEMA, RECORD_SCHEMA
from tidewake.sources import archive as ar
from tidewake.sources import frames as fs
from tidewake.sources import log, tables
from tidewake.streaming import jobs


def write_frames(folder, name, numbers):
    """One report per number: minute n of vessel n % 5; every ninth is invalid, one line is junk."""
    folder.mkdir(exist_ok=True)
    lines = ["junk"]
    for n in numbers:
        f = frame(about=meta(str(200000000 + n % 5), at=feed_time(T0 + minutes(n))),
                  report=position(sog=-1 if n % 9 == 0 else float(n)))
        lines.append(json.dumps({**f, "_received_at": ARRIVED + 60 * n + 2}))
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def pipeline(spark, tmp_path):
    """Frames in two files, ingested one file per trigger."""
    write_frames(tmp_path / "frames", "a.jsonl", range(1, 30))
    write_frames(tmp_path / "frames", "b.jsonl", range(30, 60))
    frames = fs.read_frames(spark, str(tmp_path / "frames"), streaming=True, max_files=1)
    query = jobs.run_to_end(jobs.start_ingest(frames, str(tmp_path / "log"), str(tmp_path / "ck")))
    batch = ing.published(ing.ingest(fs.read_frames(spark, str(tmp_path / "frames"))))
    return tmp_path, query, batch


def test_ingest_stream_equals_batch(spark, pipeline):
    home, query, batch = pipeline
    events = log.read_log(spark, str(home / "log"))
    assert sorted(map(str, events.select(*EVENT_SCHEMA.names).collect())) == sorted(map(str, batch.collect()))
    dlq = log.read_dlq(spark, str(home / "log")).collect()
    assert len(dlq) == 6 and {r["_dlq_reason"] for r in dlq} == {"validation_failed"}
    totals = [m for m in jobs.batch_metrics(query) if m.get("frames")]
    assert sum(m["frames"] for m in totals) == 59 and sum(m["quarantined"] for m in totals) == 6
    # More frames, same checkpoint: only the new file is read.
    write_frames(home / "frames", "c.jsonl", range(60, 64))
    frames = fs.read_frames(spark, str(home / "frames"), streaming=True)
    jobs.run_to_end(jobs.start_ingest(frames, str(home / "log"), str(home / "ck")))
    assert log.read_log(spark, str(home / "log")).count() == 53 + 3


def test_state_stream_equals_batch(spark, pipeline):
    home, _, batch = pipeline
    events = jobs.consume(spark, str(home / "log"), max_files=1)
    jobs.run_to_end(jobs.start_state(events, str(home / "state"), str(home / "ck-s"), str(home / "dlq"), seconds=None))
    cols = ["mmsi", "sog_knots", "status", "last_seen_at"]
    got = tables.read_state(spark, str(home / "state")).select(*cols)
    assert sorted(got.collect()) == sorted(st.current_state(batch, T0).select(*cols).collect())


def test_track_stream_equals_batch_and_survives_replay(spark, pipeline):
    home, _, batch = pipeline
    for attempt in ("ck-t", "ck-again"):  # a lost checkpoint replays the whole log
        events = jobs.consume(spark, str(home / "log"), max_files=1)
        jobs.run_to_end(jobs.start_track(events, str(home / "track"), str(home / attempt), str(home / "dlq"), seconds=None))
        got = tables.read_track(spark, str(home / "track"))
        want = tr.dedup_track(st.build_track_rows(batch, T0))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_archive_stream_equals_batch_and_survives_replay(spark, pipeline):
    home, _, batch = pipeline
    for attempt, files in (("ck-a", 1), ("ck-again", 10), ("ck-more", 2)):  # other batch borders
        events = jobs.consume(spark, str(home / "log"), max_files=files)
        jobs.run_to_end(jobs.start_archive(events, str(home / "archive"), str(home / attempt), str(home / "dlq"), seconds=None))
        got = ar.read_archive(spark, str(home / "archive"))
        assert sorted(map(str, got.collect())) == sorted(map(str, ar.archive_rows(batch).collect()))


CONSUMERS = ((jobs.start_state, "state"), (jobs.start_archive, "archive"), (jobs.start_track, "track"))


def test_poison_goes_to_quarantine_and_the_rest_proceeds(spark, pipeline):
    home, _, batch = pipeline
    path = str(home / "log2")
    good = [r["_value"] for r in log.read_log(spark, str(home / "log")).limit(3).collect()]
    bad = json.loads(good[0])
    values = good + [json.dumps({**bad, "event_id": None}), json.dumps({**bad, "nav_status": "x"}), None]
    log.write_records(spark.createDataFrame([("k", v, "ais.raw") for v in values], RECORD_SCHEMA), path)
    for start, name in CONSUMERS:
        events = jobs.consume(spark, path)
        query = jobs.run_to_end(start(events, str(home / ("p" + name)), str(home / ("ck" + name)), path, seconds=None))
        assert sum(m.get("poisoned") or 0 for m in jobs.batch_metrics(query)) == 1
    told = sorted((r["_dlq_source"], r["_dlq_reason"]) for r in log.read_dlq(spark, path).collect())
    assert told == [("raw_sink", "parquet_serialization_failed"), *[("stream_processor", "db_insert_failed")] * 2,
                    *[("track_writer", "db_insert_failed")] * 2]
    assert ar.read_archive(spark, str(home / "parchive")).count() == 4
    assert tables.read_track(spark, str(home / "ptrack")).count() == 3


def test_batches_are_bounded(spark, pipeline):
    home, _, _ = pipeline
    files = sum(1 for p in (home / "log").rglob("topic=ais.raw/**/*.parquet"))
    for max_files, max_bytes, least in ((1, None, files), (None, 1, files)):
        events = jobs.consume(spark, str(home / "log"), max_files, max_bytes)
        ck = str(home / f"ck-{max_files}-{max_bytes}")
        query = jobs.run_to_end(jobs.start_state(events, str(home / ck), ck, str(home / "dlq"), seconds=None))
        assert len([m for m in jobs.batch_metrics(query) if m["input_rows"]]) >= least > 1


def test_batches_without_a_row_to_store_leave_the_sink_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log.write_records(spark.createDataFrame([(None, "{}", log.DLQ_TOPIC)], RECORD_SCHEMA), path)
    monkeypatch.setattr(tables, "read_track", lambda *_: pytest.fail("the track was read"))
    query = jobs.run_to_end(jobs.start_track(jobs.consume(spark, path), str(tmp_path / "t"), str(tmp_path / "ck"), path,
                                             seconds=None, metrics=str(tmp_path / "m")))
    assert query.exception() is None
    row = jobs.read_metrics(spark, str(tmp_path / "m")).first()
    assert (row.rows, row.poisoned, row.written, row.files) == (0, 0, 0, 0)


def test_cached_batches_keep_the_text_of_refused_rows_only(spark, tmp_path):
    records = spark.createDataFrame([("k", '{"event_id":"a","latitude":1.0}', log.RAW_TOPIC), ("k", '{"latitude":"x"}', log.RAW_TOPIC)],
                                    RECORD_SCHEMA)
    marked = ing.mark_poison(log.decode_events(records), "archive")
    assert [(r._poison, r._broken, r._value) for r in marked.collect()] == [
        (None, False, None), ("parquet_serialization_failed", True, '{"latitude":"x"}')]
    good, bad = ing.split_poison(marked, "archive")
    assert [r.event_id for r in good.collect()] == ["a"] and [r.event for r in bad.collect()] == ['{"latitude":"x"}']
    assert good.columns == EVENT_SCHEMA.names


def test_files_of_the_log_split_into_row_groups(spark, tmp_path):
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f" {n}")), 512) for n in range(8)])
    rows = spark.range(50000, numPartitions=1).select(F.lit("k").alias("key"), text.alias("value"), F.lit("ais.raw").alias("topic"))
    log.write_records(rows, str(tmp_path / "log"))
    (file,) = (tmp_path / "log").rglob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1


def test_state_goes_on_after_clean_up_and_new_checkpoint(spark, pipeline):
    home, _, batch = pipeline
    path, log_path = str(home / "state"), str(home / "log")

    def consume(checkpoint):
        events = jobs.consume(spark, log_path, max_files=1)
        jobs.run_to_end(jobs.start_state(events, path, str(home / checkpoint), log_path, seconds=None))

    consume("ck-1")
    retention.run_retention(spark, path, str(home / "track"), T0 + minutes(60))
    write_frames(home / "frames", "d.jsonl", [100])
    (home / "frames" / "d.jsonl").write_text((home / "frames" / "d.jsonl").read_text().replace("200000000", "299999999"))
    frames = fs.read_frames(spark, str(home / "frames"), streaming=True)
    jobs.run_to_end(jobs.start_ingest(frames, log_path, str(home / "ck")))
    consume("ck-2")
    got = {r.mmsi: r.sog_knots for r in tables.read_state(spark, path).collect()}
    want = {r.mmsi: r.sog_knots for r in st.current_state(batch, T0).collect()}
    assert got == {**want, "299999999": 100.0}


def memory(query_df, name, mode, checkpoint):
    q = (query_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    jobs.run_to_end(q)


def test_stateful_variant(spark, pipeline):
    home, _, batch = pipeline
    events = jobs.consume(spark, str(home / "log"))
    memory(jobs.latest_state_stream(events), "latest_state_mem", "complete", str(home / "m1"))
    got = spark.table("latest_state_mem").select("mmsi", "sog_knots")
    assert sorted(got.collect()) == sorted(st.current_state(batch, T0).select("mmsi", "sog_knots").collect())


def test_options():
    assert jobs.kafka_archive_options() == {
        "minOffsetsPerTrigger": "1000", "maxTriggerDelay": "900s", "maxOffsetsPerTrigger": "500000"}
    assert jobs.kafka_state_options()["minOffsetsPerTrigger"] == "500"
