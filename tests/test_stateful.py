"""Stateful streams over the log, batch counters, archive look-ups and compaction, rules as SQL functions."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import ARRIVED, T0, event, events_df, feed_time, minutes, state_df, vessel
from tidewake.functions import geo, sql, times
from tidewake.functions import vessel as vs
from tidewake.operators import state as st
from tidewake.operators import track as tr
from tidewake.schemas import RECORD_SCHEMA
from tidewake.sources import archive as ar
from tidewake.sources import log, tables
from tidewake.streaming import jobs


def put(spark, path, rows):
    log.write_records(log.to_log_records(events_df(spark, rows)), path)


def sessions(arrivals, gap, upto):
    """(vessel, last arrival, number) of every run of reports that ended more than ``gap`` seconds before ``upto``."""
    out = []
    for name, times_ in arrivals.items():
        run = []
        for at in sorted(times_):
            if run and at - run[-1] > gap:
                out.append((name, run[-1], len(run)))
                run = []
            run.append(at)
        out.append((name, run[-1], len(run)))
    return sorted(x for x in out if x[1] + gap <= upto)


def test_silence_is_told_once_across_restarts(spark, tmp_path):
    rng = random.Random(6)
    names = [str(200000000 + i) for i in range(5)]
    at = {n: [] for n in names}
    log_path, sink = str(tmp_path / "log"), str(tmp_path / "stale")
    for part in range(3):  # a session may go on in the next part, under the same checkpoint
        rows = []
        for n in names:
            for _ in range(rng.randrange(1, 5)):
                second = part * 10_000 + rng.randrange(10_000)
                at[n].append(ARRIVED + second)
                rows.append(event(mmsi=n, event_id=f"{n}-{part}-{len(rows)}", ingested_at=ARRIVED + second))
        rng.shuffle(rows)
        put(spark, log_path, rows + [event(mmsi="silent", ingested_at=None), event(latitude=None, ingested_at=ARRIVED)])
        jobs.run_to_end(jobs.start_stale(jobs.consume(spark, log_path), sink, str(tmp_path / "ck"), None, delay="10000 seconds"))
    got = sorted((r.mmsi, r.s, r.reports) for r in spark.read.parquet(sink).select(
        "mmsi", F.unix_timestamp("silent_since").cast("double").alias("s"), "reports").collect())
    latest = max(x for v in at.values() for x in v)
    assert got == sessions(at, 2700, latest - 10_000) and got
    assert all(r.stale_at == r.silent_since + minutes(45) for r in spark.read.parquet(sink).collect())


def test_a_gap_of_exactly_the_limit_is_no_silence(spark, tmp_path):
    log_path, sink = str(tmp_path / "log"), str(tmp_path / "stale")
    far = event(mmsi="200000009", event_id="z", ingested_at=ARRIVED + 90_000)
    put(spark, log_path, [event(event_id="a"), event(event_id="b", ingested_at=ARRIVED + 2700),
                          event(mmsi="200000002", event_id="c"), event(mmsi="200000002", event_id="d", ingested_at=ARRIVED + 2701), far])
    jobs.run_to_end(jobs.start_stale(jobs.consume(spark, log_path), sink, str(tmp_path / "ck"), None))
    got = sorted((r.mmsi, r.reports) for r in spark.read.parquet(sink).collect())
    assert got == [("200000001", 2), ("200000002", 1), ("200000002", 1)]


def test_hourly_counts_under_restart_and_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [event(event_id=str(i), event_time=feed_time(T0 + minutes(rng.randrange(600)))) for i in range(90)]
    log_path, sink, ck = (str(tmp_path / n) for n in ("log", "hourly", "ck"))
    for first in (60, 0, 30):  # the oldest part arrives in the middle
        put(spark, log_path, rows[first:first + 30])
        jobs.run_to_end(jobs.start_hourly(jobs.consume(spark, log_path, max_files=1), sink, ck, None))
    want = tr.hourly_counts(tr.dedup_track(st.build_track_rows(events_df(spark, rows))))
    assert sorted(jobs.read_hourly(spark, sink).collect()) == sorted(want.collect())
    # a replayed batch appends what it appended before
    again = spark.read.parquet(sink)
    again.write.mode("append").parquet(sink + "2")
    again.write.mode("append").parquet(sink + "2")
    assert sorted(jobs.read_hourly(spark, sink + "2").collect()) == sorted(want.collect())


def test_counters_of_every_batch(spark, tmp_path):
    log_path, metrics = str(tmp_path / "log"), str(tmp_path / "metrics")
    put(spark, log_path, [event(event_id=str(i), mmsi=str(200000000 + i % 3)) for i in range(12)])
    log.write_records(spark.createDataFrame([("k", "{oops", "ais.raw")], RECORD_SCHEMA), log_path)
    for attempt in ("one", "two"):
        for start, name in ((jobs.start_state, "state"), (jobs.start_archive, "archive"), (jobs.start_track, "track")):
            jobs.run_to_end(start(jobs.consume(spark, log_path), str(tmp_path / name), str(tmp_path / f"ck-{name}-{attempt}"),
                                  str(tmp_path / "dlq"), seconds=None, metrics=metrics))
    rows = jobs.read_metrics(spark, metrics).orderBy("at").collect()
    first, second = {}, {}
    for r in rows:
        (second if r.job in first else first)[r.job] = r
    assert {j: (r["rows"], r.poisoned, r.written) for j, r in first.items()} == {
        "state": (13, 1, 3), "archive": (13, 1, 12), "track": (13, 1, 12)}
    assert all(r.files > 0 and r.bytes > 0 for r in first.values())
    assert {j: r.written for j, r in second.items()} == {"state": 3, "archive": 0, "track": 0}


def test_touched_hours_only_are_read(spark, tmp_path):
    path = str(tmp_path / "a")
    far = [event(event_id=f"e{d}", event_time=feed_time(T0 + timedelta(days=d))) for d in range(10)]
    assert ar.write_archive(events_df(spark, far), path) == 10
    hours = ar.archive_rows(events_df(spark, [far[0], far[9]]))
    for most in (2000, 1):  # listed by name, or joined
        got = ar.within(ar.read_archive(spark, path), hours, ["dt", "HH"], most)
        assert sorted(r.event_id for r in got.collect()) == ["e0", "e9"]
    plan = ar.within(ar.read_archive(spark, path), hours, ["dt", "HH"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws(/, dt" in plan
    assert ar.write_archive(events_df(spark, [far[0], far[9], event(event_id="new")]), path) == 1


def test_an_event_without_time_and_arrival_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [event(event_id="t", event_time="garbage", ingested_at=None), event(event_id=None, event_time=None, ingested_at=0.0)]
    assert ar.write_archive(events_df(spark, rows), path, F.lit(T0)) == 2
    assert ar.write_archive(events_df(spark, rows), path, F.lit(T0 + timedelta(hours=5))) == 0
    assert ar.write_archive(events_df(spark, []), path) == 0


def rows_read(df):
    """How many rows the scan of a query without shuffles hands on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_bloom_filters_keep_row_groups_closed(spark, tmp_path):
    """A key within the statistics of a file, but not in it, opens no row group of it."""
    events = events_df(spark, [event(event_id=str(i), mmsi=str(200000000 + 2 * i)) for i in range(500)])
    plain = {"parquet.enable.dictionary": "false"}
    for name, options in (("with", {**plain, **ar.bloom("event_id")}), ("without", plain)):
        events.coalesce(1).write.options(**options).parquet(str(tmp_path / name))
    missing = {n: rows_read(spark.read.parquet(str(tmp_path / n)).where("event_id = '250x'").select("raw")) for n in ("with", "without")}
    assert missing == {"with": 0, "without": 500}
    assert spark.read.parquet(str(tmp_path / "with")).where("event_id = '250'").count() == 1
    # the sinks write them: far fewer bytes without
    path, track = str(tmp_path / "a"), str(tmp_path / "t")
    ar.write_archive(events, path)
    tables.append_track_rows(st.build_track_rows(events), track)
    for folder, column, key in ((path, "event_id", "250x"), (track, "mmsi", "200000251")):
        assert rows_read(spark.read.parquet(folder).where(F.col(column) == key).select("latitude")) == 0


def test_compaction_keeps_rows_and_leaves_open_hours_alone(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [event(event_id=str(i), mmsi=str(200000000 + i % 7), event_time=feed_time(T0 + minutes(i * 10))) for i in range(72)]
    for part in range(4):
        ar.write_archive(events_df(spark, rows[part::4]), path)
    before = sorted(map(str, ar.read_archive(spark, path).collect()))

    def files():
        return {(r.dt, r.HH): r.n for r in ar.read_archive(spark, path, files=True).groupBy("dt", "HH").agg(
            F.count_distinct("file").alias("n")).collect()}

    old = files()
    as_of = T0 + minutes(720)
    hours = ar.compact_archive(spark, path, as_of, dry_run=True)
    assert files() == old and all(n > 1 for n in old.values())
    assert ar.compact_archive(spark, path, as_of) == hours and 0 < len(hours) < len(old)
    new = files()
    assert all(new[h] == 1 for h in hours) and all(new[h] == old[h] for h in old if h not in hours)
    assert sorted(map(str, ar.read_archive(spark, path).collect())) == before
    assert ar.compact_archive(spark, path, as_of) == []
    assert ar.write_archive(events_df(spark, rows), path) == 0  # ids are still known
    # files of a given size: no more than it takes
    later = as_of + timedelta(days=1)
    half = max(size for _, size in ar._closed(spark, path, later).values()) // 2 + 1
    assert set(ar.compact_archive(spark, path, later, half)) == old.keys() - set(hours) and max(files().values()) <= 2
    assert sorted(map(str, ar.read_archive(spark, path).collect())) == before


@pytest.fixture
def functions(spark):
    rows = [vessel(str(200000000 + i), lat=1.0 + i / 500, lon=103.0 + i / 700, name=f"N{i}") for i in range(40)]
    state_df(spark, rows).createOrReplaceTempView("fleet_view")
    events = [event(event_id=str(i), event_time=feed_time(T0 + minutes(i * 10))) for i in range(90)]
    st.build_track_rows(events_df(spark, events)).createOrReplaceTempView("track_view")
    return sql.register(spark, "fleet_view", "track_view")


def test_sql_functions_equal_the_columns(spark, functions):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(16)]), rng.choice([None, 0.0, 3.5]), rng.choice([None, -128.0, -127.0, -3.0, 0.0, 20.0, 127.0]),
             rng.choice([None, 0.0, 11.25, 33.75, 359.9]), rng.choice([None, "200000001", "12"]),
             rng.choice([None, "garbage", feed_time(T0), "2025-03-04T09:00:07Z"]), ARRIVED + rng.choice([-90.0, 0.0, 30000.0])) for _ in range(60)]
    df = spark.createDataFrame(rows, "nav_status int, sog_knots double, rate_of_turn double, cog double, mmsi string, event_time string, ingested_at double")
    df.createOrReplaceTempView("samples")
    got = spark.sql("""SELECT vessel_status(nav_status, sog_knots) a, decode_turn(rate_of_turn) b, nav_label(nav_status) c,
        compass_point(cog) d, valid_mmsi(mmsi) e, event_instant(event_time) f, skew_reason(event_instant(event_time), ingested_at) g,
        vessel_heading(cog) h, vessel_turn_rate(rate_of_turn) i, conflict_severity(cog) j,
        distance_metres(1D, 103D, 1D + cog / 1000, 103.2D) k FROM samples""")
    instant = times.parse_event_time("event_time")
    want = df.select(vs.derive_status(), vs.decode_rot(), vs.nav_label(), vs.compass_label(vs.compass_sector("cog")), vs.valid_mmsi(),
                     instant, times.classify_skew(instant, "ingested_at"), vs.heading("cog"), vs.rate_of_turn("rate_of_turn"),
                     vs.severity("cog"), geo.geodesic_m(F.lit(1.0), F.lit(103.0), F.lit(1.0) + F.col("cog") / 1000, F.lit(103.2)))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_table_functions_equal_the_endpoints(spark, functions):
    from tidewake.operators import proximity as px

    assert {"vessels_nearby", "vessel_track"} <= set(functions)
    got = spark.sql("SELECT * FROM vessels_nearby(1.02D, 103.01D, 3000D)").collect()
    want = px.nearby(spark.table("fleet_view"), 1.02, 103.01, 3000.0).collect()
    assert [r.mmsi for r in got] == [r.mmsi for r in want] and len(got) > 5
    assert [r.distance_m for r in got] == pytest.approx([r.distance_m for r in want], abs=1e-9)
    as_of = T0 + minutes(890)
    got = spark.sql(f"SELECT * FROM vessel_track('200000001', TIMESTAMP '{as_of:%Y-%m-%d %H:%M:%S}', 3)").collect()
    assert got == tr.vessel_track(spark.table("track_view"), "200000001", as_of, 3).collect() and len(got) == 18
