import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import ARRIVED, T0, event, events_df, feed_time, minutes, state_df, utc, vessel
from tidewake.operators import quality as ql
from tidewake.operators import retention
from tidewake.operators import state as st
from tidewake.schemas import ARCHIVE_SCHEMA
from tidewake.sources import archive as ar
from tidewake.sources import paths, tables


def reports(n, step_minutes=10, delay=2.0):
    return [event(event_id=f"e{i}", event_time=feed_time(T0 + minutes(i * step_minutes)),
                  ingested_at=ARRIVED + i * step_minutes * 60 + delay + i / 8) for i in range(n)]


def test_rows_are_coerced(spark):
    df = ar.archive_rows(events_df(spark, [event(position_accuracy=None, raim=None, schema_version=None, mmsi=None)]))
    row = df.first()
    assert (row.position_accuracy, row.raim, row.schema_version, row.mmsi) == (False, False, "1.0", "None")
    assert (row.dt, row.HH) == ("2025-03-04", "09") and df.schema == ARCHIVE_SCHEMA or df.columns == ARCHIVE_SCHEMA.names


def test_layout_and_replay(spark, tmp_path):
    """Two writes for one hour add up; events known already, in whatever batches, are not stored again."""
    path = str(tmp_path / "a")
    rows = reports(20)
    for some in (rows[:2], rows[2:3], rows[:5], rows, rows[10:]):
        ar.write_archive(events_df(spark, some), path)
    assert paths.folders(spark, path) == ["dt=2025-03-04"]
    assert paths.folders(spark, path + "/dt=2025-03-04") == ["HH=09", "HH=10", "HH=11", "HH=12"]
    back = ar.read_archive(spark, path, files=True)
    assert sorted(r.event_id for r in back.collect()) == sorted(f"e{i}" for i in range(20))
    assert [f.dataType.simpleString() for f in back.schema if f.name in ("dt", "HH")] == ["string", "string"]


def test_events_without_id_are_known_by_content(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [event(event_id=None, sog_knots=float(i)) for i in (1, 2, 2)]
    ar.write_archive(events_df(spark, rows[:1]), path)
    ar.write_archive(events_df(spark, rows), path)
    ar.write_archive(events_df(spark, [*rows, event(event_id="e9")]), path)
    assert sorted(str(r.event_id) + str(r.sog_knots) for r in ar.read_archive(spark, path).collect()) == [
        "None1.0", "None2.0", "e95.0"]
    ar.write_archive(events_df(spark, []), path)
    assert ar.read_archive(spark, path).count() == 3


def test_window_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "a")
    ar.write_archive(events_df(spark, reports(200)), path)
    df = ar.read_archive(spark, path, T0 + timedelta(hours=34), 4).select("latitude")
    plan = df._jdf.queryExecution().executedPlan().toString()
    parts = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "dt" in parts and "HH" in parts and "ReadSchema: struct<latitude:double>" in plan
    assert df.count() == 200 - 30 * 6


def brute_quality(rows, cutoff):
    out = dict(events=0, position=0, invalid=0, sog=0, cog=0, negative=0)
    deltas = []
    for r in rows:
        if r["ingested_at"] is None or r["ingested_at"] < cutoff:
            continue
        out["events"] += 1
        if r["latitude"] is None or r["longitude"] is None:
            out["position"] += 1
        elif abs(r["latitude"]) > 90 or abs(r["longitude"]) > 180:
            out["invalid"] += 1
        out["sog"] += r["sog_knots"] is None
        out["cog"] += r["cog_degrees"] is None
        if r["at"] is not None:
            delta = r["ingested_at"] - (r["at"] - utc("1970-01-01")) / timedelta(seconds=1)
            if delta < 0:
                out["negative"] += 1
            else:
                deltas.append(delta)
    return out, sorted(deltas)


@pytest.mark.parametrize("n", [0, 1, 2, 157])
def test_quality_report_equals_a_loop(spark, tmp_path, n):
    rng = random.Random(n)
    rows, raw = [], []
    for i in range(n):
        at = T0 + minutes(rng.randrange(0, 600))
        r = {"ingested_at": ARRIVED + (at - T0).total_seconds() + rng.choice([-1, 0, 3.5, rng.uniform(0, 60)]),
             "latitude": rng.choice([1.0, None, 91.0, -90.0]), "longitude": rng.choice([2.0, None, -180.5]),
             "sog_knots": rng.choice([1.0, None]), "cog_degrees": rng.choice([1.0, None])}
        known = rng.random() > 0.1
        rows.append(event(event_id=str(i), event_time=feed_time(at) if known else "?", **r))
        raw.append({**r, "at": at.replace(tzinfo=utc("2026-01-01").tzinfo) if known else None})
    path = str(tmp_path / "a")
    ar.write_archive(events_df(spark, rows), path)
    as_of, hours = T0 + minutes(600), 5
    archive = ar.read_archive(spark, path, files=True) if n else ar.archive_rows(events_df(spark, [])).withColumn("file", F.lit(""))
    got = ql.data_quality(archive, as_of, hours).first()
    want, deltas = brute_quality(raw, ARRIVED + 5 * 3600)
    assert (got.events_processed, got.missing_position, got.invalid_coordinates, got.missing_sog, got.missing_cog) == (
        want["events"], want["position"], want["invalid"], want["sog"], want["cog"])
    lat = got.latency
    assert lat.events_negative_latency == want["negative"]
    if deltas:
        assert lat.avg_s == pytest.approx(sum(deltas) / len(deltas), abs=0.051)
        assert (lat.p50_s, lat.p95_s, lat.max_s) == (
            deltas[len(deltas) // 2], deltas[int(len(deltas) * 0.95)], deltas[-1])
    else:
        assert (lat.avg_s, lat.p50_s, lat.p95_s, lat.max_s) == (None, None, None, None)
    same = ql.latency_stats(archive, as_of, hours).first()
    assert (same.p50_s, same.p95_s, same.avg_s) == (lat.p50_s, lat.p95_s, lat.avg_s)
    assert ql.missing_motion(ql.data_quality(archive, as_of, hours)).first()[0] == want["sog"] + want["cog"]


def test_files_are_counted_before_rows_are_compared(spark, tmp_path):
    path = str(tmp_path / "a")
    ar.write_archive(events_df(spark, reports(12, 10, delay=-1e6)), path)
    got = ql.data_quality(ar.read_archive(spark, path, files=True), T0 + minutes(120), 24).first()
    assert (got.events_processed, got.parquet_files) == (0, 2)


def test_quality_bounds(spark):
    df = ar.archive_rows(events_df(spark, reports(1)))
    for hours in (0, 169):
        with pytest.raises(ValueError):
            ql.data_quality(df, T0, hours)


def test_archive_expiry(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [event(event_id=str(d), event_time=feed_time(T0 - timedelta(days=d))) for d in range(12)]
    ar.write_archive(events_df(spark, rows), path)
    as_of = T0.replace(hour=0)
    want = [f"dt={(T0 - timedelta(days=d)).date()}" for d in range(11, 7, -1)]
    assert ar.expire_archive(spark, path, as_of, dry_run=True) == want
    assert ar.read_archive(spark, path).count() == 12
    assert ar.expire_archive(spark, path, as_of) == want
    assert ar.read_archive(spark, path).count() == 8
    assert ar.expire_archive(spark, path, as_of) == []


def stored(spark, home):
    state, track = f"{home}/state", f"{home}/track"
    vessels = [vessel("a", seen=T0), vessel("b", seen=T0 - minutes(50)), vessel("c", seen=T0 - minutes(60 * 30)),
               vessel("d", seen=T0 - minutes(50), status="STALE")]
    tables.append_state(state_df(spark, vessels), state)
    rows = [event(event_id=str(i), event_time=feed_time(T0 - minutes(20 * i))) for i in range(90)]
    tables.append_track_rows(st.build_track_rows(events_df(spark, rows), T0), track)
    return state, track


def test_retention_cycle(spark, tmp_path):
    state, track = stored(spark, tmp_path)
    dry = retention.run_retention(spark, state, track, T0 + minutes(5), purge_hours=24, dry_run=True)
    assert dry == {"dry_run": True, "track_aging_count": 90 - 72, "stale_candidates": 3, "stale_purge_candidates": 1}
    assert tables.read_track(spark, track).count() == 90
    done = retention.run_retention(spark, state, track, utc("2025-03-04T09:05:00"), purge_hours=24)
    assert done == {"dry_run": False, "track_deleted": 18, "stale_marked": 2, "stale_purged": 1}
    assert {r.mmsi: r.status for r in tables.read_state(spark, state).collect()} == {
        "a": "UNDERWAY", "b": "STALE", "d": "STALE"}
    left = [r.event_time for r in tables.read_track(spark, track).collect()]
    assert len(left) == 72 and min(left) == T0 - minutes(20 * 71)
    again = retention.run_retention(spark, state, track, T0 + minutes(5))
    assert again == {"dry_run": False, "track_deleted": 0, "stale_marked": 0}


def arrived(spark, number, *rows):
    """States that arrived one after the other, from ``number`` on."""
    df = state_df(spark, rows)
    place = {r[0]: number + i for i, r in enumerate(rows)}
    at = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("mmsi")].cast("double")
    return df.withColumn("_arrival", F.struct(at.alias("ingested_at"), F.col("mmsi").alias("event_id")))


def speeds(spark, path):
    return {r.mmsi: r.sog_knots for r in tables.read_state(spark, path).collect()}


def test_appended_states(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.read_state(spark, path).count() == 0
    for number, rows in ((1, [vessel("a", sog=1.0), vessel("b", sog=1.0)]), (3, [vessel("a", sog=2.0)])):
        tables.append_state(arrived(spark, number, *rows), path)
    assert speeds(spark, path) == {"a": 2.0, "b": 1.0}
    for number, rows in ((3, [vessel("a", sog=2.0)]), (1, [vessel("a", sog=1.0)])):  # replays, in any order
        tables.append_state(arrived(spark, number, *rows), path)
    assert speeds(spark, path) == {"a": 2.0, "b": 1.0}
    with pytest.raises(ValueError):
        tables.append_state(state_df(spark, []), path, "event_time")


def test_a_purged_vessel_stays_away_until_it_reports_again(spark, tmp_path):
    path, track = str(tmp_path / "state"), str(tmp_path / "track")
    old = vessel("a", sog=1.0, seen=T0 - minutes(60 * 30))
    tables.append_state(arrived(spark, 1, old, vessel("b", sog=1.0, seen=T0)), path)
    tables.append_state(arrived(spark, 5, vessel("c", sog=5.0, seen=T0)), path)
    assert retention.run_retention(spark, path, track, T0, purge_hours=24)["stale_purged"] == 1
    tables.append_state(arrived(spark, 1, old), path)  # a replay of what was purged
    assert speeds(spark, path) == {"b": 1.0, "c": 5.0}
    assert retention.run_retention(spark, path, track, T0, purge_hours=24)["stale_purged"] == 0
    tables.append_state(arrived(spark, 9, vessel("a", sog=9.0, seen=T0)), path)
    assert speeds(spark, path) == {"a": 9.0, "b": 1.0, "c": 5.0}


def test_old_hours_are_carried_and_dropped(spark, tmp_path):
    path = str(tmp_path / "state")
    now = datetime.now(timezone.utc)
    late = vessel("p", sog=1.0, seen=T0 - minutes(60 * 30))
    hours = [now - timedelta(hours=h) for h in (300, 7, 6, 1)]
    tables.append_state(arrived(spark, 1, vessel("a", sog=1.0), vessel("b", sog=1.0), late), path, now=hours[0])
    tables.append_state(arrived(spark, 5, vessel("a", sog=5.0)), path, now=hours[1])
    marked = retention.aged_states(tables.state_snapshot(spark, path), T0, purge_hours=24)
    assert {r["mmsi"]: r["_mark"] for r in marked.collect()} == {"p": tables.PURGED}
    tables.append_state(marked, path, now=hours[2])
    tables.append_state(arrived(spark, 7, vessel("c", sog=7.0)), path, now=hours[3])
    want = {"a": 5.0, "b": 1.0, "c": 7.0}
    assert speeds(spark, path) == want
    assert len(tables.carry_state(spark, path, now)) == 3
    assert speeds(spark, path) == want and len(paths.folders(spark, f"{path}/order=arrival")) == 2
    tables.append_state(arrived(spark, 3, late), path, now=now)  # replayed within the days of its mark
    assert speeds(spark, path) == want
    # a clean-up that stopped before it dropped the old hours: its rows are there twice
    tables.append_state(tables.state_snapshot(spark, path, purged=True), path, now=now)
    assert speeds(spark, path) == want
    assert tables.carry_state(spark, path, now) == [] and tables.carry_state(spark, path, now + timedelta(days=9))
    assert speeds(spark, path) == want
    assert spark.read.parquet(path).count() == 3  # the mark is gone too


def test_clean_up_keeps_the_order_by_event_time(spark, tmp_path):
    path, track = str(tmp_path / "state"), str(tmp_path / "track")
    for seen, sog in ((T0, 30.0), (T0 - minutes(9), 1.0)):
        tables.append_state(state_df(spark, [vessel("a", seen=seen, sog=sog)]), path, "event_time")
    assert tables.read_state(spark, path).first().sog_knots == 30.0
    retention.run_retention(spark, path, track, T0 + minutes(5))
    assert tables.read_state(spark, path).first().sog_knots == 30.0
    tables.append_state(state_df(spark, [vessel("a", seen=T0 - minutes(1), sog=2.0)]), path, "event_time")
    assert tables.read_state(spark, path).first().sog_knots == 30.0


def test_arrival_decides_whatever_the_batches(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = [event(event_id=f"e{i}", ingested_at=ARRIVED + i, sog_knots=float(i)) for i in range(4)]
    for batch, i in enumerate((2, 3, 0, 1)):
        tables.append_state(st.current_state(events_df(spark, [rows[i]]), T0, with_arrival=True), path)
        if batch == 1:
            retention.run_retention(spark, path, str(tmp_path / "track"), T0)
    assert tables.read_state(spark, path).first().sog_knots == 3.0


def test_short_retention_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.expire_track(spark, str(tmp_path), T0, 6)


def test_track_hours_prune(spark, tmp_path):
    _, track = stored(spark, tmp_path)
    df = tables.read_track(spark, track, F.lit("2025-03-04 08:30:00").cast("timestamp"))
    plan = df.select("latitude")._jdf.queryExecution().executedPlan().toString()
    assert "partition_hour" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert df.count() == 4


def test_an_append_goes_through_its_events_twice_and_keeps_given_hours(spark, tmp_path):
    path, seen = str(tmp_path / "archive"), spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    events = events_df(spark, [event(event_id=f"e{n}", event_time=feed_time(T0 + minutes(20 * n))) for n in range(6)])
    counted = events.withColumn("event_time", F.udf(read, "string")("event_time"))
    assert ar.write_archive(counted.limit(3), path) == 3
    seen.value = 0
    assert ar.write_archive(counted, path) == 3  # once to count rows and name hours, once to store
    assert seen.value == 2 * 6
    odd = events_df(spark, [event(event_id="t", event_time="?", ingested_at=0.0), event(event_id="u", event_time="?"), event(event_id="v")])
    dated = ar.dated(odd, T0)
    assert [r._timeless for r in dated.collect()] == [True, False, False]
    assert dated.drop("_timeless").collect() == ar.with_partition(odd, T0).collect()
    assert ar.write_archive(dated, path) == 3 and ar.read_archive(spark, path).count() == 9
