import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import ARRIVED, T0, event, events_df, feed_time, minutes, state_df, vessel
from tidewake.operators import fleet as fl
from tidewake.operators import presentation as pr
from tidewake.operators import state as st
from tidewake.operators import track as tr
from tidewake.schemas import empty_state, empty_track



def moving(i, mmsi="200000001", at=None, **kw):
    """Event number i in order of arrival; event time i minutes after the start unless given."""
    kw = {"event_id": f"e{i}", "mmsi": mmsi, "event_time": feed_time(T0 + minutes(i if at is None else at)),
          "ingested_at": ARRIVED + 60 * i, "sog_knots": float(i), **kw}
    return event(**kw)


def test_rows_without_place_or_vessel_are_dropped(spark):
    df = events_df(spark, [event(), event(latitude=None), event(longitude=None), event(mmsi=None), event(mmsi="")])
    assert st.build_state_rows(df, T0).count() == 1 == st.build_track_rows(df, T0).count()
    row = st.build_track_rows(df, T0).first()
    assert row.partition_hour == T0 and (row.position.lon, row.position.lat) == (103.0, 1.0)


def test_time_falls_back_to_arrival(spark):
    df = events_df(spark, [event(event_time="garbage", ingested_at=ARRIVED + 5), event(event_time=None, ingested_at=None)])
    seen = [r.last_seen_at for r in st.build_state_rows(df, T0 + minutes(9)).collect()]
    assert seen == [T0 + minutes(5 / 60), T0 + minutes(9)]


def test_last_arrival_wins_even_when_older(spark):
    df = events_df(spark, [moving(1, at=30), moving(2, at=10), moving(3, mmsi="200000002")])
    by_arrival = {r.mmsi: r for r in st.current_state(df, T0).collect()}
    assert by_arrival["200000001"].sog_knots == 2.0
    assert by_arrival["200000001"].last_seen_at == T0 + minutes(10)
    by_time = {r.mmsi: r for r in st.current_state(df, T0, "event_time").collect()}
    assert by_time["200000001"].sog_knots == 1.0
    with pytest.raises(ValueError):
        st.current_state(df, T0, "else")


def test_upsert_replaces_whole_rows(spark):
    first = st.current_state(events_df(spark, [moving(1), moving(2, mmsi="200000002")]), T0)
    batch = st.build_state_rows(events_df(spark, [
        moving(5, at=-60, ship_name=None), moving(4, sog_knots=9.0), moving(6, mmsi="200000003")]), T0 + minutes(9))
    merged = {r.mmsi: r for r in st.upsert_state(first, batch).collect()}
    assert sorted(merged) == ["200000001", "200000002", "200000003"]
    one = merged["200000001"]
    assert (one.ship_name, one.sog_knots, one.updated_at) == (None, 5.0, T0 + minutes(9))
    assert merged["200000002"].updated_at == T0
    late = {r.mmsi: r for r in st.upsert_state(first, batch, "event_time").collect()}
    assert late["200000001"].sog_knots == 9.0
    assert st.upsert_state(empty_state(spark), batch).count() == 2


def test_upsert_equals_applying_everything(spark):
    rows = [moving(i, mmsi=f"20000000{i % 7}", at=(i * 37) % 50) for i in range(60)]
    whole = st.current_state(events_df(spark, rows), T0)
    part = st.upsert_state(st.current_state(events_df(spark, rows[:25]), T0),
                           st.build_state_rows(events_df(spark, rows[25:]), T0))
    assert sorted(whole.collect()) == sorted(part.collect())


def test_listing_and_detail(spark):
    state = state_df(spark, [vessel("200000002"), vessel("200000001", rot=3.0)])
    assert [r.mmsi for r in st.list_vessels(state).collect()] == ["200000001", "200000002"]
    assert len(st.list_vessels(state).columns) == 10 and len(st.vessel_detail(state, "x").columns) == 12
    assert st.vessel_detail(state, "200000001").first().rate_of_turn == 3.0
    assert st.vessel_detail(state, "x").count() == 0


def test_ageing(spark):
    state = state_df(spark, [vessel("a", seen=T0 - minutes(45)), vessel("b", seen=T0 - minutes(45.1)),
                             vessel("c", seen=None), vessel("d", seen=T0 - minutes(600), status=None),
                             vessel("e", seen=T0 - minutes(600), status="STALE")])
    got = {r.mmsi: r.status for r in st.mark_stale(state, T0).collect()}
    assert got == {"a": "UNDERWAY", "b": "STALE", "c": "UNDERWAY", "d": None, "e": "STALE"}
    assert state.filter(st.stale_now(T0)).count() == 1
    assert sorted(r.mmsi for r in st.purge_state(state, T0, 10).collect()) == ["a", "b", "c", "d", "e"]
    assert sorted(r.mmsi for r in st.purge_state(state, T0, 9).collect()) == ["a", "b", "c"]
    assert st.purge_state(state, T0, 0).count() == 5


def test_track_first_arrival_wins(spark):
    rows = st.build_track_rows(events_df(spark, [
        moving(1), event(event_id="e1", ingested_at=ARRIVED + 1e6, sog_knots=77.0), moving(2),
        moving(1, mmsi="200000002")]), T0)
    assert sorted((r.mmsi, r.event_id, r.sog_knots) for r in tr.dedup_track(rows).collect()) == [
        ("200000001", "e1", 1.0), ("200000001", "e2", 2.0), ("200000002", "e1", 1.0)]
    assert tr.append_track(empty_track(spark), rows).count() == 3


@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_append_skips_known_keys(spark, max_bytes):
    stored = tr.dedup_track(st.build_track_rows(events_df(spark, [moving(i) for i in range(5)]), T0))
    rows = st.build_track_rows(events_df(spark, [moving(i) for i in range(3, 9)]), T0).persist()
    for df in (tr.append_track(stored, rows), tr.append_small_batch(stored, rows, max_bytes)):
        assert sorted(r.event_id for r in df.collect()) == ["e5", "e6", "e7", "e8"]


def test_vessel_track_window(spark):
    rows = st.build_track_rows(events_df(spark, [moving(i) for i in (0, 30, 61, 200)]), T0)
    df = tr.vessel_track(rows, "200000001", T0 + minutes(60 * 12 + 30))
    assert [r.sog_knots for r in df.collect()] == [61.0, 200.0]
    assert df.columns == ["event_time", "latitude", "longitude", "sog_knots"]


def test_expiry_keeps_unknown_times(spark):
    rows = st.build_track_rows(events_df(spark, [moving(0), moving(1), moving(2)]), T0)
    rows = rows.withColumn("event_time", F.when(F.col("event_id") != "e2", F.col("event_time")))
    left = tr.expire_track(rows, T0 + minutes(60 * 24 + 1))
    assert sorted(r.event_id for r in left.collect()) == ["e1", "e2"]


@pytest.mark.parametrize("grain,hours", [("hour", 1), ("day", 24)])
def test_lines_keep_every_point(spark, grain, hours):
    reports = [moving(i, at=(i * 37) % 300, latitude=float((i * 37) % 300)) for i in range(300)]
    rows = st.build_track_rows(events_df(spark, [*reports, moving(1, mmsi="200000002")]), T0)
    lines = tr.track_linestring(rows, grain).orderBy("mmsi", "since").collect()
    long = [r for r in lines if r.mmsi == "200000001"]
    assert len(long) == (5 if grain == "hour" else 1) and len(lines) == len(long) + 1
    points = []
    for r in long:
        part = json.loads(r.feature)["geometry"]["coordinates"]
        assert len(part) == r.points and r.since <= T0 + minutes(len(points)) < r.since + minutes(60 * hours)
        points += part
    assert [p[1] for p in points] == [float(i) for i in range(300)]
    assert tr.track_linestring(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tr.track_linestring(rows, "week")


# ---- Reports ------------------------------------------------------------------------------

def small_fleet(spark):
    return state_df(spark, [
        vessel("200000001", sog=0.5, cog=11.25, seen=T0, nav=1, status="ANCHORED", rot=20.0),
        vessel("200000002", sog=0.51, cog=33.75, seen=T0 - minutes(45), nav=9, rot=-127.0),
        vessel("200000003", sog=None, cog=359.9, seen=T0 - minutes(44), nav=None, status="STALE", rot=None),
        vessel("200000004", sog=20.0, cog=360.0, seen=None, nav=10, status=None, rot=1.0),
        vessel("200000005", sog=-1.0, cog=359.9, nav=5, status="MOORED", rot=0.0),
        vessel("20000006", sog=99.0), vessel("None", sog=99.0)])


def test_kpis(spark):
    r = fl.fleet_kpis(small_fleet(spark), T0).first()
    assert (r.total, r.fresh, r.stale, r.moving, r.idle, r.anchored, r.moored) == (5, 3, 1, 2, 3, 1, 1)
    assert r.max_sog == 20.0 and r.avg_sog == pytest.approx((0.5 + 0.51 + 20 - 1) / 4)


def test_summary_and_fastest(spark):
    track = st.build_track_rows(events_df(spark, [moving(0), moving(1, mmsi="None")]), T0)
    r = fl.fleet_summary(small_fleet(spark), track, T0 + minutes(60 * 12)).first()
    assert (r.events_window, r.fastest.mmsi) == (1, "200000004")
    assert [(s.status, s["count"]) for s in r.by_status] == [
        (None, 1), ("ANCHORED", 1), ("MOORED", 1), ("STALE", 1), ("UNDERWAY", 1)]
    empty = fl.fleet_summary(empty_state(spark), empty_track(spark), T0).first()
    assert (empty.total, empty.fastest, empty.by_status, empty.events_window) == (0, None, [], 0)


def test_speed(spark):
    rows = fl.speed_histogram(small_fleet(spark)).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0, 1), (0.0, 1.0, 2), (20.0, None, 1)]
    r = fl.speed_distribution(small_fleet(spark)).first()
    assert (r.sample_n, r.max_sog, len(r.buckets)) == (4, 20.0, 3)
    assert r.p50_sog == pytest.approx(0.505)
    assert fl.speed_stats(empty_state(spark)).first().p50_sog is None
    assert fl.speed_stats(small_fleet(spark), exact=False).first().sample_n == 4


def test_navigation(spark):
    r = fl.nav_report(small_fleet(spark)).first()
    assert r.total == 5
    assert [tuple(b) for b in r.buckets] == [(9, "Reserved", 2), (1, "At Anchor", 1), (5, "Moored", 1),
                                             (None, "Unknown", 1)]
    shares = pr.cumulative_share(fl.nav_distribution(small_fleet(spark))).orderBy("start_angle").collect()
    assert shares[0].start_angle == pytest.approx(-1.5707963) and shares[-1].end_angle == pytest.approx(4.712389)
    assert all(a.end_angle == pytest.approx(b.start_angle) for a, b in zip(shares, shares[1:]))


def test_flow(spark):
    r = fl.flow_report(small_fleet(spark)).first()
    assert r.total == 3
    assert [(b.sector_deg, b.label, b["count"]) for b in r.buckets] == [(0.0, "N", 2), (45.0, "NE", 1)]
    dense = pr.dense_sectors(spark, fl.flow_rose(small_fleet(spark))).collect()
    assert len(dense) == 16 and sum(d["count"] for d in dense) == 3 and dense[15].label == "NNW"


def test_maneuvering(spark):
    got = [(r.mmsi, r.rot_deg_min, r.direction) for r in fl.maneuvering(small_fleet(spark)).collect()]
    assert got == [("200000002", None, "starboard"), ("200000001", 21.2, "starboard")]
    assert fl.maneuvering(small_fleet(spark), 10.5).count() == 1
    assert fl.maneuvering(small_fleet(spark), 0, limit=1).count() == 1
    with pytest.raises(ValueError):
        fl.maneuvering(small_fleet(spark), 181)


def test_presentation(spark):
    state = small_fleet(spark)
    assert pr.visible_count(state, False).first()[0] == 6 and pr.visible_count(state).first()[0] == 7
    feature = json.loads(pr.to_geojson_features(state, selected_mmsi="200000003")
                         .filter("mmsi = '200000003'").first().feature)
    assert feature["geometry"] == {"type": "Point", "coordinates": [103.0, 1.0]}
    assert feature["properties"]["selected"] is True and feature["properties"]["sog_knots"] is None
    assert len(feature["properties"]) == 11
    bars = pr.share_of_max(fl.status_counts(state)).collect()
    assert {b.share for b in bars} == {1.0} and {b.color_index for b in bars} == {4}
    zero = spark.createDataFrame([("a", 0)], "label string, count int")
    assert tuple(pr.share_of_max(zero).first())[2:] == (0.0, 0)
    assert pr.table_rows(state, 2).count() == 2
    assert pr.map_symbols(state).filter("mmsi = '200000004'").first().color == "#64748b"
