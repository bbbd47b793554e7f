import math
import random

import pytest

from tests.helpers import state_df, vessel
from tidewake.functions import geo
from tidewake.operators import proximity as px


def distances(spark, pairs):
    """Lambert distance of each (lat1, lon1, lat2, lon2)."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    df = geo.with_geodesic(df, "m", "a", "b", "c", "d")
    return [r.m for r in df.orderBy("i").collect()]


def brute_pairs(spark, rows, radius, limit, mode="planar"):
    rows = [r for r in rows if len(r[0]) == 9 and r[0].isdigit()]
    margin, found = radius / 111000, []
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            lo, hi = sorted((a, b))
            dlat, dlon = abs(lo[2] - hi[2]), abs(lo[3] - hi[3])
            if mode == "planar" and not (dlat < margin and dlon < margin and math.hypot(dlat, dlon) <= margin):
                continue
            if mode == "geodesic" and dlat > radius / 110000:
                continue
            found.append((lo, hi))
    d = distances(spark, [(a[2], a[3], b[2], b[3]) for a, b in found])
    out = sorted((round(m, 3), a[0], b[0]) for m, (a, b) in zip(d, found)
                 if mode == "planar" or round(m, 3) <= radius)
    return out[:limit]


def grid_pairs(spark, rows, radius, limit, mode="planar"):
    df = px.conflicts(state_df(spark, rows), radius, limit, mode)
    return [(round(r.distance_m, 3), r.a.mmsi, r.b.mmsi) for r in df.collect()]


def mmsi(i):
    return str(200000000 + i)


def fleets():
    rng = random.Random(11)
    margin = 500 / 111000
    uniform = [vessel(mmsi(i), 1 + rng.random() * 0.05, 103 + rng.random() * 0.05) for i in range(250)]
    # One harbour holds most vessels, many of them on one of a few exact spots.
    spots = [(1.2 + rng.random() * 1e-4, 103.7 + rng.random() * 1e-4) for _ in range(4)]
    crowd = [vessel(mmsi(i), *spots[i % 4]) if i % 2 else
             vessel(mmsi(i), 1.2 + rng.random() * 1e-3, 103.7 + rng.random() * 1e-3) for i in range(260)]
    far = [vessel(mmsi(1000 + i), -40 + rng.random() * 80, rng.random() * 170) for i in range(30)]
    borders = [vessel(mmsi(4 * i + j), (10 + i) * margin + dy, (20000 + 3 * i) * margin + dx)
               for i in range(40) for j, (dy, dx) in enumerate(
                   [(-1e-9, -1e-9), (1e-9, 1e-9), (margin / 2, 0), (0, -margin * 0.999)])]
    north = [vessel(mmsi(i), 84 + rng.random() * 0.02, -30 + rng.random() * 0.2) for i in range(150)]
    return {"uniform": uniform, "crowd": crowd + far, "borders": borders, "north": north,
            "few": uniform[:3] + far}


@pytest.mark.parametrize("name", ["uniform", "crowd", "borders", "north", "few"])
@pytest.mark.parametrize("mode", ["planar", "geodesic"])
def test_conflicts_equal_brute_force(spark, name, mode):
    rows = fleets()[name]
    rows = rows + [vessel("12345678", rows[0][2], rows[0][3]), vessel("None", rows[0][2], rows[0][3])]
    for radius, limit in ((500, 50), (5000, 7)):
        assert grid_pairs(spark, rows, radius, limit, mode) == brute_pairs(spark, rows, radius, limit, mode)


def test_conflicts_all_at_one_point(spark):
    rows = [vessel(mmsi(i), 0.0, 0.0) for i in range(300)]
    got = grid_pairs(spark, rows, 500, 50)
    assert got == [(0.0, mmsi(0), mmsi(i)) for i in range(1, 51)]


def test_conflicts_across_the_meridian(spark):
    rows = [vessel(mmsi(1), 10.0, 179.9995), vessel(mmsi(2), 10.0, -179.9995), vessel(mmsi(3), 10.0, 179.9990)]
    assert [(a, b) for _, a, b in grid_pairs(spark, rows, 500, 50)] == [(mmsi(1), mmsi(3))]
    assert [(a, b) for _, a, b in grid_pairs(spark, rows, 500, 50, "geodesic")] == [
        (mmsi(1), mmsi(3)), (mmsi(1), mmsi(2)), (mmsi(2), mmsi(3))]


def test_conflicts_near_the_pole(spark):
    rows = [vessel(mmsi(i), 89.9995, -180 + 18.0 * i) for i in range(20)] + [vessel(mmsi(90), 90.0, 0.0)]
    assert grid_pairs(spark, rows, 200, 300, "geodesic") == brute_pairs(spark, rows, 200, 300, "geodesic")


def test_conflicts_bounds(spark):
    state = state_df(spark, [vessel(mmsi(1))])
    for radius in (0, -1, 20001):
        with pytest.raises(ValueError):
            px.conflicts(state, radius)
    with pytest.raises(ValueError):
        px.conflicts(state, 500, mode="else")
    assert px.conflicts(state).count() == 0


def test_conflicts_plan_is_an_equi_join(spark):
    plan = px.conflicts(state_df(spark, fleets()["uniform"]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in plan


def brute_near(spark, rows, lat, lon, radius, limit):
    d = distances(spark, [(r[2], r[3], lat, lon) for r in rows])
    return sorted((round(m, 3), r[0]) for m, r in zip(d, rows) if round(m, 3) <= radius)[:limit]


def test_nearby_equals_brute_force(spark):
    rows = fleets()["crowd"] + [vessel("BAD", 1.2, 103.7)]
    for lat, lon, radius in ((1.2, 103.7, 60.0), (1.2, 103.7, 5000.0), (0.0, 179.9, 9_000_000.0), (89.99, 0.0, 6_000_000.0)):
        got = [(round(r.distance_m, 3), r.mmsi) for r in px.nearby(state_df(spark, rows), lat, lon, radius).collect()]
        assert got == brute_near(spark, rows, lat, lon, radius, 100)


def test_nearby_bounds(spark):
    state = state_df(spark, [vessel(mmsi(1))])
    for args in ((91, 0, 1), (0, 181, 1), (0, 0, 0), (None, 0, 1)):
        with pytest.raises(ValueError):
            px.nearby(state, *args)


def test_nearby_filters_reach_the_scan(spark, tmp_path):
    state_df(spark, fleets()["few"]).write.parquet(str(tmp_path / "s"))
    df = px.nearby(spark.read.parquet(str(tmp_path / "s")), 1.2, 103.7, 1000.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude" in plan and "LessThanOrEqual(longitude" in plan
    assert "true_heading" not in plan


@pytest.mark.parametrize("name", ["uniform", "crowd", "north"])
def test_nearby_many_equals_brute_force(spark, name):
    rows = fleets()[name]
    rng = random.Random(2)
    points = [(f"p{i}", rows[i * 3][2] + rng.uniform(-1e-3, 1e-3), rows[i * 3][3] + rng.uniform(-1e-3, 1e-3))
              for i in range(40)] + [("same", rows[0][2], rows[0][3]), ("line", 0.0, 180.0), ("none", -80.0, 0.0)]
    df = spark.createDataFrame(points, "point_id string, lat double, lon double")
    for radius, limit in ((300.0, 4), (20000.0, 20), (4_000_000.0, 1200), (1e9, 2)):
        got = {}
        result = px.nearby_many(df, state_df(spark, rows), radius, limit)
        for r in result.orderBy("point_id", "rank").collect():
            got.setdefault(r.point_id, []).append((round(r.distance_m, 3), r.mmsi))
        for pid, lat, lon in points:
            assert got.get(pid, []) == brute_near(spark, rows, lat, lon, radius, limit), (pid, radius)


def test_points_beside_a_crowd_look_at_its_edge_only(spark):
    rng = random.Random(3)
    rows = [vessel(mmsi(i), 1.2 + rng.uniform(0, 2e-3), 103.7 + rng.uniform(0, 2e-3)) for i in range(4000)]
    points = [(f"p{i}", 1.2 - 1e-4, 103.7 + i * 1e-4) for i in range(20)] + [("far", 1.0, 103.7), ("in", 1.201, 103.701)]
    df = spark.createDataFrame(points, "point_id string, lat double, lon double")
    reach = {r.point_id: r["_d"] for r in px.search_reach(df, state_df(spark, rows), 30_000.0, 5).collect()}
    assert reach["far"] == 30_000.0 and reach["in"] < 100
    assert all(reach[f"p{i}"] < 400 for i in range(20))
    for pid, lat, lon in points[:3]:
        within = brute_near(spark, rows, lat, lon, reach[pid], 10**6)
        assert 5 <= len(within) < 2500  # what the join meets, of 4000


def test_nearby_many_has_no_nested_loop(spark):
    points = spark.createDataFrame([("a", 1.0, 103.0)], "point_id string, lat double, lon double")
    df = px.nearby_many(points, state_df(spark, fleets()["uniform"]), 500.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_distance_proves_enough_pairs(spark):
    rows = fleets()["crowd"]
    state = state_df(spark, rows)
    found = px.search_distance(state, 504.0, 500 / 111000 / 2, 50).first()["distance"]
    assert found < 504.0
    within = brute_pairs(spark, rows, 500, 10**9)
    assert sum(d <= found for d, _, _ in within) >= 50
    assert px.search_distance(state.limit(0), 504.0, 0.002, 50).first()["distance"] == 504.0


def test_severity_columns(spark):
    rows = [vessel(mmsi(1), 1.0, 103.0), vessel(mmsi(2), 1.001, 103.0)]
    r = px.with_severity(px.conflicts(state_df(spark, rows))).first()
    assert (r.severity, r.distance_text) == ("hi", "111 m")
    assert r.a.latitude == 1.0 and r.b.mmsi == mmsi(2)
