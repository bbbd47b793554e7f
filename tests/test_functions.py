import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import T0
from tidewake.functions import geo, times, vessel


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


TIMES = [
    ("2024-02-29 23:59:59.000001 +0000 UTC", datetime(2024, 2, 29, 23, 59, 59, 1)),
    ("2025-03-04 09:00:07 +0000 UTC", datetime(2025, 3, 4, 9, 0, 7)),
    ("2025-03-04 09:00:07", datetime(2025, 3, 4, 9, 0, 7)),
    ("2025-03-04T09:00:07Z", datetime(2025, 3, 4, 9, 0, 7)),
    ("2025-03-04 09 +0000", datetime(2025, 3, 4, 9)),
    ("2025-03-04T00:30-01:30", datetime(2025, 3, 4, 2, 0)),
    ("2025-03-04", datetime(2025, 3, 4)),
    ("2025-03-04 09:00:07,250000", datetime(2025, 3, 4, 9, 0, 7, 250000)),
    ("2025-03-04 09:00:07 +0545 UTC", datetime(2025, 3, 4, 3, 15, 7)),
    (" 2025-03-04 09:00:07 UTC ", datetime(2025, 3, 4, 9, 0, 7)),
    ("soon", None), ("--", None), ("09:00", None), ("2025", None),
    ("2025-02-30 00:00:00", None), ("2025-03-04 24:01:00", None), ("", None), (None, None),
]


def test_event_times_parse_like_the_feed(spark):
    df = spark.createDataFrame([(t,) for t, _ in TIMES], "t string")
    got = [r[0] for r in df.select(times.parse_event_time("t")).collect()]
    assert got == [want for _, want in TIMES]


def test_parse_agrees_with_the_standard_library(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        at = datetime(2026, 1, 1) + timedelta(microseconds=rng.randrange(10**15))
        text = at.strftime(rng.choice(["%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"]))
        if len(text) > 10:
            text += rng.choice(["", " +0000", "Z", "+05:30", "-0300"])
        texts.append(text + rng.choice(["", " UTC"]))

    def expected(text):
        parsed = datetime.fromisoformat(text.replace(" UTC", "").strip())
        return parsed if parsed.tzinfo is None else parsed.astimezone(timezone.utc).replace(tzinfo=None)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(times.parse_event_time("t")).collect()]
    assert got == [expected(t) for t in texts]


def test_archive_reading_drops_the_offset(spark):
    df = spark.createDataFrame([("2025-03-04 09:00:07 +0545 UTC",), ("2025-03-04 09:00:07.500000 +0000 UTC",),
                                ("2025-03-04",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(times.parse_event_time_as_utc("t")).collect()]
    assert got == [datetime(2025, 3, 4, 9, 0, 7), datetime(2025, 3, 4, 9, 0, 7, 500000), datetime(2025, 3, 4), None, None]


@pytest.mark.parametrize("step", [-1, -0.25, 0, 0.25, 1])
def test_skew_bounds_are_strict(spark, step):
    received = 1_700_000_000.0
    bounds = (times.FUTURE_TOLERANCE_S, -times.STALE_TOLERANCE_S)
    rows = [(datetime(1970, 1, 1) + timedelta(seconds=received + b + step), received) for b in bounds]
    df = spark.createDataFrame(rows, "at timestamp, r double")
    got = [r[0] for r in df.select(times.classify_skew("at", "r")).collect()]
    assert got == ["future_timestamp" if step > 0 else None, "stale_timestamp" if step < 0 else None]


def test_unreadable_time_has_a_reason_and_counts_from_the_epoch(spark):
    df = spark.createDataFrame([(None, 2.5)], "at timestamp, r double")
    assert tuple(df.select(times.classify_skew("at", "r"), times.latency_ms("at", "r")).first()) == (
        "unparseable_timestamp", 2500)


def test_latency_truncates_toward_zero(spark):
    at = datetime(1970, 1, 1, 0, 0, 10)
    df = spark.createDataFrame([(at, 9.9996), (at, 10.0009)], "at timestamp, r double")
    assert [r[0] for r in df.select(times.latency_ms("at", "r")).collect()] == [0, 0]


def test_partition_falls_back_to_arrival_then_now(spark):
    said, arrived, now = datetime(2024, 2, 29, 23, 59), datetime(2024, 3, 1, 0, 1), datetime(2024, 3, 7, 6)
    stamp = arrived.replace(tzinfo=timezone.utc).timestamp()
    rows = [(said.strftime("%Y-%m-%d %H:%M:%S +0000 UTC"), stamp), ("?", stamp), ("?", None), (None, 0.0)]
    df = spark.createDataFrame(rows, "t string, r double")
    at = times.effective_time("t", "r", F.lit(str(now)).cast("timestamp"))
    got = [tuple(r) for r in df.select(times.partition_date(at), times.partition_hour_text(at)).collect()]
    assert got == [(x.strftime("%Y-%m-%d"), x.strftime("%H")) for x in (said, arrived, now, now)]


def test_window_keeps_unreadable_partitions(spark):
    limit = datetime(2024, 5, 5, 7, 20)
    rows = [(day.strftime("%Y-%m-%d"), f"{hour:02d}", day + timedelta(hours=hour + 1) > limit)
            for day in (limit.replace(hour=0, minute=0) + timedelta(days=d) for d in (-1, 0, 1)) for hour in range(24)]
    # Without an hour a folder stands for midnight; what cannot be read is kept.
    rows += [("2024-05-05", None, False), ("2024-05-06", None, True), (None, None, True), ("soon", "03", True),
             ("2024-05-04", "?", True)]
    df = spark.createDataFrame(rows, "dt string, HH string, want boolean")
    cutoff = F.lit(str(limit)).cast("timestamp")
    bad = [tuple(r) for r in df.select("dt", "HH", times.in_window("dt", "HH", cutoff).alias("got"), "want").collect()
           if r.got != r.want]
    assert bad == []


def test_status_rules(spark):
    def rule(nav, sog):
        if nav in (1, 5):
            return {1: "ANCHORED", 5: "MOORED"}[nav]
        if nav == 0 and not sog:
            return "STOPPED"
        return "UNDERWAY" if nav in (0, 8) and (sog or 0) > 0 else "UNKNOWN"

    rows = [(nav, sog, rule(nav, sog)) for nav in (*range(16), None) for sog in (None, 0.0, 0.1, 14.0, 102.2)]
    df = spark.createDataFrame(rows, "nav int, sog double, want string")
    assert [tuple(r) for r in df.select("nav", "sog", vessel.derive_status("nav", "sog")).collect()] == rows


def test_sentinels_become_null(spark):
    df = spark.createDataFrame([(511, -128), (0, 0), (359, -127), (None, None)], "h int, r int")
    got = [tuple(r) for r in df.select(vessel.heading("h"), vessel.rate_of_turn("r")).collect()]
    assert got == [(None, None), (0.0, 0.0), (359.0, -127.0), (None, None)]


def test_turn_rate_decoding(spark):
    rows = [(None,), (0.0,), (20.0,), (-20.0,), (126.0,), (127.0,), (-127.0,)]
    df = spark.createDataFrame(rows, "x double")
    got = [tuple(r[0]) for r in df.select(vessel.decode_rot("x")).collect()]
    rate = round(4.733 * math.sqrt(20), 1)
    top = round(4.733 * math.sqrt(126), 1)
    assert got == [(None, None, 0.0), (0.0, "port", 0.0), (rate, "starboard", rate), (rate, "port", rate),
                   (top, "starboard", top), (None, "port", 10.0), (None, "starboard", 10.0)]
    itu = [tuple(r[0])[:2] for r in df.select(vessel.decode_rot("x", "itu")).collect()]
    assert itu[1] == (0.0, None) and itu[2] == (17.9, "starboard") and itu[6] == (None, "port")


def test_course_sectors_round_half_to_even_and_wrap(spark):
    df = spark.createDataFrame([(11.25, 0), (33.75, 2), (348.74, 15), (359.9, 0), (348.75, 0), (56.25, 2)],
                               "c double, want int")
    assert all(r[0] == r[1] for r in df.select(vessel.compass_sector("c"), "want").collect())


def test_labels(spark):
    df = spark.createDataFrame([(0,), (9,), (15,), (None,)], "n int")
    got = [tuple(r) for r in df.select(vessel.nav_label("n"), vessel.nav_short_label("n")).collect()]
    assert got == [("Underway", "Underway"), ("Reserved", "Reserved"), ("Undefined", "Unknown"), ("Unknown", "Unknown")]
    assert one(spark, vessel.compass_label(F.lit(15))) == "NNW"
    assert one(spark, vessel.status_color(F.lit("???"))) == one(spark, vessel.status_color(F.lit(None).cast("string")))


def test_display_text(spark):
    df = spark.createDataFrame([(149.9,), (150.0,), (350.0,), (999.5,), (1234.0,)], "d double")
    got = [tuple(r) for r in df.select(vessel.severity("d"), vessel.distance_text("d")).collect()]
    assert got == [("hi", "150 m"), ("mid", "150 m"), ("low", "350 m"), ("low", "1000 m"), ("low", "1.23 km")]
    ages = [T0, T0 - timedelta(seconds=59), T0 - timedelta(minutes=1), T0 - timedelta(minutes=60),
            T0 - timedelta(hours=50), T0 + timedelta(hours=1), None]
    df = spark.createDataFrame([(a,) for a in ages], "a timestamp")
    got = [r[0] for r in df.select(vessel.age_bucket("a", T0)).collect()]
    assert got == ["now", "now", "1 min ago", "1 h ago", "50 h ago", "now", None]
    assert one(spark, vessel.display_name(F.lit(""), F.lit("7"))) == "Vessel 7"
    assert one(spark, vessel.icon_rotation(F.lit(None).cast("double"), F.lit(3.0))) == 3.0


def vincenty(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Vincenty's inverse formula on arrays: what the closed form is checked against."""
    a, f = geo.WGS84_A, geo.WGS84_F
    b = a * (1 - f)
    u1 = np.arctan((1 - f) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - f) * np.tan(np.radians(lat2)))
    ell = np.radians(lon2 - lon1)
    lam = ell.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(40):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam),
                             np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_al = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2_al = 1 - sin_al**2
            cos_2m = np.where(cos2_al == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_al)
            c = f / 16 * cos2_al * (4 + f * (4 - 3 * cos2_al))
            lam = ell + (1 - c) * f * sin_al * (
                sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
        k2 = cos2_al * (a**2 - b**2) / b**2
        big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
        big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
        delta = big_b * sin_s * (cos_2m + big_b / 4 * (
            cos_s * (2 * cos_2m**2 - 1)
            - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
    return np.where(sin_s == 0, 0.0, b * big_a * (sigma - delta))


def test_distances_against_vincenty(spark):
    rng = random.Random(5)
    rows = [(1.0, 2.0, 1.0, 2.0)]
    for _ in range(2000):
        lat, lon, k = rng.uniform(-80, 80), rng.uniform(-180, 180), 10 ** rng.uniform(-5, 0.6)
        rows.append((lat, lon, max(-85, min(85, lat + rng.uniform(-k, k))), lon + rng.uniform(-k, k)))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    df = geo.with_geodesic(df, "staged", "a", "b", "c", "d")
    df = df.select("staged", *[geo.geodesic_m("a", "b", "c", "d", m).alias(m) for m in ("lambert", "haversine")], "a", "b", "c", "d")
    rows = df.collect()
    assert tuple(rows[0])[:3] == (0.0, 0.0, 0.0)
    exact = vincenty(*np.array([[r[c] for r in rows] for c in "abcd"]))
    for r, metres in list(zip(rows, exact))[1:]:
        assert abs(r["lambert"] - metres) <= 2e-6 * metres + 1e-6
        assert abs(r["haversine"] - metres) <= 6e-3 * metres + 1e-6
        assert abs(r["staged"] - r["lambert"]) < 1e-9 * (1 + r["lambert"])
