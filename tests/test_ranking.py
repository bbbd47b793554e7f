import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import ranking as rk
from tidewake.operators.quality import latency_ranks


def samples():
    rng = random.Random(4)
    return {
        "uniform": [rng.uniform(0, 600) for _ in range(1001)],
        "hot": [5.25] * 700 + [rng.uniform(0, 10) for _ in range(300)],
        "constant": [3.0] * 10,
        "one": [7.5],
        "two": [1.0, 2.0],
        "wide": [10 ** rng.uniform(-300, 300) for _ in range(500)] + [0.0, -1e300, 1e-310],
        "close": [1.0 + i * 2.0**-52 for i in range(200)] + [1e9],
        "cents": [rng.randrange(0, 2500) / 100 for _ in range(3000)],
    }


@pytest.mark.parametrize("name", samples())
def test_index_ranks_equal_sorting(spark, name):
    values = samples()[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "latency double").repartition(3)
    got = {r.rank_name: r.value for r in latency_ranks(df).collect()}
    ordered = sorted(values)
    assert got == {"p50": ordered[len(values) // 2], "p95": ordered[int(len(values) * 0.95)]}


@pytest.mark.parametrize("name", ["uniform", "hot", "one", "two", "cents"])
def test_median_interpolates(spark, name):
    values = sorted(samples()[name])
    n = len(values)
    want = (values[(n - 1) // 2] + values[n // 2]) / 2
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert rk.interpolated(df, "v", 0.5).first()[0] == pytest.approx(want, abs=1e-12)
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    assert rk.interpolated(counts, "v", 0.5, "n").first()[0] == pytest.approx(want, abs=1e-12)


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,)], "latency double")
    assert latency_ranks(df).collect() == []
    assert rk.interpolated(df, "latency", 0.5).first()[0] is None


def test_ordered_bits_are_those_of_the_format(spark):
    import struct

    rng = random.Random(9)
    values = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1.0,
              0.9999999999999999, 2.0, 1.9999999999999998]
    values += [2.0**e for e in range(-1074, 1024)] + [2.0**e * (2 - 2**-52) for e in range(-1022, 1023)]
    values += [struct.unpack("d", struct.pack("q", rng.getrandbits(63)))[0] for _ in range(5000)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for x in values for v in (x, -x)], "v double")
    for r in rk.with_ordered_bits(df, "v").collect():
        bits = struct.unpack("q", struct.pack("d", abs(r.v)))[0]
        assert r.bits == (-bits if r.v < 0 else bits), r
    nan = rk.with_ordered_bits(spark.createDataFrame([(float("nan"),)], "v double"), "v").first().bits
    assert nan > struct.unpack("q", struct.pack("d", float("inf")))[0]


@pytest.mark.parametrize("many", [True, False])
def test_negative_and_infinite_values(spark, monkeypatch, many):
    if many:  # settle a digit more
        seen = type("Seen", (), {"get": {"n": 1 << 30}})
        monkeypatch.setattr(rk, "counted", lambda df: (df, seen))
    rng = random.Random(3)
    values = [rng.uniform(-5, 5) for _ in range(300)] + [float("-inf"), float("inf"), -0.0, 0.0, 1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    ranks = {str(k): F.lit(k) for k in (0, 1, 2, 150, 151, 152, 303, 304, 305)}
    got = {r.k: r.value for r in rk.rank_select(df, "v", ranks).collect()}
    assert got == {int(k): sorted(values)[int(k)] for k in ranks}


def test_the_input_is_scanned_twice(spark, tmp_path):
    """Two scans in all, whatever the values; the rest works on the slots that hold a rank."""
    df = spark.range(50_000).select((F.rand(3) * 1000).alias("latency"))
    df.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    seen = []
    original = type(stored).collect

    def spy(self):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return original(self)

    type(stored).collect = spy
    try:
        got = {r.rank_name: r.value for r in latency_ranks(stored).collect()}
    finally:
        type(stored).collect = original
    values = sorted(r.latency for r in stored.collect())
    assert got == {"p50": values[25_000], "p95": values[47_500]}
    assert sum(str(tmp_path) in plan for plan in seen) == 1  # and once more in the write of the slots


def test_plan_is_flat(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "latency double")
    plan = latency_ranks(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Subquery" not in plan
