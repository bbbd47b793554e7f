import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import maxscore

SCHEMA = "vec_id long, embedding array<double>, score string, RANK string"


def brute_force(rows, k, wanted=lambda i: i % 5 == 0):
    """Best score per pair of ids, whatever the number of their vectors."""
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(1024 * x) for x in v):
            continue
        good.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for own in sorted({i for i, _ in good if wanted(i)}):
        best = {}
        for i, v in good:
            if i != own:
                for j, q in good:
                    if j == own:
                        best[i] = max(best.get(i, -(1 << 200)), sum(a * b for a, b in zip(q, v)))
        best = {i: min(max(s, maxscore.LONG[0]), maxscore.LONG[1]) for i, s in best.items()}
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(own, r + 1, i, s) for r, (i, s) in enumerate(ranked)]
    return out


def result(spark, rows, k=4, **bounds):
    df = spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, maxscore.top(df, F.col("id") % 5 == 0, k, **bounds).collect()))


@pytest.mark.parametrize("kind", ["dense", "positive", "sparse", "ties", "negative"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    v = rng.normal(size=(300, 12))
    v = {"dense": v, "positive": abs(v), "sparse": v * (rng.random(v.shape) < 0.15),
         "ties": np.round(v).clip(-1, 1), "negative": np.vstack([np.abs(v[:5]), -np.abs(v[5:])])}[kind]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert result(spark, rows, shard_cells=500, chunk_cells=200) == brute_force(rows, 4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [-3.0, 0.25]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (5, [1.0, 0.5]),
            (3, None), (4, []), (10, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]),
            (None, [1.0, 0.0]), (15, [0.0, 0.0]), (11, [1e306, 0.0]), (12, [-0.0004, 0.0])]
    assert result(spark, rows, 20) == brute_force(rows, 20)
    assert result(spark, [r for r in rows if r[0] == 0]) == []
    assert result(spark, [r for r in rows if r[0] == 2]) == []
    assert result(spark, [(0, None)]) == []


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e10, 1e200]), (1, [1e10, 0.0]), (2, [3.0, -1e200]), (3, [1e10, 1.0]), (4, [5.0, 0.0])]
    assert result(spark, rows) == brute_force(rows, 4)


def test_a_vector_and_an_id_that_very_many_rows_repeat(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, -1.0]) for i in range(300)] + [(7, rng.normal(size=3).tolist()) for _ in range(300)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    wanted = lambda i: i % 5 == 0 and i > 1200 or i == 5
    df = spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA)
    asked = (F.col("id") == 5) | ((F.col("id") % 5 == 0) & (F.col("id") > 1200))
    got = sorted(map(tuple, maxscore.top(df, asked, 3, shard_cells=400).collect()))
    assert got == brute_force(rows, 3, wanted)


def test_rows_below_the_threshold_are_not_probed():
    """MaxScore leaves rows of non-essential lists alone: few rows are ever probed for the weak terms."""
    rng = np.random.default_rng(5)
    v = np.where(rng.random((2000, 40)) < 0.1, rng.integers(1, 20, (2000, 40)), 0)
    v[:30, 0] = 100_000
    shard = maxscore.Shard(np.arange(2000), list(v.astype(float)), True)
    probed = []
    component = shard.component
    shard.component = lambda rows, d: probed.append(len(rows)) or component(rows, d)
    q = np.ones(40, np.int64)
    score, ids = shard.search(-1, q, 10)
    want = sorted(((-int(s), i) for i, s in enumerate(v.sum(1))))[:10]
    assert list(zip((-score).tolist(), ids.tolist())) == want
    assert max(probed) <= 40
