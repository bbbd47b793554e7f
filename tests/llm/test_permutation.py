import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import permutation
from tidewake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label string, score string"


def exact(ids, vectors, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -9
        out[int(ids[i])] = set(ids[np.lexsort((ids, -s))[:k]].tolist())
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = QUERIES["op7_permutation_index"](spark, folder).collect()
    want = exact(ids, v)
    found = {q: set() for q in want}
    by_id = dict(zip(ids.tolist(), v))
    for r in got:
        found[r.query_id].add(r.vec_id)
        a, b = by_id[r.query_id], by_id[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, i) for q in sorted(want) for i in range(1, 6)]
    assert np.mean([len(found[q] & want[q]) / 5 for q in want]) >= 0.9


def test_recall_in_several_blocks_and_chunks(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, x.tolist(), None, None) for i, x in enumerate(v)], SCHEMA)
    got = permutation.nearest(df, F.col("id") % 50 == 0, block_rows=500).collect()
    want = exact(np.arange(3000), v.astype(np.float32).astype(float))
    assert len(got) == 300
    assert sum(r.vec_id in want[r.query_id] for r in got) / len(got) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (50, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "l", "s") for r in rows], SCHEMA)
    got = sorted(map(tuple, permutation.nearest(df, F.col("id") % 50 == 0).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0)]
    assert permutation.nearest(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert permutation.nearest(df.where("vec_id in (4, 5)"), F.col("id") % 50 == 0).collect() == []


def test_a_vector_that_very_many_rows_repeat(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(2000)] + [(2000 + i, [float(i % 7), 1.0, float(i % 11)]) for i in range(500)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = permutation.nearest(df, F.col("id") == 50, block_rows=300).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("distinct,seed", [(10, 0), (10, 1), (5, 2), (1, 3)])
def test_few_distinct_vectors_repeated_very_often(spark, distinct, seed):
    """All of them are pivots, and each query finds the first copies of itself."""
    v = np.random.default_rng(seed).normal(size=(distinct, 8))
    rows = [(i, v[i * distinct // 20_000].tolist(), None, None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, score string")
    assert len(permutation.pivots(permutation.usable(df, "vec_id", "embedding"))) == distinct
    got = permutation.nearest(df, F.col("id") % 500 == 7, block_rows=5000).collect()
    own = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        own.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(7, 20_000, 500):
        first = q * distinct // 20_000 * (20_000 // distinct)
        assert own[q] == [i for i in range(first, first + 6) if i != q][:5]


def test_repeated_rows_and_ids_count_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += rows + [(0, rng.normal(size=6).tolist()), (7, rows[0][1]), (7, rng.normal(size=6).tolist())]
    got = permutation.nearest(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), F.col("id") % 20 == 0)
    unit = {}
    for i, v in rows:
        v = np.array(v, np.float32).astype(float)
        unit.setdefault(i, []).append(v / np.linalg.norm(v))
    for q in (0, 20):
        best = {i: max(a @ b for a in unit[q] for b in unit[i]) for i in unit if i != q}
        mine = sorted((r for r in got.collect() if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == sorted(best, key=lambda i: (-best[i], i))[:5]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in mine], [best[r.vec_id] for r in mine])


def test_tiny_and_huge_components(spark):
    schema = SCHEMA.replace("float", "double")
    rows = [(0, [1e-200, 2e-200]), (1, [2e300, 4e300]), (2, [5e-324, 0.0]), (3, [1e308, -1e308])]
    got = permutation.nearest(spark.createDataFrame([(*r, None, None) for r in rows], schema), F.col("id") == 0).collect()
    assert [(r.vec_id, round(r.score, 12)) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 1.0), (2, round(1 / 5 ** 0.5, 12)), (3, round(-1 / 10 ** 0.5, 12))]


def test_gain_is_what_the_footrule_is_short_of():
    rng = np.random.default_rng(0)
    a, b = (rng.permutation(20)[:8].tolist() for _ in range(2))
    place = lambda x, p: x.index(p) if p in x else 8
    footrule = sum(abs(place(a, p) - place(b, p)) for p in {*a, *b})
    gain = sum(8 - max(a.index(p), b.index(p)) for p in {*a} & {*b})
    assert footrule == 2 * sum(range(1, 9)) - 2 * gain
