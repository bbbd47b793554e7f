import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import packing, sharding
from tidewake.llm.queries import QUERIES


def test_shards_are_whole_even_and_gapless(spark, sf, texts):
    rows = QUERIES["op5_external_shuffle"](spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(40)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert {len(x) for x in slots.values()} <= {len(rows) // 40, len(rows) // 40 + 1}


def test_order_depends_on_the_seed_only(documents):
    places = lambda df, **o: sorted((r.doc_id, r.shard, r.slot) for r in sharding.shuffled(
        df, bucket_bytes=100_000, **o).select("doc_id", "shard", "slot").collect())
    first = places(documents)
    assert places(documents.repartition(7, "lang")) == first
    assert places(documents, seed=1) != first


def test_odd_rows_to_shards(spark, odd, none, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path, shards=4, bucket_bytes=100_000)
    back = spark.read.schema(sharding.written_schema(odd)).parquet(path)
    assert back.count() == 13
    texts = lambda df: sorted(str(r.text) for r in df.select("text").collect())
    assert texts(back) == texts(odd)
    assert back.where("text is null").first()["size"] == 16
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [3, 3, 3, 4]
    assert sharding.shuffled(none).collect() == []


def padding(top, n, total, cuts):
    out, first = 0, 0
    for c in sorted(cuts):
        out += sum(top[c] * n[i] - total[i] for i in range(first, c + 1))
        first = c + 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_the_best(seed):
    rng = np.random.default_rng(seed)
    top = np.sort(rng.choice(np.arange(1, 60), 9, replace=False)).astype(float)
    n = rng.integers(1, 20, 9).astype(float)
    total = top * n
    for k in (1, 2, 3, 4, 12):
        got = packing.best_boundaries(top, n, total, k)
        at = [top.tolist().index(b) for b in got]
        options = [[*c, 8] for m in range(min(k, 9)) for c in itertools.combinations(range(8), m)]
        assert padding(top, n, total, at) == min(padding(top, n, total, c) for c in options)
    assert packing.best_boundaries(top[:0], n[:0], total[:0], 3) == []


def check_batches(rows, budget):
    boundaries = {}
    for r in rows:
        assert 0 <= r.padding == r.boundary - r.length
        boundaries.setdefault(r.bucket, set()).add(r.boundary)
    assert all(len(b) == 1 for b in boundaries.values())
    for bucket, (boundary,) in boundaries.items():
        own = [(r.batch, r.slot) for r in rows if r.bucket == bucket]
        room = max(1, budget // boundary)
        assert sorted(own) == [(i // room, i % room) for i in range(len(own))]
        assert room == 1 or room * boundary <= budget


def test_query_is_whole(spark, sf, texts):
    rows = QUERIES["op3_length_buckets"](spark, sf).collect()
    assert {r.doc_id: r.length for r in rows} == {i: len(t.encode()) + 1 for i, t in texts.items()}
    check_batches(rows, packing.BUDGET)
    for r in rows:  # the narrowest bucket
        assert all(b.boundary >= r.boundary or b.boundary < r.length for b in rows)


def test_padding_is_the_least_of_exact_lengths(documents, monkeypatch):
    lengths = documents.select(F.least(packing.byte_length(), F.lit(900)).alias("length"))
    top, n = zip(*sorted((r.length, r["count"]) for r in lengths.groupBy("length").count().collect()))
    top, n = np.array(top, float), np.array(n, float)
    assert packing.boundaries(lengths, 5) == packing.best_boundaries(top, n, top * n, 5)


def test_odd_rows_to_batches(odd, none, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 3)
    got = packing.assign_batches(odd, buckets=3, budget=1000)
    assert [c for c in got.columns if c not in packing.ADDED] == [
        c for c in odd.columns if c.lower() not in packing.ADDED]
    rows = got.collect()
    assert len(rows) == 13 and {r.length for r in rows if r.text is None} == {1}
    check_batches(rows, 1000)
    assert packing.assign_batches(none).collect() == []
