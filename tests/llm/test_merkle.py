import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewake.llm import merkle

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def proofs(digests, fanout):
    """Root of a list of digests, and per digest the siblings to its left and right on every level."""
    if len(digests) == 1:
        return digests[0], [[]]
    groups = [digests[i:i + fanout] for i in range(0, len(digests), fanout)]
    root, above = proofs([h(*g) for g in groups], fanout)
    return root, [[("".join(g[:i]), "".join(g[i + 1:])), *above[k]] for k, g in enumerate(groups) for i in range(len(g))]


def brute_force(rows, fanout=8):
    if not rows:
        return []
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((leaf(r, r["text"]), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        trees[name] = proofs([d for d, _ in langs[name]], fanout)
    root, above = proofs([trees[n][0] for n in names], fanout)
    out = []
    for n, top in zip(names, above):
        for (own, r), path in zip(langs[n], trees[n][1]):
            path = path + top
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = leaf(r, r["text"].translate(A_TO_Z) if r["text"] is not None and hit else r["text"])
            for left, right in path:
                now = h(left, now, right)
            out.append((r["doc_id"], own, trees[n][0], root, h(*[x for p in path for x in p]), now, now == root))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r))


def test_odd_documents(odd):
    want = brute_force([r.asDict() for r in odd.collect()])
    got = merkle.manifest(odd)
    assert got.columns == [c.split()[0] for c in merkle.RESULT.split(", ")]
    assert sorted_rows(got.collect()) == sorted_rows(want)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 8, 9, 65])
def test_sizes_around_the_fanout(spark, count):
    rows = [(i * 3 % 101, f"Text {i}", "en", "s", i) for i in range(count)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted_rows(merkle.manifest(df).collect()) == sorted_rows(brute_force([r.asDict() for r in df.collect()]))


def test_more_languages_than_the_fanout(spark):
    rows = [(i, f"Text {i}", None if i % 23 == 0 else "" if i % 23 == 1 else f"l{i % 23}é", "s", None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert sorted_rows(merkle.manifest(df).collect()) == sorted_rows(brute_force([r.asDict() for r in df.collect()]))


def test_equal_rows_share_no_partition(spark):
    """A third of the rows are equal: they spread over the range partitions, and each has its own place."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("X y").alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).repartition(4)
    leaves = df.select("doc_id", F.lit("1en").alias("g"), merkle.leaf(F.col("text")).alias("h"),
                       F.monotonically_increasing_id().alias("tie"))
    got = merkle.placed(leaves, "g", "doc_id", "h", "tie").select("doc_id", "pos", "n").collect()
    assert sorted(r.pos for r in got) == list(range(3000)) and {r.n for r in got} == {3000}
    assert {r.pos for r in got if r.doc_id is None} == set(range(1000))
    assert sorted_rows(merkle.manifest(df).collect()) == sorted_rows(brute_force([r.asDict() for r in df.collect()]))


def test_any_change_breaks_the_proof(odd):
    """The siblings of the written tree fold to another root for a leaf that was not in it."""
    before = {r.leaf: r for r in merkle.manifest(odd).collect()}
    changed = odd.withColumn("text", F.when(F.col("doc_id") == 8, F.lit("wort")).otherwise(F.col("text")))
    after = merkle.manifest(changed).collect()
    assert {r.root for r in after}.isdisjoint({r.root for r in before.values()})
