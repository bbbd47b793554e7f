import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, RANK string"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least):
    docs = [((r["lang"] or ""), (r["source"] or ""), [w.translate(A_TO_Z) for w in re.findall(
        r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r["text"] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= least}
        groups = {s: Counter(w for d in own if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in own}}
        p = {s: lambda w, c=c: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for s, c in groups.items()}
        whole = Counter(w for c in groups.values() for w in c.elements())
        q = lambda w: 1 + 10**9 * (whole[w] + 5) // (sum(whole.values()) + 5 * len(kept))
        for s, c in groups.items():
            pairs = [(-sum(abs(p[s](w) - p[o](w)) for w in kept), o.encode()) for o in groups if o != s]
            terms = [(q(w) - p[s](w), w.encode()) for w in c if p[s](w) > q(w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out += [(lang, s, part, i.decode(), -v, n) for n, (v, i) in enumerate(found, 1)]
    return sorted(out)


def made(spark, count, sources, words, seed=1):
    """Texts of skewed words over many sources; the first source has a third of all."""
    out = []
    x = seed
    for i in range(count):
        text = []
        for _ in range(12):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            text.append(f"{'Wé'[x >> 40 & 1]}{chr(97 + (x >> 33) % words % 26)}{'é' * ((x >> 50) % words // 26)}")
        out.append((i, "-1 ".join(text), ["en", "de", None, ""][x >> 20 & 3], None if i % 3 == 0 else f"s{(x >> 12) % sources}", 1, "i", "r"))
    return spark.createDataFrame(out, SCHEMA).repartition(4)


@pytest.mark.parametrize("groups,terms", [(16, 2048), (3, 7), (1, 1)])
def test_against_brute_force_in_cells_of_any_size(spark, groups, terms):
    df = made(spark, 400, 7, 120)
    want = brute_force([r.asDict() for r in df.collect()], 5)
    got = divergence.audit(df, 5, groups, terms)
    assert got.dtypes == [tuple(f.replace("long", "bigint").split()) for f in divergence.RESULT.replace("rank int", "rank int").split(", ")]
    assert sorted(map(tuple, got.collect())) == want
    assert len([r for r in want if r[2] == "pair"]) > 50 and len([r for r in want if r[2] == "term"]) > 50


@pytest.mark.parametrize("least", [1, 2, 30])
def test_odd_documents(odd, least):
    want = brute_force([r.asDict() for r in odd.collect()], least)
    assert sorted(map(tuple, divergence.audit(odd, least).collect())) == want
    assert any(r[2] == "pair" for r in want)


def test_empty(none):
    assert divergence.audit(none).collect() == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Wort " * 50 + "x" * 300 + " " + "é" * 200 + ", Ende").encode()
    whole = Counter(w for piece in divergence.terms_of(text) for w in piece)
    monkeypatch.setattr(divergence, "PIECE", 64)
    pieces = list(divergence.terms_of(text))
    assert len(pieces) > 3 and Counter(w for piece in pieces for w in piece) == whole
    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_pylist([{"lang": "de", "source": None, "text": text.decode()}] * 3)
    rows = [r for b in divergence.counted(iter([batch])) for r in b.to_pylist()]
    assert sum(r["docs"] for r in rows if r["term"] == "wort") == 3 and sum(r["count"] for r in rows if r["term"] == "wort") == 150


def test_probability_is_exact_for_large_counts():
    import numpy as np

    count, total, kept = np.array([10**13, 7, 0]), np.array([10**14 + 3] * 3), 12345
    want = [1 + 10**9 * (c + 5) // (10**14 + 3 + 5 * kept) for c in count.tolist()]
    assert divergence.probabilities(count, total, kept).tolist() == want


def test_one_source_may_hold_most_rows(spark):
    df = made(spark, 300, 2, 30).withColumn("source", F.when(F.col("doc_id") % 10 < 9, "big").otherwise(F.col("source")))
    assert sorted(map(tuple, divergence.audit(df, 3).collect())) == brute_force([r.asDict() for r in df.collect()], 3)
