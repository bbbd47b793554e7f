import random
import re

import numpy as np
import pytest

from tidewake.llm import crowds, forest, graph
from tidewake.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def components(texts, k, percent=80):
    """doc_id -> (set size, smallest linked id), by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_all_pairs(spark, sf, texts):
    got = QUERIES["op10_lsh_forest"](spark, sf)
    assert result(got) == components(texts, 4)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def varied(rng, n, words=60, edits=6):
    """Copies of one text with up to ``edits`` changed words."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        one = list(base)
        for _ in range(rng.randrange(edits + 1)):
            one[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(one))
    return out


@pytest.mark.parametrize("crowd,near", [(16, 8), (3, 2)])
def test_crowded_regions_and_seams(spark, monkeypatch, crowd, near):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    many = varied(rng, 120) + varied(rng, 30, 12, 2) + [f"{passage} {' '.join(varied(rng, 1, 25))}" for _ in range(60)]
    many += ["same words here again and again"] * 20
    texts = dict(enumerate(many))
    monkeypatch.setattr(forest, "CROWD", crowd)
    monkeypatch.setattr(forest, "NEAR", near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert result(forest.near_duplicates(docs, 4)) == components(texts, 4)


def family(rng, n, close, words=100, kept=80):
    """Sets of 80 words of one template of 100, few of them linked, and ``close`` partners with 8 other words: 0.818."""
    template = [f"t{i}" for i in range(words)]
    out = [rng.sample(template, kept) for _ in range(n)]
    for one in out[:close]:
        out.append(one[8:] + rng.sample(sorted(set(template) - set(one)), 8))
    return [" ".join(x) for x in out]


def test_pairs_within_a_template_family(spark):
    """A crowd of sets that are not linked hides no link between two of them."""
    texts = dict(enumerate(family(random.Random(8), 400, 60)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert result(forest.near_duplicates(docs, 1)) == components(texts, 1)


def exact_links(sets, component, percent):
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if component[a] != component[b]
            and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


@pytest.mark.parametrize("most", [20_000, 7])
def test_prefixes_lose_no_link(spark, monkeypatch, most):
    """Sets of many sizes around the threshold, in lists of one and of several parts."""
    rng = random.Random(4)
    sets, component = {}, {}
    for i in range(150):
        old = sets[rng.randrange(i)] if i and rng.random() < 0.7 else set(rng.sample(range(400), rng.randrange(1, 60)))
        lost = rng.sample(sorted(old), rng.randrange(1 + len(old) // 5))
        sets[i] = (old - set(lost)) | set(rng.sample(range(400), rng.randrange(1 + len(old) // 6)))
        component[i] = rng.randrange(60)
    monkeypatch.setattr(crowds, "LIST", most)
    monkeypatch.setattr(crowds, "COMMON", 2)
    rows = [(i, component[i], np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()]
    df = spark.createDataFrame([(i, c, bytearray(f)) for i, c, f in rows], "id long, component long, full binary").repartition(3)
    got = {tuple(r) for r in crowds.candidates(df, 80).collect()}
    want = exact_links(sets, component, 80)
    assert want and want <= got and len(got) < 150 * 149 / 8


def test_a_family_of_thousands_makes_few_pairs(spark, monkeypatch):
    """2000 sets of one template at a similarity of 0.66 and 300 at 0.9: no operator gives out rows by the square."""
    rng = random.Random(1)
    template = [f"t{i}" for i in range(150)]
    texts = {}
    for i in range(2300):
        one = list(template)
        for at in rng.sample(range(150), 4 if i < 300 else 30):
            one[at] = f"x{rng.randrange(10**9)}"
        texts[i] = " ".join(one)
    seen = []
    monkeypatch.setattr(forest.crowds, "candidates", lambda df, percent, f=forest.crowds.candidates: (
        lambda out: seen.append(out.count()) or out)(f(df, percent)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in forest.near_duplicates(docs, 1).collect()}
    assert [found[i] for i in range(300)] == [0] * 300 and all(found[i] == i for i in range(300, 2300))
    assert seen[0] < 5_000


def test_odd_rows(odd, none):
    got = forest.near_duplicates(odd, 4).collect()
    assert len(got) == 13
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by_id[6].component_id, by_id[6].kept, by_id[1].kept) == (1, False, True)
    assert (by_id[12].component_id, by_id[12].n_shingles) == (11, 1)  # fewer words than a shingle
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (2, 3, 4))
    assert by_id[8].n_shingles == by_id[9].n_shingles == 1
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert forest.near_duplicates(none, 4).collect() == []
    kept = forest.one_of_each(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 2, 3, 4, 5, None, 8, 9, 10, 11]))
    assert forest.one_of_each(odd).columns == odd.columns


def test_repeated_rows_are_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in forest.one_of_each(docs).collect()) == [1, 2]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    sign = forest.signatures(np.concatenate(sets), np.array([0, len(sets[0])]))
    assert abs((sign[0] == sign[1]).mean() - 0.8) < 0.15
    assert forest.enough(0.8) < 128 * 0.85


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(2)
    names = list(range(400))
    rng.shuffle(names)
    edges = list(zip(names[:150], names[1:150])) + [(names[200], x) for x in names[201:300]] + [(7_000, 7_000)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {x: min(names[:150]) for x in names[:150]} | {x: min(names[200:300]) for x in names[200:300]}
    assert got == want
