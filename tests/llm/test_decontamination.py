import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewake.llm import decontamination as dc
from tidewake.llm.queries import QUERIES


def items(rng, n, words):
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9, 40)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_scoring_every_item(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    index = dc.Index(items(rng, 60, words))
    for _ in range(40):
        passage = rng.sample(words, rng.randrange(5, 60))
        if rng.random() < 0.5:
            passage += items(rng, 60, words)[3][1].split()[:20]
        terms = np.unique(index.places(dc.hashes_of(" ".join(passage))))
        terms = terms[terms >= 0]
        score = Counter()
        for t in terms:
            for piece, share in index.postings[t]:
                score[piece] += share
        for least in (0.15, 0.3, 0.5):
            want = {int(index.item[p]) for p, s in score.items() if s >= least - 1e-9}
            assert index.search(terms, least) == want
            passing = index.passing(np.zeros(len(terms), np.int64), terms, 1, least)
            assert len(passing) == 1 or not want


def test_shares_are_bm25_over_the_own_score():
    texts = ["red red blue green house tree lake moon", "blue lake fire stone wind rain snow hail"]
    index = dc.Index(list(enumerate(texts)))
    n, mean = 2, 8.0

    def weight(f, df, length):
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * f * (dc.K1 + 1) / (f + dc.K1 * (1 - dc.B + dc.B * length / mean))

    # red twice and four other words of this item alone, blue and lake of both
    own = weight(2, 1, 8) + 4 * weight(1, 1, 8) + 2 * weight(1, 2, 8)
    red = index.places(dc.hashes_of("red"))[0]
    assert math.isclose(index.postings[red][0][1], weight(2, 1, 8) / own, rel_tol=1e-9)


def brute(texts, tests, share=0.6):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parts = {i: [grams(norm(p)) for p in dc.question_and_answer(t)] for i, t in tests if len(norm(t)) >= dc.SHORTEST}
    out = set()
    for d, t in texts.items():
        words = norm(t)
        own = {k: {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} for k in range(1, 6)}
        for i, two in parts.items():
            if all(not p or sum(g in own[len(g)] for g in p) >= share * len(p) for p in two):
                out.add((d, i))
    return out


def test_query_equals_brute_force(spark, sf, texts):
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_block_max_wand"](spark, sf).collect()}
    assert got == brute(texts, tests) and got


def test_leak_anywhere_in_a_long_text(spark):
    rng = random.Random(4)
    own = [f"t{i}" for i in range(45)]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    docs = [(i, " ".join(noise(at) + own + noise(500 - at))) for i, at in enumerate(range(0, 500, 37))]
    docs += [(100, " ".join(noise(500))), (101, " ".join(own[:15] + noise(300))), (102, None), (103, "")]
    edited = own[:20] + ["changed"] + own[21:]
    docs.append((104, " ".join(noise(100) + edited + noise(100))))
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame([(7, " ".join(own)), (8, None), (9, "too short")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, 7) for i in range(14)} | {(104, 7)}


def test_several_indexes_find_the_same(spark, sf, documents, monkeypatch):
    tests = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, dc.leaks(documents, tests).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(dc, "INDEX_WORDS", 500)
    assert sorted(map(tuple, dc.leaks(documents, tests).select("doc_id", "item_id").collect())) == want


def test_odd_rows(spark, odd, none):
    tests = spark.createDataFrame([(1, "The cat sat on the mat. It looked at the other cat."),
                                   (2, "cat sat on the mat and looked at the other cat for a while")],
                                  "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in dc.leaks(odd, tests).collect())
    assert got == [(1, 2), (6, 2), (6, 2)]
    assert dc.leaks(none, tests).collect() == [] and dc.leaks(odd, tests.limit(0)).collect() == []


def test_one_word_edits_at_every_place(spark, sf):
    """A changed, added or left out word anywhere, or a missing short last sentence, hides no item."""
    rng = random.Random(9)
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    noise = " ".join(f"n{rng.randrange(10**6)}" for _ in range(30))
    docs, want = [], set()

    def put(item, words):
        want.add((len(docs), item))
        docs.append((len(docs), f"{noise} {' '.join(words)} {noise}"))

    for item, text in tests:
        words = text.split()
        for at in range(len(words)):
            edited = [["changed"], ["added", words[at]], []][at % 3 if len(docs) % 2 else 0]
            put(item, words[:at] + edited + words[at + 1:])
        question, answer = dc.question_and_answer(text)
        if len(answer.split()) < min(10, len(question.split())) and len(question.split()) >= 8:
            put(item, question.split())
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                   spark.createDataFrame(tests, "item_id long, text string"))
    assert want <= {(r.doc_id, r.item_id) for r in got.collect()} and len(want) > 1000


def test_more_edits_are_another_text(spark):
    item = [f"t{i}" for i in range(20)]
    twice = item[:3] + ["x"] + item[4:8] + ["y"] + item[9:12] + ["z"] + item[13:17] + ["v"] + item[18:]
    docs = spark.createDataFrame([(1, " ".join(twice)), (2, " ".join(item[::-1]))], "doc_id long, text string")
    assert dc.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect() == []


def test_short_items_are_found_where_all_their_words_are(spark):
    docs = [(1, "So who wrote it? Nobody knows."), (2, "They asked who"), (3, "wrote it down"), (4, "who never wrote it"),
            (5, "WHO WROTE-IT"), (6, "a b c d e f g"), (7, "a b c d e f x"), (8, None), (9, "Paris")]
    items = [(1, "Who wrote it?"), (2, "who wrote it"), (3, "a b c d e f g"), (4, "paris"), (5, "?!"), (6, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect())
    assert got == [(1, 1), (1, 2), (5, 1), (5, 2), (6, 3), (9, 4)]


def test_scripts_without_spaces(spark):
    long, short = "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待", "月亮有多远"
    thai = "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกัน"
    docs = [(1, f"前面的话。{long}后面的话。"), (2, f"请问{short}呢"), (3, "月亮不远"), (4, f"ก่อน{thai}หลัง"),
            (5, long[::-1]), (6, "人人生 而自由"), (7, f"mixed{short}text")]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame([(1, long), (2, short), (3, thai)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (2, 2), (4, 3), (7, 2)]


def test_a_stretch_that_fails_does_not_hide_one_that_passes(spark):
    rng = random.Random(6)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    question, answer = [f"q{i}" for i in range(44)], [f"a{i}" for i in range(24)]
    item = f"{' '.join(question)}. {' '.join(answer)}."
    fails = " ".join(question + answer[:14] + ["x", "y"])  # 1.0 and 10 of 20
    passes = " ".join(question[:32] + ["x"] + question[33:34] + ["y"] * 10 + answer[:18])  # 28 of 40 and 14 of 20
    for order in ([fails, passes], [passes, fails]):
        docs = [(1, f" {noise(900)} ".join(order)), (2, fails), (3, passes)]
        got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
        assert sorted((r.doc_id, r.question_overlap, r.answer_overlap) for r in got) == [(1, 0.7, 0.7), (3, 0.7, 0.7)]
