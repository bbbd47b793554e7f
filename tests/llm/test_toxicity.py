import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.llm import language, toxicity
from tidewake.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


TERMS = ["rot", "trash", "loser", "losers", "worthless", "disgusting", "café"]
MACHINE = toxicity.speller(TERMS)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("atsézx"), st.integers(0, 2)),
                                        max_size=3))
def test_automaton_accepts_words_within_the_edits(term, changes):
    word = list(term)
    for at, letter, kind in changes:
        at = min(at, len(word))
        word[at:at + (kind > 0)] = [] if kind == 2 else [letter]
    word = "".join(word) or "q"
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    finder = toxicity.Finder(MACHINE, frozenset())
    found, how = finder.matches(points, np.array([0]), np.array([len(points)]))
    near = [distance(word, t) for t in TERMS if distance(word, t) <= toxicity.edits(t)]
    assert len(found) == bool(near)
    if near:
        assert how[0] == min(1, min(near))


def features(text):
    finder = toxicity.Finder(MACHINE, frozenset({"loner"}))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.expm1(finder.features(points, np.array([0, len(points)]))[0, :6]).round().tolist()


@pytest.mark.parametrize("text,want", [
    ("what trash it is", [1, 0, 0, 0, 0, 0]), ("what \"trash\" it is", [0, 1, 0, 0, 0, 0]),
    ("they called it trash", [0, 1, 0, 0, 0, 0]), ("you LOSER", [0, 0, 1, 0, 0, 0]),
    ("what trassh it is", [0, 0, 0, 1, 0, 0]), ("a loner is here", [0, 0, 0, 0, 0, 0]), ("", [0] * 6),
    ("trash", [1, 0, 0, 0, 0, 0]),
])
def test_context_windows(text, want):
    assert features(text) == want


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op4_spelling_automata"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got.count() == docs.count() and got.where("score < 0 or score > 1").count() == 0
    assert got.where("predicted <> cast(score >= 0.5 as int)").count() == 0
    both = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    assert both.where("predicted = toxic").count() / both.count() >= 0.9


def test_odd_rows(spark, odd, none):
    rows = [(f"{a} trash of {b} all {a}", 1) for a in "abcdefghij" for b in "klmnop"]
    rows += [(f"{a} table of {b} all {a} {b}", 0) for a in "abcdefghij" for b in "klmnop"]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    model = toxicity.fit(sample)
    assert "trash" in toxicity.learned_terms(sample)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(none, model).collect() == []
    assert toxicity.fit(sample.limit(0)) is None and toxicity.fit(sample.where("toxic = 0")) is None
    assert {r.score for r in toxicity.scored(odd, None).collect()} == {0.0}
    bad = spark.createDataFrame([(1, "what trash"), (2, "what a table")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.scored(bad, model).orderBy("doc_id").collect()] == [1, 0]


def test_copies_of_a_toxic_text_make_no_terms(spark):
    rows = [("ordinary words stand in this one " + "z" * (i + 1), 1) for i in range(50)]
    rows += [(f"nothing else {i} at all", 0) for i in range(50)]
    assert "stand" not in toxicity.learned_terms(spark.createDataFrame(rows, "text string, toxic int"))


def test_labels_with_nulls_and_conflicts(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (11, None), (2, 1)], "doc_id long, toxic int")
    got = toxicity.labelled(odd, labels, ~(language.remainder("doc_id", 5) == 9)).collect()
    assert sorted(r.toxic for r in got) == [0, 1]
