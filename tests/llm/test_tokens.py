import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewake.llm import tokens
from tidewake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = st.lists(st.sampled_from(["a", "s", "t", "re", "ve", "ll", "'", " ", "  ", "\n", "\t", "1", "²", "é", "漢", "!",
                                   "　", "🙂", "́", "'s", "X", "\x85"]) | st.characters(exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=4))
def test_pretokens_are_those_of_the_library(several):
    several = ["".join(s) for s in several]
    points = np.frombuffer("".join(several).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in several])]).astype(np.int64)
    begins = tokens.pretokens(points, at, tokens.classes(PATH)[points]).tolist()
    want = [int(a) + cut[0] for s, a in zip(several, at) for _, cut in LIBRARY.pre_tokenizer.pre_tokenize_str(s)]
    assert begins == want


def counted(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_query_counts_like_the_library(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert (got[i].n_bytes, got[i].n_tokens) == (len(text.encode()), counted(text))
        assert got[i].over_limit == (got[i].n_tokens > 512)


def test_odd_rows(odd, none):
    want = sorted((str(r.doc_id), len((r.text or "").encode()), counted(r.text)) for r in odd.collect())
    got = tokens.token_counts(odd, PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert tokens.token_counts(none, PATH).collect() == []


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext"])
def test_special_strings(spark, text):
    got = tokens.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert got.n_tokens == counted(text)


def test_small_blocks_and_spread_words_change_nothing(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(tokens, "CROWDED", 8)
    monkeypatch.setattr(tokens, "FLUSH", 100)
    monkeypatch.setattr(tokens, "BLOCK", 20_000)  # some texts are cut
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents, PATH).collect()}
    assert got == {i: counted(t) for i, t in texts.items()}


def test_counts_beyond_a_byte(spark):
    text = " the" * 1000
    got = tokens.token_counts(spark.createDataFrame([(1, text), (2, "the")], "doc_id long, text string"), PATH)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {1: counted(text), 2: 1}
