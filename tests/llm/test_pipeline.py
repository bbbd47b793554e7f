import re

from pyspark.sql import functions as F

import corpus_pipeline
from test_decontamination import brute
from test_forest import components
from test_pii_secrets import personal
from tidewake.llm.packing import ADDED


def test_stages_one_by_one(spark, sf, documents, texts, tmp_path):
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs, have = documents, dict(texts)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(got)
        if name == "language ID":
            want = {i for i, t in have.items() if re.search(r"[^\W\d_]", t)}
            assert got.keys() == want
        if name == "near-dedup":
            links = components(have, 5)
            assert got.keys() == {i for i in have if links[i][1] == i}
        if name == "decontamination":
            assert got.keys() == have.keys() - {d for d, _ in brute(have, tests)}
        if name == "PII":
            assert got.keys() == have.keys()
            assert not any(personal(t) for t in got.values())
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
            assert all(got[i] == have[i] for i in have if not re.search("[@0-9]", have[i]))
        if i < 4:
            assert docs.columns == documents.columns
        else:
            assert got == have and set(ADDED) <= set(docs.columns)
        have = got


def test_odd_and_empty_documents(spark, sf, odd, none):
    for docs, least in ((odd, 5), (none, 0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            if name != "packing":
                assert docs.columns == columns
        assert docs.count() >= least


def test_a_corpus_without_any_label_keeps_its_texts(spark, sf, documents):
    """Nothing can be learned, so nothing is rejected but texts without letters."""
    docs = documents.withColumn("lang", F.lit(None).cast("string")).union(
        spark.createDataFrame([(-1, "123 !", None, "s", 5), (-2, None, None, "s", 0), (-3, "слово", None, "s", 5)], documents.schema))
    got = {r.doc_id for r in corpus_pipeline.identify(spark, docs, sf).select("doc_id").collect()}
    want = {r.doc_id for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert got == want and -3 in got
