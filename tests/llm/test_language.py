import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import language
from tidewake.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf, documents):
    got = QUERIES["op1_string_kernel_language"](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = got.join(documents, "doc_id")
    assert got.count() == documents.count()
    assert both.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
    held = both.where("held_out")
    assert held.where("lang_pred = lang").count() / held.count() >= 0.95
    assert both.where("score < 0 or score > 1").count() == 0


def test_weights_are_those_of_kernel_ridge_regression():
    """The product of landmarks and weights scores like the kernels written out."""
    rng = np.random.default_rng(3)
    words = {"a": ["alpha", "anna", "lava"], "b": ["bob", "tobo", "oboe"]}
    sample = [(" ".join(rng.choice(words[k], 6)), k) for k in "ab" for _ in range(10)]
    model = language.fit(sample, landmarks=20, ridge=0.1)
    grams = language.Grams(model.alphabet)
    sets = [set(grams.of(np.frombuffer(t.encode("utf-32-le"), np.uint32))[0].tolist()) for t, _ in sample]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    target = np.array([[1.0 if own == k else -1.0 for k in "ab"] for _, own in sample])
    want = kernel @ np.linalg.solve(kernel + 0.1 * np.eye(len(sets)), target)  # all texts are landmarks
    got = [language._presence([np.array(sorted(s))], model.vocabulary)[0] @ model.weights / np.sqrt(len(s)) for s in sets]
    assert np.allclose(got, want, atol=1e-3)


def test_odd_rows(odd, none):
    model = language.fit([("the cat sat on the mat", "en"), ("das wort ist ein wort", "de")])
    got = {r.doc_id: r for r in language.predicted(odd, model).collect()}
    assert language.predicted(odd, model).count() == 13
    for i in (2, 3, 4, 5):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert (got[1].lang_pred, got[8].lang_pred) == ("en", "de")
    assert language.predicted(none, model).collect() == []
    assert language.fit([]) is None
    assert language.predicted(odd, None).where("lang_pred <> 'und'").count() == 0
    kept = language.in_a_language(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 3, 4, 5)").count() == 0 and kept.count() == 9


def test_sample_is_bounded_and_distinct(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("x").alias("lang"))
    assert language.training_sample(docs, "lang", F.lit(True)) == [("same text", "x")]
    docs = docs.withColumn("text", F.concat(F.lit("text "), F.col("doc_id")))
    assert len(language.training_sample(docs, "lang", F.lit(True), per_label=50)) == 50


def test_sample_is_whole_beside_copies_nulls_and_long_texts(spark):
    """A label of which most rows cannot be learned from still gives as many texts as it has."""
    rows = spark.range(30_000)
    text = (F.when(F.col("id") < 300, F.concat(F.lit("text "), "id")).when(F.col("id") < 10_000, F.lit("a copy"))
            .when(F.col("id") < 29_000, F.lit(None)).otherwise(F.repeat(F.concat(F.lit("x"), "id"), 30)))
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("x").alias("lang"))
    got = language.training_sample(docs, "lang", F.lit(True), per_label=250, longest=100)
    assert len(got) == len(set(got)) == 250
    few = language.training_sample(docs.where("doc_id < 9 or doc_id >= 300"), "lang", F.lit(True), longest=100)
    assert sorted(few) == [("a copy", "x")] + [(f"text {i}", "x") for i in range(9)]


def test_strange_languages_and_gibberish_are_rejected(spark, documents):
    """What was not learned goes; every clean held-out document stays."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    signs = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        " ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(60)),
        "".join(rng.choice(signs, 600)),
    ]
    model = language.learned(documents)
    rows = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert language.in_a_language(rows, model, 0.25).collect() == []
    held = documents.where((language.remainder("doc_id", 4) == 2) & F.col("text").rlike(r"\p{L}"))
    assert language.in_a_language(held, model, 0.25).count() == held.count()
