"""Hand-made text cases and TF-IDF properties."""
import math

from pyspark.sql import functions as F

from admitflow.functions import text as T
from admitflow.operators import text as tx


def _clean(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "note_id string, text string")
    out = {r.note_id: r.clean_text for r in tx.cleaned(df).collect()}
    return [out[str(i)] for i in range(len(texts))]


def test_placeholder_becomes_space(spark):
    df = spark.createDataFrame([("a____b",)], "text string")
    assert df.select(T.normalise(F.col("text")).alias("t")).first().t == "a _b"
    # "a" is itself a stop word, so the cleaned text keeps only "_b"
    assert _clean(spark, ["a____b", "x____y"]) == ["_b", "x _y"]


def test_unicode_words_kept_whole(spark):
    assert _clean(spark, ["Été, l'eau"]) == ["été l eau"]
    toks = spark.createDataFrame([("Été, l'eau",)], "text string").select(T.tokens(F.col("text")).alias("t"))
    assert toks.first().t == ["été", "eau"]


def test_stop_words_and_null_give_empty(spark):
    assert _clean(spark, ["the THE a", None]) == ["", ""]


def test_digits_stay_and_newlines_collapse(spark):
    assert _clean(spark, ["Dose 5mg\n\n\nBP 120/80"]) == ["dose 5mg bp 120 80"]


def test_tfidf_zero_vector_for_empty_docs_and_unit_norms(spark):
    df = spark.createDataFrame(
        [("d1", "heart rate heart"), ("d2", "the a"), ("d3", None), ("d4", "rate beat beat beat")],
        "note_id string, text string")
    sparse, vocab = tx.fit_transform(df, vocab_size=3)
    dense = {r.note_id: r.vec for r in tx.densify(sparse, df, 3).collect()}
    assert dense["d2"] == [0.0, 0.0, 0.0] and dense["d3"] == [0.0, 0.0, 0.0]
    for k in ("d1", "d4"):
        assert math.isclose(sum(x * x for x in dense[k]), 1.0, rel_tol=1e-9)
    # idf = ln((1+n)/(1+df)) + 1 with n = 4 documents (empty ones count)
    v = {r.term: (r.term_ix, r.df) for r in vocab.collect()}
    assert sorted(v) == ["beat", "heart", "rate"]
    w_heart, w_rate = 2 * (math.log(5 / 2) + 1), 1 * (math.log(5 / 3) + 1)
    norm = math.hypot(w_heart, w_rate)
    assert math.isclose(dense["d1"][v["heart"][0]], w_heart / norm, rel_tol=1e-9)


def test_vocabulary_tie_smaller_term_wins(spark):
    df = spark.createDataFrame([("d1", "zz yy xx ww ww")], "note_id string, text string")
    _, vocab = tx.fit_transform(df, vocab_size=2)
    # ww has count 2; xx, yy, zz tie at 1: the smaller term (xx) wins the cut
    assert sorted(r.term for r in vocab.collect()) == ["ww", "xx"]
    assert [r.term for r in vocab.orderBy("term_ix").collect()] == ["ww", "xx"]
