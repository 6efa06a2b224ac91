"""Stores, prediction files, embeddings, streaming, the driver contract."""
import os

from pyspark.sql import functions as F

from admitflow.operators import embedding
from admitflow.sources import sinks, tables


def test_vector_store_last_write_wins_and_roundtrip(spark, tmp):
    v = spark.createDataFrame([("n1", [1.0, 2.0], 1), ("n1", [3.0, 4.0], 2), ("n2", [5.0, 6.0], 1)],
                              "note_id string, vec array<double>, row_ix long")
    path = sinks.write_vectors(v, os.path.join(tmp, "vecs"), order="row_ix")
    back = {r.note_id: r.vec for r in tables.read_vectors(spark, path).collect()}
    assert back == {"n1": [3.0, 4.0], "n2": [5.0, 6.0]}
    ids = spark.createDataFrame([("n2",)], "note_id string")
    assert [r.note_id for r in tables.read_vectors(spark, path, ids).collect()] == ["n2"]


def test_stats_are_fitted_once_then_read(spark, tmp):
    calls = []

    def fit():
        calls.append(1)
        return spark.createDataFrame([([1.0], [2.0], 3)], "mean array<double>, std array<double>, n long")
    p = os.path.join(tmp, "stats")
    a = sinks.get_or_fit_stats(spark, p, fit).first()
    b = sinks.get_or_fit_stats(spark, p, fit).first()
    assert calls == [1] and a == b


def test_prediction_files_skip_ensemble_and_keep_order(spark, tmp):
    folder = os.path.join(tmp, "results")
    os.makedirs(folder)
    for name, scores in [("m0", [0.1, 0.2]), ("m1", [0.3, 0.5]), ("ensemble_result", [9.0, 9.0])]:
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write("id,readmitted_within_30days\n" + "".join(f"{i},{s}\n" for i, s in zip(["a", "b"], scores)))
    preds = tables.read_prediction_files(spark, folder)
    assert sorted(r.model_id for r in preds.select("model_id").distinct().collect()) == ["m0", "m1"]
    test = spark.createDataFrame([("b", 2), ("a", 1)], "id string, row_ix long")
    from admitflow.operators import modeling
    mean = modeling.ensemble_mean(preds).join(test, "id")
    out = sinks.write_predictions(mean, os.path.join(tmp, "out"))
    back = spark.read.csv(out, header=True).collect()
    assert [r.id for r in back] == ["a", "b"]
    assert [round(float(r.readmitted_within_30days), 6) for r in back] == [0.2, 0.35]


def test_pending_and_token_mean(spark):
    new = spark.createDataFrame([("n1", "heart rate"), ("n2", "rate rate")], "note_id string, text string")
    done = spark.createDataFrame([("n1",)], "note_id string")
    assert [(r.note_id, r.text) for r in embedding.pending(new, done).collect()] == [("n2", "rate rate")]
    tv = spark.createDataFrame([("heart", [1.0, 0.0]), ("rate", [0.0, 2.0])], "token string, vec array<double>")
    got = {r.note_id: r.vec for r in embedding.token_mean(new, tv).collect()}
    assert got == {"n1": [0.5, 1.0], "n2": [0.0, 2.0]}
    user = embedding.embed_with(new, lambda texts: [[float(len(t))] for t in texts], 1)
    assert {r.note_id: r.vec for r in user.collect()} == {"n1": [10.0], "n2": [9.0]}


def test_incremental_stream_embeds_only_new_notes(spark, tmp):
    from admitflow.streaming.incremental import run_incremental
    src = os.path.join(tmp, "incoming")
    store = os.path.join(tmp, "store")
    spark.createDataFrame([("n1", "heart rate"), ("n2", "rate")], "note_id string, text string") \
        .write.mode("overwrite").parquet(os.path.join(src, "batch=1"))
    tv = spark.createDataFrame([("heart", [1.0]), ("rate", [3.0])], "token string, vec array<double>")
    run_incremental(spark, src, store, tv, os.path.join(tmp, "ckpt"))
    spark.createDataFrame([("n1", "heart"), ("n3", "heart heart")], "note_id string, text string") \
        .write.mode("overwrite").parquet(os.path.join(src, "batch=2"))
    run_incremental(spark, src, store, tv, os.path.join(tmp, "ckpt"))
    got = {r.note_id: r.vec for r in spark.read.parquet(store).collect()}
    assert got == {"n1": [2.0], "n2": [3.0], "n3": [1.0]}


def test_driver_contract(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.columns == ["note_id", "term_ix", "value"] and df.count() > 0
    assert E.queries()["clean_labels"](spark, "/root/testdata/sf0.001").count() > 0
