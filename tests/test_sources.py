"""Label, note and prediction files: by name, nothing lost, sink to source."""
import os

import pytest
from pyspark.sql import functions as F

from admitflow.operators import embedding, modeling, notes
from admitflow.operators.ordered import with_global_index, with_rank_within, with_running_sums
from admitflow.sources import sinks, tables


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_labels_by_name_and_value(spark, tmp):
    path = write(tmp, "train.csv", "row,readmitted_within_30days,id\n1,1.0,a_1\n2,0.0,a_2\n3,,a_3\n4, 1 ,a_4\n")
    got = [(r.id, r.label) for r in tables.read_label_csv(spark, path).collect()]
    assert got == [("a_1", 1), ("a_2", 0), ("a_3", None), ("a_4", 1)]
    assert [r.id for r in tables.read_id_csv(spark, path).collect()] == ["a_1", "a_2", "a_3", "a_4"]


@pytest.mark.parametrize("value", ["yes", "0.5"])
def test_bad_labels_fail(spark, tmp, value):
    path = write(tmp, "train.csv", f"id,readmitted_within_30days\na,{value}\n")
    with pytest.raises(Exception, match="readmitted_within_30days"):
        tables.read_label_csv(spark, path).collect()


def test_missing_column_fails(spark, tmp):
    with pytest.raises(ValueError, match="no column id"):
        tables.read_id_csv(spark, write(tmp, "t.csv", "ID2,x\n1,2\n"))


def test_notes_by_name(spark, tmp):
    path = write(tmp, "notes.csv", 'text,n,note_seq,hadm_id,subject_id,id\n"two\nlines, ""q""",1,2,h,s,s_1\n,2,x,h,s,s_2\n')
    rows = tables.read_notes_csv(spark, path).collect()
    assert [(r.id, r.subject_id, r.hadm_id, r.note_seq, r.text) for r in rows] == [
        ("s_1", "s", "h", "2", 'two\nlines, "q"'), ("s_2", "s", "h", "x", None)]


def test_prediction_sinks_read_back(spark, tmp):
    preds = lambda k: spark.createDataFrame([("a", 0.1 * k, 1), ("b", 0.2 * k, 2)], "id string, score double, row_ix long")
    for k in (1, 3):
        sinks.write_predictions(preds(k), f"{tmp}/m{k}.csv")
    sinks.write_ensemble(preds(9), tmp)
    got = sorted((r.model_id, r.id, round(r.score, 6)) for r in tables.read_prediction_files(spark, tmp).collect())
    assert got == [("m1", "a", 0.1), ("m1", "b", 0.2), ("m3", "a", 0.3), ("m3", "b", 0.6)]
    with pytest.raises(FileNotFoundError):
        tables.read_prediction_files(spark, tmp + "/none")


def test_store_roundtrips(spark, tmp):
    n = spark.createDataFrame([("s_1", "s", "h", " 7 "), ("s_2", "s", "h", "4000000000"), ("s_3", "s", "h", "2.0")],
                              "note_id string, subject string, hadm string, note_seq string")
    back = spark.read.parquet(sinks.write_note_labels(notes.note_labels(n), tmp + "/labels"))
    assert {r.note_id: r.note_seq for r in back.collect()} == {"s_1": 7, "s_2": 4000000000, "s_3": -1}
    more = n.select("note_id", "subject").union(spark.createDataFrame([("s_9", "s")], "note_id string, subject string"))
    assert {r.note_id: r.note_seq for r in notes.with_labels(more, back).collect()} == {"s_1": 7, "s_2": 4000000000, "s_3": -1, "s_9": -1}
    days = spark.createDataFrame([("a", 0, [1.0, 2.0])], "id string, day_idx int, features array<double>")
    days.write.parquet(tmp + "/days")
    assert tables.read_sequences(spark, tmp + "/days").collect() == days.collect()


def test_models_save_and_load(spark, tmp):
    df = spark.createDataFrame([(str(i), [float(i), 1.0], i % 2) for i in range(20)], "id string, features array<double>, label int")
    model = modeling.fit(df, weight=None)
    again = modeling.load(modeling.save(model, tmp + "/model"))
    assert modeling.score(model, df).collect() == modeling.score(again, df).collect()


def test_completeness_check_cannot_be_pruned(spark):
    test = spark.createDataFrame([("a", 1), ("b", 2)], "id string, row_ix long")
    preds = spark.createDataFrame([("a", 0.5)], "id string, score double")
    joined = modeling.assert_complete(modeling.join_predictions(test, preds))
    for run in (lambda: joined.count(), lambda: joined.select("id").collect()):
        with pytest.raises(Exception, match="missing prediction for b"):
            run()
    assert modeling.assert_complete(modeling.join_predictions(test.limit(1), preds)).count() == 1


def test_running_sums_of_a_hot_group(spark):
    """Nine tenths of the rows in one group: its rows stay in many partitions."""
    df = spark.range(4000).select((F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0)).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = with_running_sums(df, ["g"], ["o"], {"before": F.col("v")}, num_partitions=16)
    want = {}
    total = {}
    for r in df.orderBy("o").collect():
        want[r.o] = total.get(r.g, 0)
        total[r.g] = want[r.o] + r.v
    assert {r.o: r.before for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g#" not in plan.replace("_p#", "") or "hashpartitioning(_p" in plan
    spread = got.filter("g = 0").withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert spread < 0.7 * 3600


def test_rank_by_keys_and_null_groups(spark):
    df = spark.createDataFrame([(None, 2, "x"), (None, 1, "y"), ("a", 5, "z")], "g string, o int, k string")
    got = {r.k: r.pos for r in with_rank_within(df, ["g"], ["o"], "pos").collect()}
    assert got == {"x": 1, "y": 0, "z": 0}
    got = {r.k: r.pos for r in with_rank_within(df, ["g"], [F.col("o")], "pos", base=1, key=["k"]).collect()}
    assert got == {"x": 2, "y": 1, "z": 1}
    assert sorted(r.ix for r in with_global_index(df, ["k"], "ix").collect()) == [0, 1, 2]


def test_substrings_of_subject_lengths(spark):
    n = spark.createDataFrame([("12_3",), ("2_123",), ("7_7",)], "note_id string")
    s = spark.createDataFrame([("12",), ("2",), ("123",), ("99",)], "subject string")
    got = sorted((r.subject, r.note_id) for r in notes.related_contains(s, n).collect())
    assert got == [("12", "12_3"), ("12", "2_123"), ("123", "2_123"), ("2", "12_3"), ("2", "2_123")]


def test_documents_without_known_tokens_get_zeros(spark):
    new = spark.createDataFrame([("n1", "heart heart rate"), ("n2", "???"), ("n3", None)], "note_id string, text string")
    tv = spark.createDataFrame([("heart", [3.0, 0.0]), ("rate", [0.0, 3.0])], "token string, vec array<double>")
    assert {r.note_id: r.vec for r in embedding.token_mean(new, tv).collect()} == {"n1": [2.0, 1.0], "n2": [0.0, 0.0], "n3": [0.0, 0.0]}


def test_cluster_without_checkpoint_folder_fails(monkeypatch):
    from admitflow import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_a_continuous_label_is_refused(spark, monkeypatch):
    monkeypatch.setattr(modeling, "MAX_CLASSES", 3)
    df = spark.range(10).select(F.col("id").alias("label"))
    with pytest.raises(Exception, match="more than 3 values"):
        modeling.with_class_weight(df).collect()
    assert modeling.with_class_weight(df.select((F.col("label") % 2).alias("label"))).count() == 10
