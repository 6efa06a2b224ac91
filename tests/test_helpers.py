"""Small expressions that other tests do not reach."""
from pyspark.sql import functions as F

from admitflow.functions import keys, vectors
from admitflow.operators import assembly, batching, embedding


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_names(spark):
    r = one(spark, keys.swap_suffix(F.lit("a.pt"), ".pt", ".txt").alias("a"), keys.swap_suffix(F.lit("apt"), ".pt", ".txt").alias("b"),
            keys.has_suffix(F.lit("a.pt"), ".pt").alias("c"), keys.contains(F.lit("12_3"), F.lit("2_")).alias("d"), keys.run_id().alias("e"))
    assert (r.a, r.b, r.c, r.d) == ("a.txt", "apt", True, True)
    assert len(r.e) == 19 and r.e[4] == "-" and r.e[10] == "_"


def test_vectors(spark):
    df = spark.createDataFrame([([1, 2],)], "v array<int>")
    r = df.select(vectors.as_double("v").alias("d"), vectors.as_float("v").alias("f"), vectors.promote("v").alias("p")).first()
    assert (r.d, r.f, r.p) == ([1.0, 2.0], [1.0, 2.0], [[1, 2]])
    assert df.select(vectors.as_float("v").alias("f")).dtypes == [("f", "array<float>")]


def test_default_ids(spark):
    df = spark.createDataFrame([("x",), ("y",)], "text string")
    assert len({r.note_id for r in embedding.with_default_ids(df).collect()}) == 2
    named = df.withColumn("note_id", F.lit("n"))
    assert embedding.with_default_ids(named) is named


def test_samples_and_collation(spark):
    cohort = spark.createDataFrame([("s_1", "s", "train", 1), ("s_2", "s", "test", 0), ("t_1", "t", "valid", 0)],
                                   "id string, subject string, split string, label int")
    ordered = spark.createDataFrame([("s", 0, "s_9"), ("s", 1, "s_1")], "subject string, note_pos long, note_id string")
    head = assembly.heads(cohort, ordered.select("note_id"))
    assert sorted((r.id, r.label, r.has_note) for r in head.collect()) == [("s_1", 1.0, True), ("s_2", None, False), ("t_1", 0.0, False)]
    mine = assembly.sample_notes(head, ordered)
    assert sorted((r.id, r.pos, str(r.note_id)) for r in mine.collect()) == [
        ("s_1", 0, "s_9"), ("s_1", 1, "s_1"), ("s_2", 0, "None"), ("t_1", 0, "None")]
    days = spark.createDataFrame([("s_1", 0, [1.0]), ("s_1", 1, [2.0]), ("s_1", 2, [3.0]), ("s_2", 0, [4.0])], "id string, day_idx int, features array<double>")
    rows = assembly.sample_days(cohort, days, 1, 2)
    assert sorted((r.id, r.pos, r.features[0], r.filled) for r in rows.collect()) == [
        ("s_1", 0, 1.0, False), ("s_1", 1, 2.0, False), ("s_1", 2, 3.0, False), ("s_2", 0, 4.0, False), ("t_1", 0, 0.0, True), ("t_1", 1, 0.0, True)]
    members = batching.batches(cohort.select("id"), ["id"], 2)
    got = assembly.collate(members, rows, ["features"], [vectors.zeros(1)])
    assert sorted((r.batch_id, r.id, r.pos, r.features[0], r.padded) for r in got.collect()) == [
        (0, "s_1", 0, 1.0, False), (0, "s_1", 1, 2.0, False), (0, "s_1", 2, 3.0, False),
        (0, "s_2", 0, 4.0, False), (0, "s_2", 1, 0.0, True), (0, "s_2", 2, 0.0, True),
        (1, "t_1", 0, 0.0, False), (1, "t_1", 1, 0.0, False)]
