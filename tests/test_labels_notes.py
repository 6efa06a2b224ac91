"""Label curation, note keys, joins and ordering."""
from pyspark.sql import functions as F

from admitflow.functions.keys import note_seq_of
from admitflow.operators import labels, notes
from admitflow.operators.ordered import with_global_index, with_next_within, with_rank_within


def test_null_label_is_not_a_conflict_and_is_dropped(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1, 2), ("b", 0, 3), ("b", 1, 4), ("c", 1, 5), ("c", 1, 6)],
                               "id string, label int, row_ix long")
    assert sorted((r.id, r.n_labels) for r in labels.conflicts(df).collect()) == [("b", 2)]
    assert sorted((r.id, r.label, r.row_ix) for r in labels.curate(df).collect()) == [("a", 1, 2), ("c", 1, 5)]


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    w = {r.label: r.weight for r in labels.class_weights(df).collect()}
    assert w == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}


def test_bad_sequence_numbers_become_minus_one(spark):
    df = spark.createDataFrame([("2.0",), ("x",), (None,), (" 7 ",), ("-3",)], "s string")
    assert [r.v for r in df.select(note_seq_of(F.col("s")).alias("v")).collect()] == [-1, -1, -1, 7, -3]


def test_global_index_and_ranks_match_windows(spark):
    from pyspark.sql import Window
    df = spark.range(0, 3000).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 3001).alias("o"))
    got = with_rank_within(df, ["g"], ["o"], "pos")
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert got.select("g", "o", "pos").exceptAll(exp.select("g", "o", "pos")).count() == 0
    ix = with_global_index(df, ["g", "o"], "ix")
    assert sorted(r.ix for r in ix.collect()) == list(range(3000))
    nxt = with_next_within(df, ["g"], ["o"], ["o"])
    lead = df.withColumn("next_o", F.lead("o").over(Window.partitionBy("g").orderBy("o")))
    assert nxt.select("g", "o", "next_o").exceptAll(lead).count() == 0


def test_hot_group_is_ranked_exactly(spark):
    # one group holds most rows: ranks are still exact (range partitions split it)
    from pyspark.sql import Window
    df = spark.range(0, 5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 5).alias("g"),
                                     F.col("id").alias("o"))
    got = with_rank_within(df, ["g"], ["o"], "pos")
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert got.exceptAll(exp.select("g", "o", "pos")).count() == 0


def test_substring_join_equals_nested_loop(spark):
    ids = ["12_345", "3123_9", "1_12", "45_7", "7_1"]
    n = spark.createDataFrame([(i,) for i in ids], "note_id string")
    subs = spark.createDataFrame([("12",), ("1",), ("45",), ("9",), ("77",)], "subject string")
    got = sorted((r.subject, r.note_id) for r in notes.related_contains(subs, n).collect())
    brute = sorted((s, i) for s in ["12", "1", "45", "9", "77"] for i in ids if s in i)
    assert got == brute


def test_gate_and_related_subjects(spark):
    ids = spark.createDataFrame([("1_10",), ("1_11",), ("2_20",)], "id string")
    nt = spark.createDataFrame([("1_10",), ("1_12",)], "note_id string")
    gate = {r.id: r.has_note for r in notes.gate(ids, nt).collect()}
    assert gate == {"1_10": True, "1_11": False, "2_20": False}
    rel = {r.id: r.n_notes for r in notes.related_subjects(ids, nt).collect()}
    assert rel == {"1_10": 2, "1_11": 2, "2_20": 0}


def test_note_order_ties_broken_by_note_id(spark):
    lab = spark.createDataFrame([("s_b", "s", 1), ("s_a", "s", 1), ("s_c", "s", 0)],
                                "note_id string, subject string, note_seq int")
    got = sorted((r.note_pos, r.note_id) for r in notes.note_order(lab).collect())
    assert got == [(0, "s_c"), (1, "s_a"), (2, "s_b")]
