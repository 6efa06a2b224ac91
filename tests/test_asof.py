"""As-of joins against a plain loop, with one subject holding most rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from admitflow.operators import assembly, notes
from admitflow.operators.ordered import as_of, with_prefix


def _case(seed, hot=False, n=120, m=150):
    rng = random.Random(seed)
    subject = lambda: "hot" if hot and rng.random() < 0.8 else rng.choice(["a", "b", "c", None])
    left = [(f"{i}", subject(), rng.choice([None, *range(12)]), i) for i in range(n)]
    right = [(f"n{i}", subject(), rng.choice([None, *range(12)]), rng.choice([None, 1.5, 2.0, -3.0])) for i in range(m)]
    return left, right


def _brute(left, right, strict):
    out = set()
    for key, subject, at, _ in left:
        fits = [r for r in right if None not in (subject, at, r[1], r[2]) and r[1] == subject and (r[2] < at if strict else r[2] <= at)]
        out.add((key, len(fits), round(sum(r[3] or 0 for r in fits), 6), max((r[2] for r in fits), default=None)))
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_a_loop(spark, hot, strict):
    left, right = _case(3, hot)
    a = spark.createDataFrame(left, "id string, subject string, at int, other int").repartition(3)
    b = spark.createDataFrame(right, "note string, subject string, at int, v double").repartition(3).withColumn("seen", F.col("at"))
    got = as_of(a, b, ["subject"], ["at"], ["note", "seen"], {"n": F.lit(1), "total": F.coalesce("v", F.lit(0.0))}, strict)
    assert got.columns == ["id", "subject", "at", "other", "note", "seen", "n", "total"]
    assert {(r["id"], r["n"], round(r["total"], 6), r["seen"]) for r in got.collect()} == _brute(left, right, strict)
    last = {(r[1], r[2]): {x[0] for x in right if x[1:3] == r[1:3]} for r in right}
    assert all(r["note"] in last[r["subject"], r["seen"]] for r in got.collect() if r["note"])


def test_a_hot_subject_lies_in_several_partitions(spark):
    a = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("subject"), (F.col("id") * 2).alias("at"))
    b = spark.range(400).select(F.col("id").cast("string").alias("note_id"), F.lit("s").alias("subject"), (F.col("id") * 2 + 1).alias("at"))
    both = with_prefix(a.unionByName(b, allowMissingColumns=True), ["subject"], ["at"], {"n": F.lit(1)}, {"last": F.col("note_id")}, num_partitions=4)
    spread = both.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 600
    got = notes.history(a, b, ["at"])
    assert {(int(r["id"]), r["n_before"], r["last_note"]) for r in got.collect()} == {(i, i, str(i - 1) if i else None) for i in range(400)}


def test_as_of_of_empty_sides_and_clashes(spark):
    left, right = _case(5)
    a = spark.createDataFrame(left, "id string, subject string, at int, other int")
    b = spark.createDataFrame(right, "note string, subject string, at int, v double")
    assert {(r["note"], r["n"]) for r in as_of(a, b.limit(0), ["subject"], ["at"], ["note"], {"n": F.lit(1)}).collect()} == {(None, 0)}
    assert as_of(a.limit(0), b, ["subject"], ["at"], ["note"]).count() == 0
    with pytest.raises(ValueError, match="other"):
        as_of(a, b.withColumnRenamed("note", "other"), ["subject"], ["at"], ["other"])


def test_sample_notes_up_to_the_admission(spark):
    head = spark.createDataFrame([("s_1", "s", True, 1), ("s_2", "s", True, 3), ("t_1", "t", False, 0), ("s_0", "s", True, 0)],
                                 "id string, subject string, has_note boolean, upto long")
    order = spark.createDataFrame([("s", k, f"n{k}") for k in range(4)], "subject string, note_pos long, note_id string")
    every = assembly.sample_notes(head, order)
    assert sorted(rows(every.filter("id = 's_1'"), "pos", "note_id")) == [(k, f"n{k}") for k in range(4)]
    some = sorted(rows(assembly.sample_notes(head, order, upto="upto"), "id", "pos", "note_id"), key=str)
    assert some == sorted([("s_1", 0, "n0"), ("s_2", 0, "n0"), ("s_2", 1, "n1"), ("s_2", 2, "n2"), ("t_1", 0, None), ("s_0", 0, None)], key=str)


def test_admissions_of_a_hot_subject_are_spread(spark):
    head = spark.range(3000).select(F.concat(F.lit("s_"), "id").alias("id"), F.lit("s").alias("subject"), F.lit(True).alias("has_note"))
    order = spark.createDataFrame([("s", k, f"n{k}") for k in range(3)], "subject string, note_pos long, note_id string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        out = assembly.sample_notes(head, order)
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sum(parts) == 9000 and max(parts) < 6000
