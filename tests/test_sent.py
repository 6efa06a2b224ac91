"""Vectors that are sent to every task in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from admitflow.operators import sent, sequences
from admitflow.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_means_of_sent_vectors(spark):
    """Repeated, missing and null keys, keys of several pieces, counts."""
    rnd = random.Random(3)
    table = [(rnd.randrange(-40, 40), [rnd.random(), rnd.random()]) for _ in range(90)] + [(None, [9.0, 9.0])]
    df = spark.createDataFrame(table, "k long, v array<float>").repartition(3)
    vectors = sent.send(df, "k", "v", len(table), piece=20)
    assert len(vectors.pieces) > 2 and vectors.width == 2
    rows = [(i, [rnd.choice([None, *range(-60, 60)]) for _ in range(i % 6)]) for i in range(40)] + [(40, None), (41, [1000])]
    rows = [(i, keys, None if keys is None else [float(1 + j % 3) for j in range(len(keys))]) for i, keys in rows]
    asked = spark.createDataFrame(rows, "i int, ks array<long>, ns array<double>")
    got = {r["i"]: r for r in asked.select("i", vectors.mean("ks").alias("one"), vectors.mean("ks", "ns").alias("many")).collect()}
    for i, keys, ns in rows:
        for name, weights in (("one", [1.0] * len(keys or [])), ("many", ns or [])):
            found = [(n, v) for x, n in zip(keys or [], weights, strict=True) for k, v in table if x is not None and k == x]
            total = sum(n for n, _ in found)
            want = [sum(n * v[d] for n, v in found) / total for d in range(2)] if found else None
            assert got[i][name] == (None if want is None else pytest.approx(want, rel=1e-6))


def test_vectors_of_two_widths_and_null_vectors_fail(spark):
    for bad in ([1.0], None, [1.0, None]):
        df = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "k long, v array<float>").coalesce(1)
        with pytest.raises(Exception, match="vector"):
            sent.send(df, "k", "v", 2)
    assert spark.range(1).select(sent.send(df.limit(0), "k", "v", 0).mean(F.array("id")).alias("m")).first()["m"] is None


def test_days_meet_vectors_without_a_broadcast_join(spark, monkeypatch):
    """No hash table of the vectors is built on the driver; days as by the join."""
    days = fixtures.day_vectors_64(spark, SF, fixtures.embedding_vectors(spark, SF))
    assert "strategy=broadcast" not in days._jdf.queryExecution().optimizedPlan().toString()
    told = days.select("id").distinct().filter("hash(id) % 3 = 0").withColumn("label", F.lit(7))
    of = lambda df, *c: sorted((r["id"], str(r["day"]), [round(x, 9) for x in r["features"]], *[r[x] for x in c]) for r in df.collect())
    ids = {r["id"] for r in told.collect()}
    some = of(fixtures.day_vectors_64(spark, SF, fixtures.embedding_vectors(spark, SF), told), "label")
    every = of(days)
    assert some == [(*r, 7) for r in every if r[0] in ids] and 0 < len(some) < len(every)
    monkeypatch.setattr(fixtures, "VECTORS_SENT", 1)
    assert fixtures.embedding_vectors(spark, SF) is None and of(fixtures.day_vectors_64(spark, SF)) == every
    assert of(fixtures.day_vectors_64(spark, SF, told=told), "label") == some


def test_mean_of_a_known_width(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 5.0]), (None, [0.0, 1.0])], "id string, features array<double>")
    of = lambda x: {r["id"]: r["features"] for r in x.collect()}
    assert of(sequences.mean_pool(df, width=2)) == of(sequences.mean_pool(df)) == {"a": [2.0, 3.5], None: [0.0, 1.0]}
    for bad in (None, [1.0]):
        with pytest.raises(Exception, match="another width"):
            sequences.mean_pool(df.union(spark.createDataFrame([("b", bad)], df.schema)), width=2).collect()
