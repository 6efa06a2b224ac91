"""Batch store, keyed store, merged statistics, epochs, substring automata,
hot tokens and the stateful stream."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from admitflow.operators import batching, embedding, moments, notes, sequences, substrings
from admitflow.operators.ordered import with_global_index
from admitflow.sources import batches, bucketed, keyed


# ---------------------------------------------------------------- statistics

def test_merged_moments_equal_a_refit(spark, tmp):
    rng = np.random.default_rng(2)
    data = [(f"{i}", i % 4, [float(v) for v in rng.normal(1e6, 1.0, 3)]) for i in range(200)]
    df = spark.createDataFrame(data, "id string, part int, features array<double>")
    for part in (0, 1, 2, 3, 1):  # a load that is replayed replaces its part
        moments.write_part(f"{tmp}/m", str(part), moments.moments(df.filter(F.col("part") == part)))
    moments.write_part(f"{tmp}/m", "none", moments.moments(df.limit(0)))
    for ddof in (0, 1):
        got = moments.as_stats(moments.read_moments(spark, f"{tmp}/m"), ddof).first()
        want = sequences.fit_scaler(df, "features", ddof).first()
        assert got["n"] == want["n"] == 200
        assert np.allclose(got["mean"], want["mean"], rtol=1e-12) and np.allclose(got["std"], want["std"], rtol=1e-9)
    scaled = sequences.standardise(df, moments.as_stats(moments.read_moments(spark, f"{tmp}/m")), "features")
    assert abs(np.mean([r["features"] for r in scaled.collect()])) < 1e-6


def test_fit_on_some_rows_and_on_none(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [3.0]), ("c", [100.0]), ("d", None)], "id string, features array<double>")
    some = moments.moments(df, fit_on=spark.createDataFrame([("a",), ("b",), ("a",)], "id string")).first()
    assert (some["n"], some["mean"], some["m2"]) == (2, [2.0], [2.0])
    none = moments.as_stats(moments.merge(moments.moments(df.limit(0)))).first()
    assert (none["n"], none["mean"], none["std"]) == (0, [], [])
    with pytest.raises(FileNotFoundError):
        moments.read_moments(spark, "/tmp/there-is-no-such-folder")


def test_sparse_moments_count_the_zeros(spark):
    rng = random.Random(3)
    docs = [f"d{i}" for i in range(40)]
    dense = {x: [rng.choice([0.0, 0.0, rng.random()]) for _ in range(4)] for x in docs}
    sparse = spark.createDataFrame([(x, k, v) for x, vec in dense.items() for k, v in enumerate(vec) if v], "note_id string, term_ix int, value double")
    halves = [docs[:13], docs[13:]]
    told = [moments.sparse_moments(sparse, F.lit(len(h)), spark.createDataFrame([(x,) for x in h], "note_id string")) for h in halves]
    got = {r["term_ix"]: (r["mean"], r["m2"]) for r in moments.merge_sparse(told[0].unionByName(told[1]), F.lit(40)).collect()}
    for k in range(4):
        column = np.array([dense[x][k] for x in docs])
        assert got[k] == pytest.approx((column.mean(), ((column - column.mean()) ** 2).sum()))


# ---------------------------------------------------------------- stores

def _batch_rows(spark):
    days = [(b, f"{b}-{i}", p, [float(b), float(p)], p > 0) for b in range(6) for i in range(3) for p in range(2)]
    told = [(b, f"{b}-{i}", p, None if p else f"n{(b + i) % 5}", p > 0) for b in range(6) for i in range(3) for p in range(2)]
    vecs = [(f"n{k}", t, 0.5 * k + t) for k in range(4) for t in range(k)]  # n0 has no entries, n4 no vector
    return (spark.createDataFrame(days, "batch_id long, id string, pos int, features array<double>, padded boolean"),
            spark.createDataFrame(told, "batch_id long, id string, pos int, note_id string, padded boolean"),
            spark.createDataFrame(vecs, "note_id string, term_ix int, shift double"))


def test_batch_store_round_trip(spark, tmp):
    days, told, vecs = _batch_rows(spark)
    path = batches.write_batches(f"{tmp}/b", days, told, batches.batch_vectors(told, vecs))
    assert sorted(map(str, batches.read_batches(spark, path, "days").collect())) == sorted(map(str, days.collect()))
    got = batches.note_rows(spark, path)
    dense = {k: [(t, v) for n, t, v in [tuple(r) for r in vecs.collect()] if n == k] for k in ("n0", "n1", "n2", "n3", "n4")}
    assert got.count() == told.count()
    for r in got.collect():
        want = dense.get(r["note_id"]) or None
        assert (list(zip(r["ix"], r["value"], strict=True)) if r["ix"] is not None else None) == want
    some = batches.read_batches(spark, path, "days", 2, 3, ["batch_id", "pos"])
    assert {r["batch_id"] for r in some.collect()} == {2, 3} and some.columns == ["batch_id", "pos"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(batch_id,2)" in plan and "features" not in plan
    with pytest.raises(ValueError, match="labels"):
        batches.read_batches(spark, path, "labels")


def test_batches_as_tensors(spark):
    days, _, _ = _batch_rows(spark)
    one = batches.tensors(days, "features", F.array(F.lit(0.0), F.lit(0.0))).filter("batch_id = 4").first()
    assert one["ids"] == ["4-0", "4-1", "4-2"] and one["values"] == [[[4.0, 0.0], [4.0, 1.0]]] * 3 and one["mask"] == [[False, True]] * 3


def _scanned(df):
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_keyed_reads_skip_row_groups(spark, tmp):
    df = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("note_id"), F.array_repeat(F.rand(1), 4).alias("vec"))
    path = keyed.write_keyed(df, f"{tmp}/k", row_group_bytes=64 << 10, keys_per_group=2000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scanned = {}
        for n in (1, 8):
            asked = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("note_id"))
            got = keyed.read_keyed(spark, path, asked)
            scanned[n] = _scanned(got)
            assert sorted(rows(got, "note_id")) == sorted(rows(asked, "note_id"))
        assert scanned[1] < scanned[8] < 60_000 / 2
        missing = keyed.read_keyed(spark, path, spark.createDataFrame([("zzz",), (None,)], "note_id string"))
        assert missing.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    many = spark.range(keyed.PUSHED + 5).select(F.md5(F.col("id").cast("string")).alias("note_id"))
    assert keyed.read_keyed(spark, path, many).count() == keyed.PUSHED + 5
    assert keyed.read_keyed(spark, path, many.limit(0)).count() == 0


def test_keyed_store_keeps_the_last_row_and_refuses_nulls(spark, tmp):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "note_id string, seq int, v string")
    path = keyed.write_keyed(df, f"{tmp}/l", order="seq")
    assert sorted(rows(spark.read.parquet(path), "note_id", "v")) == [("a", "new"), ("b", "only")]
    with pytest.raises(Exception, match="null in note_id"):
        keyed.write_keyed(df.withColumn("note_id", F.lit(None).cast("string")), f"{tmp}/n")


def test_stored_samples_join_without_an_exchange(spark, tmp):
    head = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 20, F.lit("_"), "id").alias("id"),
                                   F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("subject"),
                                   (F.col("id") % 2 == 0).alias("has_note"))
    days = head.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"), F.lit(1.5).alias("v"))
    told = head.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"), F.lit("n").alias("note_id"))
    name = bucketed.save_samples(head, days, told, "t_samples", f"{tmp}/s", buckets=4)
    try:
        day, note = bucketed.day_rows(spark, name), bucketed.note_rows(spark, name)
        for df in (day, note):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert day.count() == 900 and sorted(rows(day, "id", "pos")) == sorted(rows(days, "id", "pos"))
        want = head.filter("has_note").join(told, "subject")
        assert sorted(rows(note, "id", "pos")) == sorted(rows(want, "id", "pos"))
        hot = note.filter("subject = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(hot) > 1  # a subject with a third of the admissions is no single bucket
    finally:
        bucketed.drop_samples(spark, name)


# ---------------------------------------------------------------- epochs

@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_epochs_are_permutations(spark, n):
    df = spark.range(n).withColumnRenamed("id", "ix")
    got = batching.epochs(df, "ix", F.lit(n), 3, 16, seed=5).collect()
    orders = {e: [r["shuffle_ix"] for r in sorted(got, key=lambda r: r["ix"]) if r["epoch"] == e] for e in range(3)}
    assert all(sorted(o) == list(range(n)) for o in orders.values())
    assert all(r["batch_id"] == r["shuffle_ix"] // 16 and r["batch_pos"] == r["shuffle_ix"] % 16 for r in got)
    if n >= 100:
        assert orders[0] != orders[1] != orders[2] and orders[0] != list(range(n))
        shift = np.corrcoef(orders[0], range(n))[0, 1]
        assert abs(shift) < 0.3


def test_an_epoch_needs_no_exchange(spark):
    ids = with_global_index(spark.range(50).select(F.col("id").cast("string").alias("id")), ["id"])
    ids.write.mode("overwrite").parquet(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}-ids")
    stored = spark.read.parquet(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}-ids")
    assert "Exchange" not in batching.epochs(stored, "ix", F.lit(50), 4)._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- joins

@pytest.mark.parametrize("limits", [(200_000, 500_000), (7, 11)])
def test_automaton_equals_the_substring_join(spark, limits):
    rng = random.Random(8)
    keys = [("".join(rng.choice("12_é") for _ in range(rng.randint(1, 3))),) for _ in range(25)] + [(None,)]
    ids = [("".join(rng.choice("123_é") for _ in range(rng.randint(0, 9))),) for _ in range(60)] + [(None,)]
    a, b = spark.createDataFrame(keys, "subject string"), spark.createDataFrame(ids, "note_id string")
    want = {(k, t) for k, in keys for t, in ids if k is not None and t is not None and k in t}
    assert set(rows(substrings.contains_join(a, b, "subject", "note_id", *limits), "subject", "note_id")) == want
    assert set(rows(notes.related_contains(a.filter("subject IS NOT NULL"), b.filter("note_id IS NOT NULL")), "subject", "note_id")) == want
    empty = spark.createDataFrame([("",)], "subject string")
    assert substrings.contains_join(empty, b, "subject", "note_id").count() == len({t for t, in ids if t is not None})
    assert substrings.contains_join(a.limit(0), b, "subject", "note_id").count() == 0


def test_hot_tokens_and_means(spark):
    rng = random.Random(1)
    words = ["common"] * 30 + [f"w{k}" for k in range(400)]
    docs = [(f"d{i}", " ".join(["common", *(rng.choice(words) for _ in range(20))])) for i in range(200)] + [("none", "zzz"), ("null", None)]
    df = spark.createDataFrame(docs, "note_id string, text string")
    counts = embedding.token_counts(df)
    hot = {r["token"] for r in embedding.hot_tokens(counts).collect()}
    assert "common" in hot and len(hot) <= embedding.HOT_TOKENS
    vec = {w: [float(len(w)), float(k)] for k, w in enumerate(sorted(set(words)))}
    tv = spark.createDataFrame(list(vec.items()), "token string, vec array<double>")
    got = {r["note_id"]: r["vec"] for r in embedding.token_mean(df, tv, dim=2).collect()}
    for name, text in docs:
        own = [vec[w] for w in (text or "").split() if w in vec]
        assert got[name] == pytest.approx(np.mean(own, axis=0) if own else [0.0, 0.0])


# ---------------------------------------------------------------- stream

def test_stateful_stream_embeds_each_note_once(spark, tmp):
    from admitflow.streaming import stateful

    tv = spark.createDataFrame([("one", [1.0]), ("two", [2.0])], "token string, vec array<double>")
    write = lambda data, name: spark.createDataFrame(data, "note_id string, text string").coalesce(1).write.parquet(f"{tmp}/in/{name}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    done = spark.createDataFrame([("old",)], "note_id string")
    run = lambda: stateful.run_stateful(spark, f"{tmp}/in", f"{tmp}/store", tv, f"{tmp}/ckpt", done)
    try:
        write([("a", "one"), ("b", "two"), ("old", "one"), (None, "one")], "f1")
        run()
        assert sorted(rows(stateful.read_store(spark, f"{tmp}/store"), "note_id")) == [("a",), ("b",)]
        write([("a", "two"), ("c", "one two"), ("c", "one")], "f2")
        run()
        run()  # nothing new
        got = {r["note_id"]: r["vec"] for r in stateful.read_store(spark, f"{tmp}/store").collect()}
        assert got == {"a": [1.0], "b": [2.0], "c": [1.5]}
        assert stateful.read_store(spark, f"{tmp}/store").count() == 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
