"""Batches, masks, folds, AUC, loss, pooling, model jobs."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from admitflow.functions import vectors as V
from admitflow.operators import batching, folds, metrics, modeling, pooling


def test_padded_batch_masks(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 0, 3)], "id string, batch_id long, n int")
    out = {r.id: (r.mask, r.n_masked) for r in batching.collate(df, "n").collect()}
    assert out == {"a": ([False, True, True], 2), "b": ([False, False, False], 0)}
    seqs = spark.createDataFrame([([[1.0, 1.0]], 3)], "s array<array<double>>, m int")
    assert batching.pad(seqs, "s", "m", 2).first().s == [[1.0, 1.0], [0.0, 0.0], [0.0, 0.0]]
    zero = spark.createDataFrame([(0, 0)], "n int, m int").select(V.padding_mask(F.col("n"), F.col("m")).alias("k"))
    assert zero.first().k == []


def test_batches_are_consecutive(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.col("id").alias("row_ix"))
    got = {r.id: (r.batch_id, r.batch_pos) for r in batching.batches(df, ["row_ix"], 128).collect()}
    assert all(got[str(i)] == (i // 128, i % 128) for i in range(300))


@pytest.mark.parametrize("n", [95, 100, 7])
def test_exact_folds_partition_ids_with_sizes_within_one(spark, n):
    df = spark.range(n).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"))
    f = [r.fold for r in folds.kfold(df, k=10, exact=True).collect()]
    sizes = [f.count(k) for k in range(10)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert sizes == sorted(sizes, reverse=True)
    h = [r.fold for r in folds.kfold(df, k=10).collect()]
    assert all(0 <= x < 10 for x in h)


def test_range_split_last_takes_rest(spark):
    df = spark.range(19).select(F.col("id").alias("row_ix"))
    parts = {r.row_ix: r.part for r in folds.ranges(df, ["row_ix"], 8).collect()}
    assert [parts[i] for i in range(19)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 7, 7, 7]
    few = folds.ranges(spark.range(3).select(F.col("id").alias("row_ix")), ["row_ix"], 8)
    assert {r.part for r in few.collect()} == {7}


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return 0.0
    return sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_auc_equals_brute_force_pairs_with_ties(spark):
    rnd = random.Random(5)
    data = [(str(i), round(rnd.gauss(0, 1), 1), rnd.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(data, "id string, score double, label int")
    got = metrics.roc_auc(df).first().auc
    assert math.isclose(got, _brute_auc([(s, y) for _, s, y in data]), rel_tol=1e-12)


def test_one_class_auc_is_zero(spark):
    df = spark.createDataFrame([("a", 0.3, 1), ("b", 0.1, 1)], "id string, score double, label int")
    assert metrics.roc_auc(df).first().auc == 0.0


def test_focal_loss_matches_formula(spark):
    df = spark.createDataFrame([(0.7, 1), (-1.2, 0)], "score double, label int")
    got = metrics.focal_loss(df, alpha=2.0, reduction="sum").first().loss

    def one(x, y):
        t = y * 0.9 + 0.05
        bce = max(x, 0) - x * t + math.log1p(math.exp(-abs(x)))
        return 2.0 * (1 - math.exp(-bce)) ** 2 * bce
    assert math.isclose(got, one(0.7, 1) + one(-1.2, 0), rel_tol=1e-12)


def test_attention_weights_sum_to_one_and_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [2.0, 2.0])],
                               "id string, features array<double>")
    out = {r.id: r.features for r in pooling.attention(df, [1.0, 0.0], 0.0).collect()}
    wa = math.exp(1) / (math.exp(1) + 1)
    assert math.isclose(out["a"][0], wa) and math.isclose(out["a"][1], 1 - wa)
    assert out["b"] == [2.0, 2.0]
    sw = pooling.softmax_weights(df.withColumn("s", F.col("features")[0]), "s")
    assert math.isclose(sum(r.weight for r in sw.filter("id = 'a'").collect()), 1.0)


def test_ensemble_mean_counts_missing_as_zero(spark):
    p = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "a", 2.0), (0, "b", 3.0), (1, "b", 3.0)],
                              "model_id int, id string, score double")
    got = {r.id: r.score for r in modeling.ensemble_mean(p).collect()}
    assert got == {"a": 2.0, "b": 2.0}
    skip = {r.id: r.score for r in modeling.ensemble_mean(p, skip_missing=True).collect()}
    assert skip == {"a": 2.0, "b": 3.0}


def test_missing_prediction_fails_completeness(spark):
    test = spark.createDataFrame([("a", 1), ("b", 2)], "id string, row_ix long")
    preds = spark.createDataFrame([("a", 0.5)], "id string, score double")
    assert [r.id for r in modeling.missing_predictions(test, preds).collect()] == ["b"]
    with pytest.raises(Exception, match="missing prediction"):
        modeling.assert_complete(modeling.join_predictions(test, preds)).collect()


def test_best_step_first_strictly_better_and_patience(spark):
    m = spark.createDataFrame([(0, 0.6), (1, 0.7), (2, 0.7), (3, 0.65), (4, 0.9)], "step int, auc double")
    assert modeling.best(m).first().step == 4
    assert modeling.best(m, patience=2).first().step == 1
    assert modeling.best(m.filter("step < 4")).first().step == 1


def test_fit_kfold_and_user_scorer(spark):
    rnd = random.Random(1)
    rows = [(str(i), [rnd.random(), rnd.random()], int(rnd.random() > 0.5)) for i in range(200)]
    train = spark.createDataFrame(rows, "id string, features array<double>, label int")
    test = train.limit(20).select("id", "features")
    preds, auc = modeling.fit_kfold(train, test, k=3, per_fold=True)
    assert sorted(r.n_pos + r.n_neg for r in auc.collect()) == [66, 67, 67]
    model, steps = modeling.select_model(train.limit(120), train.limit(80))
    assert steps.count() == 3 and modeling.score(model, test).count() == 20
    assert preds.count() == 60
    assert modeling.ensemble_mean(preds, 3).count() == 20
    scored = modeling.score_with(test, lambda pdf: [sum(v) for v in pdf["features"]])
    got = {r.id: r.score for r in scored.collect()}
    assert all(math.isclose(got[i], sum(f)) for i, f, _ in rows[:20])
