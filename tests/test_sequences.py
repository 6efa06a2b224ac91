"""Scaler, slicing, fill, noise, positional encoding."""
import math

import pytest
from pyspark.sql import functions as F

from admitflow.functions import vectors as V
from admitflow.operators import sequences as seq


def test_population_vs_sample_std_and_constant_dimension(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([4.0, 5.0],)], "features array<double>")
    pop = seq.fit_scaler(df, ddof=0).first()
    samp = seq.fit_scaler(df, ddof=1).first()
    assert round(pop["std"][0], 4) == 1.2472 and round(samp["std"][0], 4) == 1.5275
    assert pop["std"][1] == 0.0
    for mode in ("one", "zero"):
        z = seq.standardise(df, seq.fit_scaler(df, ddof=0), zero_std=mode)
        assert all(r.features[1] == 0.0 for r in z.collect())
    scaled = [r.features[0] for r in seq.standardise(df, seq.fit_scaler(df, ddof=0)).collect()]
    assert abs(sum(scaled)) < 1e-12
    assert math.isclose(math.sqrt(sum(x * x for x in scaled) / 3), 1.0, rel_tol=1e-12)


def test_narrow_features_become_k_zeros(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0] * 6,)], "features array<double>")
    out = [r.sel for r in seq.slice_features(df, [5, 0], 4, out="sel").collect()]
    assert out[0] == [0.0] * 4
    assert out[1] == [1.0, 1.0]


def test_fill_missing_rows(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = spark.createDataFrame([("a", 0, [1.0, 2.0])], "id string, day_idx int, features array<double>")
    out = seq.fill_missing(ids, rows, width=2, missing_rows=3)
    got = sorted((r.id, r.day_idx, tuple(r.features), r.filled) for r in out.collect())
    assert got == [("a", 0, (1.0, 2.0), False)] + [("b", i, (0.0, 0.0), True) for i in range(3)]


def test_noise_is_seeded_and_has_the_requested_spread(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("day_idx"),
                                  V.zeros(5).alias("features"))
    a = seq.add_noise(df, 0.05, seed=3)
    b = seq.add_noise(df.repartition(7), 0.05, seed=3)
    x = {r.id: r.features for r in a.collect()}
    y = {r.id: r.features for r in b.collect()}
    assert x == y
    vals = [v for f in x.values() for v in f]
    mean = sum(vals) / len(vals)
    sd = math.sqrt(sum((v - mean) ** 2 for v in vals) / len(vals))
    assert abs(mean) < 0.003 and abs(sd - 0.05) < 0.003
    assert seq.add_noise(df, 0.0) is df


@pytest.mark.parametrize("dim", [4, 5])
def test_positional_encoding_matches_formula(spark, dim):
    df = spark.createDataFrame([(3,)], "p int").select(V.positional_row(F.col("p"), dim).alias("pe"))
    pe = df.first().pe
    for j in range(dim):
        f = math.exp(-(j - j % 2) * math.log(10000.0) / dim)
        assert math.isclose(pe[j], math.sin(3 * f) if j % 2 == 0 else math.cos(3 * f), rel_tol=1e-12)
