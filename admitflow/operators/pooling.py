"""Pooling and projections with caller-supplied weights.

Attention pooling: score = v.w + b; weights = softmax of the scores inside a
key; result = weighted mean. The softmax denominator and the weighted sum are
one ``Summarizer.mean(v, weight)`` per key (weights exp(score - max) sum to
the denominator), after one partially aggregated max per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import vectors as V


def attention(df: DataFrame, w: Sequence[float], b: float = 0.0, key: str = "id",
              vec: str = "features", out: str | None = None) -> DataFrame:
    """A16 + W6 + X25: softmax-weighted sum of a key's vectors (only the real
    rows; padding never enters)."""
    scored = df.select(key, vec, (V.dot(F.col(vec), V.lit_vector(w)) + F.lit(float(b))).alias("_s"))
    top = scored.groupBy(key).agg(F.max("_s").alias("_m"))
    weighted = scored.join(top, key).select(
        key, array_to_vector(F.col(vec)).alias("_v"), F.exp(F.col("_s") - F.col("_m")).alias("_w"))
    return weighted.groupBy(key).agg(
        vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias(out or vec))


def softmax_weights(df: DataFrame, score: str, key: str = "id", out: str = "weight") -> DataFrame:
    """exp(s - max) / sum(exp(s - max)) within a key, as a column."""
    stats = df.groupBy(key).agg(F.max(score).alias("_m"))
    e = df.join(stats, key).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    tot = e.groupBy(key).agg(F.sum("_e").alias("_z"))
    return e.join(tot, key).withColumn(out, F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")


def project(df: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None,
            vec: str = "features", out: str | None = None) -> DataFrame:
    """W v + b with a literal matrix."""
    return df.withColumn(out or vec, V.project(F.col(vec), weights, bias))


def concat(df: DataFrame, *vecs: str, out: str = "vec") -> DataFrame:
    """Vectors end to end."""
    return df.withColumn(out, V.concat(*vecs))


def affine(df: DataFrame, mean, var, gamma, beta, eps: float = 1e-5, vec: str = "features",
           out: str | None = None) -> DataFrame:
    """Evaluation-mode normalisation with supplied statistics."""
    return df.withColumn(out or vec, V.affine(F.col(vec), mean, var, gamma, beta, eps))
