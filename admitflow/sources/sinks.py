"""Sinks (S9-S15): parquet stores instead of one file per note, CSV result
files, statistics reuse. Every writer is a distributed Spark write."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow import schemas


def write_vectors(vecs: DataFrame, path: str, key: str = "note_id", order: str | None = None,
                  vec: str = "vec") -> str:
    """One row per note; a duplicate key keeps the last row by ``order``
    (the reference's later file overwrites an earlier one)."""
    out = vecs
    if order is not None:
        out = vecs.groupBy(key).agg(F.max_by(F.col(vec), F.col(order)).alias(vec))
    out.select(key, F.col(vec).cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)
    return path


def write_note_labels(labels: DataFrame, path: str) -> str:
    """S10."""
    labels.select([f.name for f in schemas.NOTE_LABELS.fields]).write.mode("overwrite").parquet(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def get_or_fit_stats(spark: SparkSession, path: str, fit: Callable[[], DataFrame]) -> DataFrame:
    """Read stored statistics when present, else fit, store and read
    back (one table; never half of it, Q14)."""
    if not _exists(spark, os.path.join(path, "_SUCCESS")):
        fit().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_predictions(preds: DataFrame, path: str, order: str = "row_ix",
                      score_col: str = "readmitted_within_30days") -> str:
    """``id, readmitted_within_30days`` with header, in test-id order
    (a range-partitioned sort: part files are in order)."""
    (preds.orderBy(order).select("id", F.col("score").alias(score_col))
     .write.mode("overwrite").option("header", True).csv(path))
    return path


def write_ensemble(mean: DataFrame, folder: str, order: str | None = None,
                   score_col: str = "readmitted_within_30days") -> str:
    """The averaged predictions as ``ensemble_result.csv``."""
    path = os.path.join(folder, "ensemble_result.csv")
    out = mean.orderBy(order) if order else mean
    out.select("id", F.col("score").alias(score_col)).write.mode("overwrite").option("header", True).csv(path)
    return path
