"""Statistics that are kept and merged.

The reference computes the mean and deviation of all note vectors once and reads
them back later, whatever has been added since. Here the count, the mean and the
sum of squared differences (m2) are kept, one row per part of the data; parts
merge exactly, so a delta costs a pass over the delta alone. A part is named by
the caller and written as a whole: writing it again replaces it, which makes a
replayed load harmless. Statistics may be fitted on some rows only (``fit_on``),
as for the notes of the train split.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.sources.sinks import _exists


def moments(df: DataFrame, vec: str = "features", fit_on: DataFrame | None = None, key: str = "id") -> DataFrame:
    """``n, mean, m2`` of the vectors (of the rows whose ``key`` is in ``fit_on``),
    one row, or none if there is no vector."""
    rows = df if fit_on is None else df.join(fit_on.select(key).distinct(), key, "left_semi")
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(vec)))
    told = rows.filter(F.col(vec).isNotNull()).groupBy(F.lit(0).alias("_g")).agg(s.alias("s"))
    m2 = F.transform(vector_to_array("s.variance"), lambda v: v * (F.col("s.count") - 1).cast("double"))
    return told.select(F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"), m2.alias("m2"))


def _merged(a: Column, b: Column) -> Column:
    """Two parts as one; a part without rows changes nothing."""
    n = a["n"] + b["n"]
    share = (b["n"] / n).cast("double")
    gap = F.zip_with(b["mean"], a["mean"], lambda x, y: x - y)
    mean = F.zip_with(a["mean"], gap, lambda x, d: x + d * share)
    m2 = F.zip_with(F.zip_with(a["m2"], b["m2"], lambda x, y: x + y), gap, lambda s, d: s + d * d * share * a["n"].cast("double"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2")))


def merge(parts: DataFrame) -> DataFrame:
    """One row of all rows ``n, mean, m2`` of ``parts`` (one per part: their number
    is that of the loads, not of the data), whatever their order."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("mean"), F.array().cast("array<double>").alias("m2"))
    held = parts.agg(F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))).alias("p"))
    return held.select(F.aggregate("p", start, _merged).alias("t")).select("t.*")


def as_stats(moment: DataFrame, ddof: int = 0) -> DataFrame:
    """``mean, std, n`` as ``sequences.fit_scaler`` gives them; a std that is not
    defined (n <= ddof) is 0."""
    d = (F.col("n") - ddof).cast("double")
    std = F.transform("m2", lambda v: F.when(d > 0, F.sqrt(F.greatest(v, F.lit(0.0)) / d)).otherwise(F.lit(0.0)))
    return moment.select("mean", std.alias("std"), "n")


def write_part(path: str, part: str, moment: DataFrame) -> str:
    """Stores the moments of one part; the same name again replaces it."""
    moment.select("n", "mean", "m2").coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}")
    return path


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    """The merged moments of all stored parts."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no stored moments in {path}")
    return merge(spark.read.parquet(path).select("n", "mean", "m2"))


def sparse_moments(sparse: DataFrame, n_docs: Column, fit_on: DataFrame | None = None, doc: str = "note_id") -> DataFrame:
    """A6 on sparse rows ``(doc, term_ix, value)``: ``term_ix, n, mean, m2`` of the
    dimensions that occur, absent values being zeros, over ``n_docs`` documents
    (those of ``fit_on``, if given)."""
    rows = sparse if fit_on is None else sparse.join(fit_on.select(doc).distinct(), doc, "left_semi")
    n = n_docs.cast("double")
    told = rows.groupBy("term_ix").agg(F.count(F.lit(1)).cast("double").alias("_k"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    mean = F.col("_m") * F.col("_k") / n
    # the zeros are a part of n - k values with mean 0
    m2 = F.col("_v") * F.col("_k") + F.col("_m") * F.col("_m") * F.col("_k") * (n - F.col("_k")) / n
    return told.select("term_ix", n_docs.cast("long").alias("n"), mean.alias("mean"), m2.alias("m2"))


def merge_sparse(parts: DataFrame, totals: Column) -> DataFrame:
    """Sparse moments of several parts (rows ``part, term_ix, n, mean, m2``) over
    ``totals`` documents in all; a part without a row for a dimension has zeros."""
    told = parts.groupBy("term_ix").agg(F.sum(F.col("n") * F.col("mean")).alias("_s"), F.collect_list(F.struct("n", "mean", "m2")).alias("_p"))
    told = told.withColumn("_n", totals.cast("long"))  # a scalar subquery cannot stand inside a lambda
    n = F.col("_n").cast("double")
    told = told.withColumn("mean", F.col("_s") / n)
    mean = F.col("mean")
    held = F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    inside = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean))
    return told.select("term_ix", F.col("_n").alias("n"), "mean", (inside + (n - held) * mean * mean).alias("m2"))
