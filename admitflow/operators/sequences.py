"""Sequence features.

Vectors are ``array<double>``; per-dimension statistics use ``Summarizer``
(one buffer of width F per task, tree-merged), never an explode of every
element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions import vectors as V


def mean_pool(df: DataFrame, key: str = "id", vec: str = "features", width: int | None = None) -> DataFrame:
    """A3: mean over a key's rows of each dimension. Of a known ``width`` by plain
    sums, which keep one row per key in a task; an aggregator of vectors would sort
    all rows. A null vector, or one of another width, fails."""
    if width is not None:
        bad = F.raise_error(F.lit(f"a vector of {vec} is null or of another width than {width}")).cast("double")
        sums = [F.sum(F.get(vec, i)).alias(f"_s{i}") for i in range(width)]
        found = df.groupBy(key).agg(F.sum(F.when(F.size(vec) == width, F.lit(1.0)).otherwise(bad)).alias("_n"), *sums)
        return found.select(key, F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(width)]).alias(vec))
    return df.groupBy(key).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias(vec))


def fit_scaler(df: DataFrame, vec: str = "features", ddof: int = 0) -> DataFrame:
    """One row ``(mean, std, n)``. ``ddof=0`` is the population std
    of a standard scaler; ``ddof=1`` the sample std of a tensor ``std()``."""
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec)))
    st = df.select(s.alias("s")).select(
        vector_to_array(F.col("s.mean")).alias("mean"),
        vector_to_array(F.col("s.variance")).alias("var"),
        F.col("s.count").alias("n"))
    n = F.col("n").cast("double")
    factor = (n - 1) / n if ddof == 0 else F.lit(1.0)
    return st.select(
        "mean",
        F.transform("var", lambda v: F.sqrt(F.greatest(v * factor, F.lit(0.0)))).alias("std"),
        "n")


def standardise(df: DataFrame, stats: DataFrame, vec: str = "features", out: str | None = None,
                zero_std: str = "one", width: int | None = None) -> DataFrame:
    """J7 + X15: (x - mean) / std with the one-row statistics as one scalar
    subquery (evaluated once, no join, no cross product)."""
    bound = df.withColumn("_st", stats.select(F.struct("mean", "std")).scalar())
    return bound.withColumn(out or vec, V.standardise(F.col(vec), F.col("_st.mean"), F.col("_st.std"), zero_std, width)) \
        .drop("_st")


def slice_features(df: DataFrame, indices: Sequence[int] | Column, k: int, vec: str = "features",
                   out: str | None = None) -> DataFrame:
    """Keep the selected positions; narrower vectors become k zeros."""
    if not isinstance(indices, Column):
        return df.withColumn(out or vec, V.select_positions(F.col(vec), list(indices), k))
    bound = df.withColumn("_ix", indices)  # a scalar subquery cannot stand inside a lambda
    return bound.withColumn(out or vec, V.select_positions_col(F.col(vec), F.col("_ix"), k)).drop("_ix")


def fill_missing(ids: DataFrame, rows: DataFrame, key: str = "id", width: int = 100,
                 missing_rows: int = 100, fill: str = "zeros", mean: Column | None = None,
                 pos: str = "day_idx", vec: str = "features") -> DataFrame:
    """J3 + X17: every id of ``ids`` gets its rows; an id without rows gets
    ``missing_rows`` rows of zeros (or of ``mean`` when ``fill='mean'``). ``rows``
    is made once: an id without any comes out of the same join."""
    told = ids.select(key).distinct().join(rows.select(key, F.col(pos).alias("_pos"), F.col(vec).alias("_vec"), F.lit(True).alias("_told")), key, "left")
    own = F.col("_told").isNotNull()
    filler = V.zeros(width) if fill == "zeros" else mean
    last = F.when(own, F.lit(0)).otherwise(F.lit(missing_rows - 1))
    return told.withColumn("_at", F.explode(F.sequence(F.lit(0), last))).select(
        key, F.when(own, F.col("_pos")).otherwise(F.col("_at")).alias(pos), F.when(own, F.col("_vec")).otherwise(filler).alias(vec), (~own).alias("filled"))


def _gauss(seed: int, *parts: Column) -> Column:
    """A standard normal value that depends only on (seed, parts): Box-Muller
    over the first 52 bits of two md5 sums. The same however the data is
    partitioned, and any SQL engine can repeat it."""
    def uniform(k: int) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), *[p.cast("string") for p in parts])
        return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    return F.sqrt(F.lit(-2.0) * F.log(uniform(1))) * F.cos(F.lit(2 * 3.141592653589793) * uniform(2))


def add_noise(df: DataFrame, std: float, seed: int = 0, key: str = "id", pos: str = "day_idx",
              vec: str = "features") -> DataFrame:
    """P11 + X16: x + N(0, std) elementwise when std > 0, else unchanged."""
    if std <= 0:
        return df
    return df.withColumn(vec, F.transform(
        F.col(vec), lambda x, i: x + F.lit(float(std)) * _gauss(seed, F.col(key), F.col(pos), i)))


def add_positional(df: DataFrame, dim: int, pos: str = "day_idx", vec: str = "features",
                   out: str | None = None) -> DataFrame:
    """X24 + W10: add the sinusoidal encoding of the row's position."""
    return df.withColumn(out or vec, V.add(F.col(vec), V.positional_row(F.col(pos), dim)))


def explode_vector(df: DataFrame, keys: Sequence[str], vec: str = "features",
                   pos: str = "feature_ix", value: str = "value") -> DataFrame:
    """Long rows ``(*keys, pos, value)`` - the form vectors leave the library in."""
    return df.select(*keys, F.posexplode(vec).alias(pos, value))
