"""Label curation.

One aggregation per split does distinct, conflict detection and the
first-occurrence order at once: no self-join, and a hot id is pre-aggregated
map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _summary(df: DataFrame, key: str, label: str, order: str, by=()) -> DataFrame:
    lab = F.col(label)
    return df.groupBy(*by, key).agg(
        F.countDistinct(lab).alias("n_labels"),                      # A2: nulls ignored
        F.max(lab).alias(label),
        F.min(F.when(lab.isNotNull(), F.col(order))).alias(order))    # W8: first row kept


def conflicts(df: DataFrame, key: str = "id", label: str = "label", order: str = "row_ix",
              by=()) -> DataFrame:
    """A18 + P5: ids with more than one distinct non-null label (per ``by``
    group, e.g. per label file, in one aggregation)."""
    return (_summary(df, key, label, order, by).filter(F.col("n_labels") > 1)
            .select(*by, key, F.col("n_labels").cast("long").alias("n_labels")))


def curate(df: DataFrame, key: str = "id", label: str = "label", order: str = "row_ix",
           by=()) -> DataFrame:
    """A1 + J1 + Q3: distinct (id, label), conflicting ids removed, null
    labels dropped; ``order`` keeps the first occurrence. ``by`` curates
    several label files at once."""
    return (_summary(df, key, label, order, by).filter(F.col("n_labels") == 1)
            .select(*by, key, label, order))


def distinct_ids(df: DataFrame, key: str = "id", order: str = "row_ix") -> DataFrame:
    """P1 + A1 for the unlabelled test file: each id once, first position."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def union_splits(*dfs: DataFrame) -> DataFrame:
    """Train + valid (ensemble mode)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (n_classes * n_c); one row per class (the
    grouped table has one row per class, so the window is tiny)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return counts.select(
        label, "n",
        (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"))


def positive_weight(df: DataFrame, label: str = "label"):
    """The weight of class 1 as a scalar column (the focal-loss alpha)."""
    return class_weights(df, label).filter(F.col(label) == 1).select("weight").scalar()
