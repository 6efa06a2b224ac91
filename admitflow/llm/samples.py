"""Bounded samples of rows for training, chosen by the hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.session import cut_lineage


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds))


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``id, label`` (0 or 1), one row per id; unlabelled rows are left out and
    an id with several labels gets the most frequent, 1 on ties."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))


def draw(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """``limit`` rows at most, spread evenly by the hash of ``id``."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(limit)


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``sample`` with ``text``; one text per id. The sample is small by its
    limit, so it is broadcast; the texts are cut off from the scan."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = own.join(F.broadcast(sample), "id").groupBy(*sample.columns).agg(F.min("text").alias("text"))
    return cut_lineage(found)
