"""Sequence stores that join without an exchange.

Days by admission, notes by subject and the admissions themselves are written
once as bucketed tables, sorted by key and position. Jobs that assemble samples
again and again - each epoch, each model - then read buckets side by side: no row
moves and, within a bucket file, none is sorted.

A bucket is one task, so a subject with very many notes or admissions would be
one: ``splits`` deals a subject's admissions over as many buckets and repeats its
note rows there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, table: str, path: str, keys: Sequence[str], order: Sequence[str], buckets: int) -> str:
    """``df`` as table ``table`` under ``path``, bucketed by ``keys``; one file per
    bucket, in the order of ``keys`` and ``order``."""
    rows = df.repartition(buckets, *keys).sortWithinPartitions(*keys, *order)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(table)
    return table


def _split(splits: int):
    return F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int")


def save_samples(head: DataFrame, days: DataFrame, notes: DataFrame, name: str, path: str, buckets: int, splits: int = 4) -> str:
    """Tables ``<name>_head``, ``<name>_days``, ``<name>_subject`` and
    ``<name>_notes``: heads as of ``assembly.heads``, days with ``id, pos`` and
    notes with ``subject, pos``, each with what else they hold."""
    save(head, f"{name}_head", f"{path}/head", ["id"], [], buckets)
    save(days, f"{name}_days", f"{path}/days", ["id"], ["pos"], buckets)
    own = head.filter("has_note").select("id", "subject", _split(splits).alias("split"))
    save(own, f"{name}_subject", f"{path}/subject", ["subject", "split"], ["id"], buckets)
    told = notes.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    save(told, f"{name}_notes", f"{path}/notes", ["subject", "split"], ["pos"], buckets)
    return name


def day_rows(spark: SparkSession, name: str) -> DataFrame:
    """Heads with their days, joined bucket by bucket."""
    return spark.table(f"{name}_head").hint("merge").join(spark.table(f"{name}_days"), "id")


def note_rows(spark: SparkSession, name: str) -> DataFrame:
    """``id`` with the notes of its subject, joined bucket by bucket."""
    return spark.table(f"{name}_subject").hint("merge").join(spark.table(f"{name}_notes"), ["subject", "split"]).drop("split")


def drop_samples(spark: SparkSession, name: str) -> None:
    """Forgets the tables; their files stay."""
    for part in ("head", "days", "subject", "notes"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
