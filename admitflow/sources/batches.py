"""Store of padded batches (M9 F3 X19): three Parquet tables in batch order.

* ``days``: the rows of the day branch with their dense vectors,
* ``notes``: the rows of the note branch, which name their note,
* ``vectors``: the sparse vector of each note of a batch, once per batch however
  many of its samples hold the note.

Padded rows are stored too, as the consumer reads rows and masks; their vectors
are zeros and so take no room in ``vectors``. Rows are range-partitioned and
sorted by batch, so a file holds a run of batches and a reader that asks for
some of them skips the row groups of the others; columns are pruned by the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("days", "notes", "vectors")
_ORDER = {"days": ["batch_id", "id", "pos"], "notes": ["batch_id", "id", "pos"], "vectors": ["batch_id", "note_id"]}


def batch_vectors(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """``batch_id, note_id, ix, value``: the sparse vectors (``note_id, term_ix,
    shift``) of the notes that a batch names. A note's entries are packed once
    and then joined, so the rows that move are one per batch and note."""
    packed = vectors.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("term_ix", "shift"))).alias("_v"))
    named = notes.filter("note_id IS NOT NULL").select("batch_id", "note_id").distinct()
    return named.join(packed, "note_id").select(
        "batch_id", "note_id", F.transform("_v", lambda x: x["term_ix"]).alias("ix"), F.transform("_v", lambda x: x["shift"]).alias("value"))


def write_batches(path: str, days: DataFrame, notes: DataFrame, vectors: DataFrame, rows_per_file: int = 1_000_000) -> str:
    """Writes the three tables under ``path``; ``vectors`` as of ``batch_vectors``."""
    for name, df in zip(TABLES, (days, notes, vectors), strict=True):
        order = _ORDER[name]
        (df.repartitionByRange(*order).sortWithinPartitions(*order)
         .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{name}"))
    return path


def read_batches(spark: SparkSession, path: str, name: str, first: int | None = None, last: int | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """A table of the store, of the batches ``first`` to ``last`` (inclusive)."""
    if name not in TABLES:
        raise ValueError(f"{name} is none of {TABLES}")
    df = spark.read.parquet(f"{path}/{name}")
    if first is not None:
        df = df.filter(F.col("batch_id") >= first)
    if last is not None:
        df = df.filter(F.col("batch_id") <= last)
    return df if columns is None else df.select(*columns)


def note_rows(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The note branch with its sparse vectors (``ix, value``; null where a row is
    padded, has no note or its note has no entries). The join is on (batch, note),
    so a note in very many batches is no hot key."""
    return read_batches(spark, path, "notes", first, last).join(read_batches(spark, path, "vectors", first, last), ["batch_id", "note_id"], "left")


def tensors(rows: DataFrame, vec: str, zero) -> DataFrame:
    """One row per batch as a trainer takes it: ``batch_id, ids, values, mask`` -
    ``values[sample][pos]`` is a vector and ``mask[sample][pos]`` is true where it
    is padded. A batch is bounded by its size and its longest sequence."""
    one = rows.groupBy("batch_id", "id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.coalesce(F.col(vec), zero).alias("v"), "padded"))).alias("r"))
    made = one.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("id", "r"))).alias("s"))
    return made.select("batch_id", F.transform("s", lambda s: s["id"]).alias("ids"),
                       F.transform("s", lambda s: F.transform(s["r"], lambda r: r["v"])).alias("values"),
                       F.transform("s", lambda s: F.transform(s["r"], lambda r: r["padded"])).alias("mask"))
