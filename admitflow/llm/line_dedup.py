"""Lines that repeat across documents, by a distributed sort of line hashes.

Each line's key (stripped, A-Z lower-cased) becomes a 128-bit hash. The hashes
are range-partitioned together with a salt of the document and sorted by
document and position inside each range, so that a scan in this order meets
the first occurrence of every line first; the salt spreads a line that very
many documents hold. The first documents per salt are reduced to the first
document of all. What comes back per document is a keep bitmap in run lengths
(kept, dropped, kept, ...), never text.

Edge cases: a null or empty text is one empty line, kept; keys of fewer than
``min_chars`` code points are kept; rows with a null id neither count as a
document nor lose lines; repeated rows of one id are one document; extra
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.session import shuffle_partitions

MIN_CHARS, SALTS = 10, 64
_BLANK = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.btrim(line, F.lit(_BLANK)), upper, lower)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, text_hash, n_dropped, runs`` of every document that loses lines.

    ``runs``: lengths of the runs of kept and dropped lines in turn, from a run
    of kept lines (0 if the first line goes) to the last dropped line.
    """
    n = shuffle_partitions(docs.sparkSession)
    lines = (docs.filter(F.col(id_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"),
                     F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "key"))
             .filter(F.length("key") >= min_chars)
             .select("doc", "text_hash", "pos", F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b"),
                     F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")))
    ranged = lines.repartitionByRange(n, "a", "b", "salt").sortWithinPartitions("a", "b", "salt", "doc", "pos")
    scan = Window.partitionBy("a", "b", "salt").orderBy("doc", "pos")
    streamed = ranged.withColumn("first", F.first("doc").over(scan))
    firsts = streamed.groupBy("a", "b").agg(
        F.min("first").alias("first"), F.max("doc").alias("last"), F.collect_set("salt").alias("salts"))
    firsts = firsts.filter("first < last").select("a", "b", "first", F.explode("salts").alias("salt"))
    dropped = lines.join(firsts, ["a", "b", "salt"]).filter("doc > first")
    by_doc = dropped.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    return by_doc.select("doc", "text_hash", F.size("gone").cast("long").alias("n_dropped"), run_lengths(F.col("gone")).alias("runs"))


def run_lengths(gone: Column) -> Column:
    """Sorted positions as lengths of kept and dropped runs in turn."""
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) < x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) > x + 1))
    return F.flatten(F.transform(starts, lambda s, i: F.array(
        s - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1), F.get(ends, i) - s + 1)))


def apply_bitmap(lines: Column, runs: Column) -> Column:
    """The lines that a document keeps."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.filter(lines, lambda x, i: F.coalesce(F.get(flags, i), F.lit(True)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with ``n_lines, n_dropped, kept_text``; ``keep`` names further
    columns to carry along."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       *[F.col(c).alias(f"_keep_{c}") for c in keep]).withColumn("_hash", F.xxhash64("_text"))
    joined = rows.join(maps, (rows["_id"] == maps["doc"]) & (rows["_hash"] == maps["text_hash"]), "left")
    kept = F.when(F.col("runs").isNull(), F.coalesce("_text", F.lit(""))).otherwise(
        F.array_join(apply_bitmap(lines_of(F.col("_text")), F.col("runs")), "\n"))
    return joined.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col),
                         *[F.col(f"_keep_{c}").alias(c) for c in keep],
                         F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
