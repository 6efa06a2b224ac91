"""Winnowed fingerprints of whole texts, in DataFrame functions only.

A text's tokens are its runs of non-space characters. A run of more than
``TOKEN_CHARS`` code points is cut by its content, not by a stride: behind every
code point outside ASCII, punctuation mark, vowel and one of the digits 0, 2, 5
and 8 (``ENDS``), and after ``TOKEN_CHARS`` code points without any. Text of a
script without spaces thus has one token per code point, and one that is put in
moves no cut behind the next of those signs. Every ``k``
consecutive tokens give a rolling k-gram hash; from every window of ``w``
consecutive hashes the smallest is chosen, the rightmost on ties, and its
position is kept. Two texts that share ``w + k - 1`` tokens in a row therefore
share a fingerprint entry. A text of fewer than k tokens has one gram (all its
tokens), one of fewer than w grams has one window.

An entry is a long: 31 bits of hash, then the position counted down from
2^32 - 1, so that the smallest long in a window is the smallest hash at the
rightmost place. Sliding minima are taken by doubling, log2(w) passes.

Edge cases: null and blank texts have an empty fingerprint; two empty ones
have likeness 1, an empty and another 0; equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.session import shuffle_partitions

K, WINDOW, TOKEN_CHARS = 3, 4, 12
ENDS = r"aeiouyAEIOUY0258\p{Punct}\P{ASCII}"  # signs that end a token of a long run
_TOKEN = r"(?<!\S)\S{1,%d}+(?!\S)|[^\s%s]{0,%d}+[%s]|[^\s%s]{1,%d}" % (TOKEN_CHARS, ENDS, TOKEN_CHARS - 1, ENDS, ENDS, TOKEN_CHARS)
_POSITIONS = 1 << 32


def _shifted_min(a: Column, step: int) -> Column:
    """min(a[i], a[i + step]) for every i where both exist (a itself if none)."""
    n = F.size(a) - step
    return F.when(n < 1, F.array(F.array_min(a))).otherwise(
        F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(1))), F.slice(a, step + 1, F.greatest(n, F.lit(1))), lambda x, y: F.least(x, y)))


def winnow(df: DataFrame, text_col: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: the chosen entries of ``text_col``, an array of longs in
    the order of their positions."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TOKEN), F.lit(0))
    tokens = F.transform(found, lambda t: F.xxhash64(t))
    df = df.withColumn("_t", tokens)
    t = F.col("_t")
    n = F.greatest(F.size(t) - (k - 1), F.lit(1))
    grams = F.slice(t, 1, n)
    for j in range(1, k):
        grams = F.zip_with(grams, F.slice(t, j + 1, n), lambda a, b: F.xxhash64(a, b))
    low = F.lit((1 << 31) - 1)
    coded = F.transform(F.when(F.size(t) < k, F.array(F.xxhash64(t))).otherwise(grams),
                        lambda h, i: F.shiftleft(h.bitwiseAND(low), 32) + (F.lit(_POSITIONS - 1) - i))
    df = df.withColumn("_g", coded)
    m, step = F.col("_g"), 1
    while step < window:
        df = df.withColumn("_g", _shifted_min(m, step))
        step *= 2
    chosen = F.when(F.size("_t") == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct("_g"))
    return df.withColumn(out, chosen).drop("_t", "_g")


def entry_hash(e: Column) -> Column:
    return F.shiftright(e, 32)


def entry_position(e: Column) -> Column:
    return F.lit(_POSITIONS - 1) - e.bitwiseAND(F.lit(_POSITIONS - 1))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, entry_hash))


def as_text(fp: Column) -> Column:
    """``hash:position`` entries in hexadecimal, joined by commas."""
    return F.array_join(F.transform(fp, lambda e: F.concat(F.hex(entry_hash(e)), F.lit(":"), F.hex(entry_position(e)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of fingerprint hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def with_next(rows: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame],
              columns: list[str]) -> DataFrame:
    """Applies ``derive`` to every row and adds ``next_<c>``, for each of
    ``columns``, of the row that follows in ascending ``key`` (ties by
    ``text``); the first row follows the last.

    Rows are cut at quantiles of the key into ranges, so the order is local to a
    range; the text of the first row of every range is also put behind the last row
    of the range before. There are as many ranges as shuffle partitions at most.
    """
    n = shuffle_partitions(rows.sparkSession)
    at = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx(key, at, max(10_000, 20 * n)).alias("c")).first()["c"] if at else []
    cuts = sorted(set(cuts or []))
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col(key)))
    if cuts:
        step = max(1, int(len(cuts) ** 0.5))  # look up a coarse cut, then the fine ones behind it
        block = F.lit(step) * F.greatest(below(_longs(cuts[::step])) - 1, F.lit(0))
        part = block + below(F.slice(_longs(cuts), block + 1, step))
    else:
        part = F.lit(0)
    rows = rows.withColumn("_part", part.cast("int"))
    lowest = rows.groupBy("_part").agg(F.min(key).alias(key))  # as many rows as ranges
    heads = rows.join(F.broadcast(lowest), ["_part", key]).groupBy("_part").agg(F.min(text).alias(text))
    # the head of a range ends the range before it as a row of its own, that of the first range the last one
    order = Window.orderBy("_part")
    before = F.coalesce(F.lag("_part").over(order), F.max("_part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = heads.select(before.alias("_part"), text, F.lit(1).alias("_end"))
    # derived values are made behind the exchange, which carries the texts alone, once
    every = rows.withColumn("_end", F.lit(0)).unionByName(ends, allowMissingColumns=True).repartitionById(n, "_part")
    led = derive(every).withColumn("_follow", F.lead(F.struct(*columns)).over(Window.partitionBy("_part").orderBy("_end", key, text)))
    kept = [c for c in led.columns if c not in ("_part", "_end", "_follow")]
    return led.filter("_end = 0").select(*kept, *[F.col(f"_follow.{c}").alias(f"next_{c}") for c in columns])


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of
    ``following``."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, fp, next_fp, edited, edited_fp`` (fingerprints are arrays of
    entries). A null id comes before all others."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("_id", F.lit(-(1 << 63)).cast("long")))
    rows = with_next(rows, "_key", "text", lambda df: winnow(df, "text", "fp"), ["text", "fp"])
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).drop("next_text", "_key")
    return winnow(rows, "edited", "edited_fp").withColumnRenamed("_id", id_col)
