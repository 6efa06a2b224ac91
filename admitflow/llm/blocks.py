"""Blocks of documents and buckets of hashes: an exchange of sorted hash arrays.

Operators that must know which hashes occur in several documents use this. A
block is a set of rows chosen by the hash of their key, of about BLOCK_BYTES of
text; its rows are put in a fixed order, so a block always yields the same
sorted array of distinct hashes. A bucket is a range of hashes. A block sends
each bucket its part of the array as one binary value, and the bucket answers
with one bit per hash. A hash that very many documents share is thus sent once
per block, and neither side holds more than a block or a bucket, both of which
grow in number and not in size with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, BUCKET_BYTES, LEAST = 2 << 20, 32 << 20, 64
PARTS = "bucket int, block int, keys binary, extra binary, rank binary"
BITS = "block int, phase int, bucket int, bits binary"


@dataclass(frozen=True)
class Layout:
    blocks: int
    buckets: int

    @classmethod
    def of(cls, text_bytes: int) -> Layout:
        return cls(max(LEAST, -(-text_bytes // BLOCK_BYTES)), max(LEAST, -(-text_bytes // BUCKET_BYTES)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Layout]:
    """``block, doc, text, copies`` of the distinct rows, and the layout for the
    size of all. Equal rows of a batch are merged before they are moved, so a row
    that is repeated very often reaches its block once per batch of 10,000."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    layout = Layout.of(size)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in merged(pa.table({"doc": batch.column(0), "text": batch.column(1), "copies": pa.array(np.ones(batch.num_rows, np.int64))})).to_batches():
                yield one

    block = F.pmod(F.xxhash64("doc", "text"), F.lit(layout.blocks)).cast("int")
    return rows.mapInArrow(merge, "doc long, text string, copies long").select(block.alias("block"), "doc", "text", "copies"), layout


def merged(table: pa.Table) -> pa.Table:
    """One row per ``doc, text`` with its ``copies``."""
    held = table.group_by(["doc", "text"]).aggregate([("copies", "sum")])
    return held.select(["doc", "text", "copies_sum"]).rename_columns(["doc", "text", "copies"])


def in_order(table: pa.Table) -> pa.Table:
    """The distinct rows of a block, always in the same order."""
    return merged(table).sort_by([("doc", "ascending"), ("text", "ascending")]).combine_chunks()


def repeated(table: pa.Table, copies: np.ndarray, most: int = 10_000) -> pa.Table:
    """``table`` with a column ``copies`` of ``most`` at the most; rows with more
    come several times."""
    parts = -(-copies // most)
    at = np.repeat(np.arange(len(copies)), parts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    return table.take(pa.array(at)).append_column("copies", pa.array(np.minimum(most, copies[at] - nth * most)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; grows with the hash, so sorted hashes stay in runs."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spans(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets present in a sorted array of hashes, and where their runs lie."""
    found, first = np.unique(bucket_of(keys, buckets), return_index=True)
    return found, first, np.append(first[1:], len(keys))[:len(first)]


def send(block: int, buckets: int, keys: np.ndarray, extra: np.ndarray | None = None,
         rank: np.ndarray | None = None) -> pa.Table:
    """Rows of ``PARTS``: the runs of the sorted hashes of a block."""
    found, lo, hi = spans(keys, buckets)
    cut = lambda a: [None if a is None else a[i:j].tobytes() for i, j in zip(lo, hi, strict=True)]
    return pa.table({"bucket": pa.array(found, pa.int32()), "block": pa.array([block] * len(found), pa.int32()),
                     "keys": pa.array(cut(keys), pa.binary()), "extra": pa.array(cut(extra), pa.binary()),
                     "rank": pa.array(cut(rank), pa.binary())})


def column(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The binary values of a column as one array."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def answer(table: pa.Table, phase: int, flags: np.ndarray) -> pa.Table:
    """Rows of ``BITS``: the flags of a bucket's entries, back to their blocks."""
    stops = np.cumsum([len(k) // 8 for k in table.column("keys").to_pylist()])
    parts = np.split(flags, stops[:-1])
    keep = [k for k, p in enumerate(parts) if p.any()]
    return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())).cast(pa.int32()),
                     "phase": pa.array([phase] * len(keep), pa.int32()),
                     "bucket": table.column("bucket").take(pa.array(keep, pa.int64())).cast(pa.int32()),
                     "bits": pa.array([np.packbits(parts[k]).tobytes() for k in keep], pa.binary())})


def received(keys: np.ndarray, buckets: int, bits: pa.Table, phase: int) -> np.ndarray:
    """The flags of a block's sorted hashes."""
    flags = np.zeros(len(keys), dtype=bool)
    got = {b: x for p, b, x in zip(*(bits.column(c).to_pylist() for c in ("phase", "bucket", "bits")), strict=True) if p == phase}
    for bucket, lo, hi in zip(*spans(keys, buckets), strict=True):
        if (x := got.get(int(bucket))) is not None:
            flags[lo:hi] = np.unpackbits(np.frombuffer(x, np.uint8), count=int(hi - lo)).astype(bool)
    return flags
