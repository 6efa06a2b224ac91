"""Exact removal of word passages that an earlier document holds.

A window is ``window`` consecutive words. Anchors are hashes of ``ANCHOR_WORDS``
words taken only at positions that lie in the difference cover COVER modulo
PERIOD: for any two positions i and j there is a shift d < PERIOD with both
i + d and j + d in the cover. As ANCHOR_WORDS + PERIOD - 1 is ``window`` at
most, two equal windows always share an aligned anchor inside them. So

1. blocks send their distinct anchors to hash buckets and learn which occur in
   several documents;
2. only windows around such anchors are extended: their full hashes (96 bits)
   go to buckets with the smallest document of the block, and blocks learn for
   which of them an earlier document exists elsewhere;
3. the words of windows with an earlier document are removed.

Texts are shuffled once (the three steps reuse one exchange); see ``blocks``
for memory and hot passages. All hashes are of whole texts.

Edge cases: a null or blank text has no words; rows with a null id have no
order, so they neither lose words nor take any; rows of one id are one
document; extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm import blocks as B
from admitflow.llm import wordhash as wh

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)  # fixed values: a perfect difference set modulo 7
RESULT = "doc long, n_words long, n_removed long, kept_text string, copies long"


class Block:
    """Words and anchors of a block's rows, in the block's fixed order."""

    def __init__(self, table: pa.Table, window: int):
        table = B.in_order(table)
        self.n, self.window, self.docs = window - PERIOD + 1, window, table.column("doc").combine_chunks()
        self.copies = table.column("copies").to_numpy()
        w = self.words = wh.split_words(*wh.text_buffers(table.column("text")), wh.SPACED)
        self.hash = wh.hash_words(w)
        ids = self.docs.fill_null(0).to_numpy(zero_copy_only=False)
        self.known = ~self.docs.is_null().to_numpy(zero_copy_only=False)
        self.doc_of = ids[w.row]
        place = np.arange(len(w)) - w.first[w.row]
        at = wh.windows_in_rows(w, self.n)
        at = at[np.isin(place[at] % PERIOD, COVER) & self.known[w.row[at]]]
        self.anchor_at = at
        self.anchors, self.anchor_ix = np.unique(wh.window_hashes(self.hash, self.n)[at], return_inverse=True)
        self.local = self.several(self.anchor_ix, self.doc_of[at], len(self.anchors))

    @staticmethod
    def several(ix: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Which of n keys have two documents or more."""
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, ix, doc)
        np.maximum.at(high, ix, doc)
        return low < high

    def extend(self, shared: np.ndarray) -> None:
        """Windows that hold an anchor of several documents."""
        w, n = self.words, self.window
        hot = np.zeros(len(w) + 1, dtype=np.int64)
        hot[self.anchor_at[shared[self.anchor_ix]] + 1] = 1
        before = np.cumsum(hot)
        at = wh.windows_in_rows(w, n)
        at = at[(before[at + PERIOD] > before[at]) & self.known[w.row[at]]]
        self.window_at = at
        key = wh.window_hashes(self.hash, n)[at] if len(at) else np.zeros(0, np.uint64)
        check = (wh.window_hashes(self.hash, n, 1)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        order = np.lexsort((check, key))
        key, check = key[order], check[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        self.window_ix = np.empty(len(order), dtype=np.int64)
        self.window_ix[order] = np.cumsum(new) - 1
        self.keys, self.checks = key[new], check[new]
        self.lowest = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.lowest, self.window_ix, self.doc_of[at])

    def result(self, earlier: np.ndarray) -> pa.Table:
        """``RESULT`` rows, given the windows with an earlier document elsewhere."""
        w, at = self.words, self.window_at
        gone = at[earlier[self.window_ix] | (self.doc_of[at] > self.lowest[self.window_ix])]
        cover = np.zeros(len(w) + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + self.window, -1)
        removed = np.cumsum(cover)[:-1] > 0
        n_removed = np.bincount(w.row[removed], minlength=len(self.docs))
        found = pa.table({"doc": self.docs, "n_words": pa.array(w.counts(), pa.int64()),
                          "n_removed": pa.array(n_removed, pa.int64()), "kept_text": wh.join_words(w, ~removed)})
        return B.repeated(found, self.copies)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` of every row."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words at least")
    rows, layout = B.keyed(docs, id_col, text_col)
    n = layout.buckets

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        return B.send(key[0].as_py(), n, Block(table, window).anchors)

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        _, ix, count = np.unique(B.column(table, "keys", np.uint64), return_inverse=True, return_counts=True)
        return B.answer(table, 1, count[ix] > 1)

    def extended(table: pa.Table, bits: pa.Table) -> Block:
        block = Block(table, window)
        block.extend(block.local | B.received(block.anchors, n, bits, 1))
        return block

    def windows(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        block = extended(table, bits)
        return B.send(key[0].as_py(), n, block.keys, block.checks, block.lowest)

    def earlier(key: tuple, table: pa.Table) -> pa.Table:
        keys, checks, low = (B.column(table, c, t) for c, t in (("keys", np.uint64), ("extra", np.uint32), ("rank", np.int64)))
        order = np.lexsort((low, checks, keys))
        new = np.ones(len(order), dtype=bool)
        k, c = keys[order], checks[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        least = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        flags = np.empty(len(order), dtype=bool)
        flags[order] = least < low[order]
        return B.answer(table, 2, flags)

    def results(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        block = extended(table, bits)
        return block.result(B.received(block.keys, n, bits, 2))

    first = rows.groupBy("block").applyInArrow(anchors, B.PARTS).groupBy("bucket").applyInArrow(shared, B.BITS)
    second = (rows.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(windows, B.PARTS)
              .groupBy("bucket").applyInArrow(earlier, B.BITS))
    out = rows.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(results, RESULT)
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))  # repeated rows come back
    return out.select(F.col("doc").alias(id_col), "n_words", "n_removed", "kept_text", every.alias("_c")).drop("_c")
