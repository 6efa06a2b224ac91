"""Words of documents that lie in a window of a benchmark item.

A window is ``window`` consecutive words of an item (an item of fewer words is
one window). A document contains a window only if it contains all its shingles,
so one shingle is a sufficient prefix. Shingles are ordered by rarity, counted
over all documents, and each window is joined on its rarest one. A candidate
must then have room for the whole window (length bound) at the place that the
shingle's offset gives (positional bound) inside its document, and is verified
word by word, first on word hashes, then on bytes.

The benchmark is broadcast in slices of at most SLICE_WORDS words, whose number
follows from a count of its words; usually there is one. Documents are not
shuffled.

Edge cases: null and blank texts have no words; items without words or with a
null id match nothing; several rows of one item are one item; repeated
documents each get their row; an empty table gives an empty table; extra
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm import wordhash as wh

WINDOW, SHINGLE, SLICE_WORDS = 10, 3, 1_000_000
HITS = "doc long, text_hash long, n_words long, hit_words array<int>, items array<long>"


class Windows:
    """The windows of one slice of the benchmark, and their shingles."""

    def __init__(self, items: list[tuple[int, str]], window: int, shingle: int):
        w = wh.split_words(*wh.text_buffers(pa.array([t for _, t in items], pa.string())), wh.ALNUM, lower=True)
        self.words, self.hash = w, wh.hash_words(w)
        n = w.counts()
        size = np.minimum(n, window)
        per = np.where(n > 0, n - size + 1, 0)
        self.row = np.repeat(np.arange(len(items)), per)
        self.start = w.first[self.row] + np.arange(len(self.row)) - np.repeat(np.cumsum(per) - per, per)
        self.size = size[self.row]
        self.item = np.array([i for i, _ in items], dtype=np.int64)[self.row]
        self.bytes = [w.text(s, s + k) for s, k in zip(self.start.tolist(), self.size.tolist(), strict=True)]
        # one hash per window and offset of a shingle; short windows have short shingles
        self.width = np.minimum(self.size, shingle)
        self.offsets = self.size - self.width + 1
        self.by_width = {k: wh.window_hashes(self.hash, k) for k in range(1, shingle + 1)}
        self.shingles = {int(k): np.unique(np.concatenate([self.of(k, j) for j in range(window)]))
                         for k in np.unique(self.width)}

    def of(self, width: int, offset: int) -> np.ndarray:
        own = (self.width == width) & (self.offsets > offset)
        return self.by_width[int(width)][self.start[own] + offset]

    def join_on_rarest(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's rarest shingle (ties: the smaller hash)."""
        self.key, self.offset = np.zeros(len(self.size), np.uint64), np.zeros(len(self.size), np.int64)
        best = np.full(len(self.size), np.iinfo(np.int64).max)
        for width, known in self.shingles.items():
            for j in range(int(self.offsets.max())):
                own = np.flatnonzero((self.width == width) & (self.offsets > j))
                h = self.by_width[width][self.start[own] + j]
                n = counts[width][np.searchsorted(known, h)]
                take = (n < best[own]) | ((n == best[own]) & (h < self.key[own]))
                self.key[own[take]], self.offset[own[take]], best[own[take]] = h[take], j, n[take]
        self.prefix = {}
        for width in self.shingles:
            own = np.flatnonzero(self.width == width)
            own = own[np.argsort(self.key[own], kind="stable")]
            self.prefix[width] = (self.key[own], own)
        self.word_hash = np.zeros((len(self.size), int(self.size.max(initial=1))), np.uint64)
        for j in range(self.word_hash.shape[1]):
            own = self.size > j
            self.word_hash[own, j] = self.hash[self.start[own] + j]

    def find(self, w: wh.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence in the rows of ``w``."""
        starts, wins = [], []
        for width, (keys, own) in self.prefix.items():
            sh = wh.window_hashes(h, width)
            lo = np.searchsorted(keys, sh)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == sh) if len(keys) else np.zeros(0, np.int64)
            n = np.searchsorted(keys, sh[hit], side="right") - lo[hit]
            pos = np.repeat(hit, n)
            win = own[np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            start, row = pos - self.offset[win], w.row[pos] if len(pos) else pos
            fits = (start >= w.first[row]) & (start + self.size[win] <= w.first[row + 1])
            start, win = start[fits], win[fits]
            for j in range(self.word_hash.shape[1]):
                need = self.size[win] > j
                same = ~need
                same[need] = h[start[need] + j] == self.word_hash[win[need], j]
                start, win = start[same], win[same]
            starts.append(start)
            wins.append(win)
        start, win = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, wins))
        exact = np.array([w.text(s, s + k) == self.bytes[v] for s, k, v in
                          zip(start.tolist(), self.size[win].tolist(), win.tolist(), strict=True)], dtype=bool)
        return start[exact], win[exact]


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = wh.text_buffers(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in wh.row_slices(offsets):
            w = wh.split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], wh.ALNUM, lower=True)
            yield batch.slice(lo, hi - lo), w, wh.hash_words(w)


def _counts(rows: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences of the given shingles in all documents."""
    known = rows.sparkSession.sparkContext.broadcast(shingles)

    def count(batches):
        total = {k: np.zeros(len(v), np.int64) for k, v in known.value.items()}
        for _, _, h in _slices(batches):
            for width, keys in known.value.items():
                sh = wh.window_hashes(h, width)
                at = np.minimum(np.searchsorted(keys, sh), len(keys) - 1)
                total[width] += np.bincount(at[keys[at] == sh], minlength=len(keys))
        for width, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"width": pa.array([width] * len(at), pa.int32()), "ix": pa.array(at, pa.int64()),
                                   "n": pa.array(n[at], pa.int64())})

    out = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
    counted = rows.select("text").mapInArrow(count, "width int, ix long, n long").groupBy("width", "ix").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # as many rows as a slice has shingles at most
        out[r["width"]][r["ix"]] = r["n"]
    return out


def _hits(rows: DataFrame, windows: Windows) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        for batch, w, h in _slices(batches):
            start, win = given.value.find(w, h)
            cover = np.zeros(len(w) + 1, dtype=np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + given.value.size[win], -1)
            hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            row = w.row[hit]
            pairs = np.unique(np.stack([w.row[start], given.value.item[win]], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
            at = np.arange(batch.num_rows + 1)
            lists = lambda r, v, kind: pa.ListArray.from_arrays(pa.array(np.searchsorted(r, at), pa.int32()), pa.array(v, kind))
            yield pa.record_batch({
                "doc": batch.column(0), "text_hash": batch.column(1), "n_words": pa.array(w.counts(), pa.int64()),
                "hit_words": lists(row, hit - w.first[row], pa.int32()), "items": lists(pairs[:, 0], pairs[:, 1], pa.int64())})

    return rows.mapInArrow(run, HITS)


def _slices_of(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark in parts of bounded size."""
    items = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    n = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-n // (6 * SLICE_WORDS)))
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield sorted((r["item"], r["text"]) for r in own.collect())  # bounded by SLICE_WORDS


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, text_hash, n_words, hit_words, items`` of every row: positions of
    the words that are hit, and the items whose windows occur."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).cast("string").alias("text"))
    found = []
    for part in _slices_of(docs.sparkSession, benchmark, item_col, item_text_col):
        windows = Windows(part, window, SHINGLE)
        if len(windows.size):
            windows.join_on_rarest(_counts(rows, windows.shingles))
        else:
            windows.prefix, windows.word_hash = {}, np.zeros((0, 1), np.uint64)
        found.append(_hits(rows, windows))
    if len(found) == 1:
        out = found[0]
    else:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        merged = every.groupBy("doc", "text_hash").agg(
            (F.count(F.lit(1)) / len(found)).cast("int").alias("_copies"), F.max("n_words").alias("n_words"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = merged.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")
    return out.withColumnRenamed("doc", id_col)
