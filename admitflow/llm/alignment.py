"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Every text is encoded by tokenizer A (byte-level BPE) and B (pieces with byte
fallback); both encode a space and the text. Byte offsets where tokens of both
end cut the tokens into groups, and every A token of a group is linked with every
B token of it. The steps:

1. Texts are encoded in slices. A task numbers its rows (a container is a run of
   65,536 row numbers at most, closed early after ``FLUSH`` postings) and keeps, for each
   pair of ids, compressed bitmaps of the rows that hold it linked: plane k has
   the rows whose number of such links has bit k set. A plane is a sorted list of
   16-bit numbers, or 8 KB of bits where that is less. Slices are OR-merged into
   a container, and the popcount of the OR of a pair's planes is the number of its documents.
2. Container counts are summed per pair, which gives the corpus-wide count and
   the highest count of each A id.
3. Postings return scores: a container's planes meet the counts of their pairs,
   and the links' counts (2^k for a row of plane k) are added up per row.

A pair has one row per container, so a pair in every document is no hot key
(rows: the number of containers). Containers are bounded, and so is each group
of step 3. Nothing is broadcast or collected.

Each row is a document, also where ids repeat or are null. Row numbers and the
facts about rows come from one checkpoint, so they agree after a lost executor.

Edge cases: null and empty texts have no tokens; neither have texts that B does
not give back (those with U+2581); the strings of special tokens are plain text;
extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admitflow.llm import wordhash as wh
from admitflow.llm.tokens import Encoder, vocabulary_path
from admitflow.session import cut_lineage

PIECES = "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
FLUSH, CONTAINER = 3 << 20, 1 << 16   # postings and rows of a container
DENSE = 4096                          # numbers from which a plane is held as bits
WIDE = 1 << 20                        # links of a group from which equal ids are counted first
MEMO_UNITS = 500_000
ID_BITS, ROW_BITS = 20, 16            # a pair is A id << 20 | B id; with a row number behind it, a posting


class PlainEncoder(Encoder):
    """Tokenizer A with the strings of special tokens as plain text."""

    def _special(self, raw, offsets, out, bounds):
        return out, bounds


class PieceEncoder:
    """Tokenizer B. No piece has a space behind another character, so a text is
    cut into units before every space that follows no space; a distinct unit is
    encoded once per task."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        table = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            table.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
        self.bytes = table
        self.size = np.array([len(b) for b in table], dtype=np.int64)
        self.space = self.model.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros((0, 3), np.int64)  # first id, number of ids, whether the bytes come back
        self.flat = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> None:
        units = [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        # a unit's own space is the one that the model adds
        coded = self.model.encode([u[1:].decode("utf-8") for u in units], num_threads=1)
        coded = [c if len(u) > 1 else [self.space] for c, u in zip(coded, units, strict=True)]
        counts = np.array([len(c) for c in coded], dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(coded), dtype=np.int32, count=int(counts.sum()))
        ends = np.cumsum(counts)
        size = np.concatenate([[0], np.cumsum(self.size[ids])])
        same = size[ends] - size[ends - counts] == end - start
        if not (same.all() and b"".join([self.bytes[i] for i in ids.tolist()]) == b"".join(units)):
            same = np.array([b"".join([self.bytes[i] for i in c]) == u for c, u in zip(coded, units, strict=True)])
        place = np.stack([len(self.flat) + ends - counts, counts, same.astype(np.int64)], axis=1)
        self.flat = np.concatenate([self.flat, ids])
        merged = np.concatenate([self.keys, keys])
        by_key = np.argsort(merged, kind="stable")
        self.keys, self.place = merged[by_key], np.concatenate([self.place, place])[by_key]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows (each a space and a text), where each row's begin, and
        whether a row's bytes come back."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64), np.ones(rows, dtype=bool)
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        first = np.searchsorted(start, offsets)
        row = np.repeat(np.arange(rows), np.diff(first))
        distinct, at, back = np.unique(wh.hash_words(wh.Words(data, start, end, row, first)), return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_UNITS:
            self._forget()
        found = np.searchsorted(self.keys, distinct)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == distinct[known]
        if not known.all():
            new = at[~known]
            self._learn(distinct[~known], data.tobytes(), start[new], end[new])
            found = np.searchsorted(self.keys, distinct)
        source, size, same = self.place[found].T
        n = size[back]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - source[back], n)]
        whole = np.ones(rows, dtype=bool)
        whole[row[same[back] == 0]] = False
        return out, total[first], whole


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1 with room for a separator: 8 bytes each."""
    return np.array([str(i) for i in range(n)], dtype="S8").view(np.uint8).reshape(n, 8).copy()


class Texts:
    """Numbers in decimal, each followed by one of the signs ``,|;``."""

    SIGNS = b",|;"

    def __init__(self, ids: int):
        digits = _digits(ids)
        size = (digits != 0).sum(axis=1)
        table = []
        for sign in self.SIGNS:
            one = digits.copy()
            one[np.arange(ids), size] = sign
            table.append(one)
        self.n, self.size = ids, size + 1
        self.table = np.concatenate(table).view(np.uint64).ravel()

    def join(self, ids: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and the byte behind each number and its sign."""
        wide = self.table[ids.astype(np.int64) + self.n * sign].view(np.uint8)
        return wide[wide != 0], np.cumsum(self.size[ids])


class Slice:
    """Groups and links of the rows of a slice; rows without tokens are empty."""

    def __init__(self, a: np.ndarray, a_end: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_end: np.ndarray, b_first: np.ndarray):
        self.a, self.b, self.a_first, self.b_first = a, b, a_first, b_first
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        self.a_group = np.searchsorted(cuts, a_end)
        self.b_group = np.searchsorted(cuts, b_end)
        self.n_a = np.bincount(self.a_group, minlength=len(cuts))
        self.n_b = np.bincount(self.b_group, minlength=len(cuts))
        self.a0 = np.concatenate([[0], np.cumsum(self.n_a)])
        self.b0 = np.concatenate([[0], np.cumsum(self.n_b)])
        self.row_first = np.searchsorted(self.a0, a_first)   # first group of each row
        self.row = np.repeat(np.arange(len(a_first) - 1), np.diff(self.row_first))

    def row_sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.row_first[1:]] - total[self.row_first[:-1]]

    def digests(self, texts: Texts) -> list[str]:
        """sha256 of ``a1,a2|b1;...`` of each row, '' for a row without tokens."""
        m = len(self.a) + len(self.b)
        at_a = np.arange(len(self.a)) + self.b0[self.a_group]
        at_b = np.arange(len(self.b)) + self.a0[self.b_group + 1]
        ids, sign = np.empty(m, np.int64), np.zeros(m, np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[self.a0[1:] - 1]] = 1
        sign[at_b[self.b0[1:] - 1]] = 2
        data, end = texts.join(ids, sign)
        stop = np.concatenate([[0], end])[self.a_first + self.b_first]  # bytes before each row
        return [hashlib.sha256(data[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, pairs and numbers of links, some repeatedly."""
        size = self.n_a * self.n_b
        one = np.flatnonzero(size == 1)
        yield self.row[one], self._pair(self.a[self.a0[one]], self.b[self.b0[one]]), np.ones(len(one), np.int64)
        some = np.flatnonzero((size > 1) & (size < WIDE))
        for lo, hi in wh.row_slices(np.concatenate([[0], np.cumsum(size[some])]), WIDE):
            g = some[lo:hi]
            n = size[g]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            g = np.repeat(g, n)
            yield self.row[g], self._pair(self.a[self.a0[g] + k // self.n_b[g]], self.b[self.b0[g] + k % self.n_b[g]]), np.ones(len(g), np.int64)
        for g in np.flatnonzero(size >= WIDE):
            a, held_a = np.unique(self.a[self.a0[g]:self.a0[g + 1]], return_counts=True)
            b, held_b = np.unique(self.b[self.b0[g]:self.b0[g + 1]], return_counts=True)
            step = max(1, WIDE // len(b))
            for i in range(0, len(a), step):
                pairs = self._pair(a[i:i + step, None], b[None, :]).ravel()
                yield np.full(len(pairs), self.row[g]), pairs, (held_a[i:i + step, None] * held_b[None, :]).ravel()

    @staticmethod
    def _pair(a, b):
        return (a.astype(np.int64) << ID_BITS) | b


def aligned(data: np.ndarray, offsets: np.ndarray, coder_a: Encoder, coder_b: PieceEncoder) -> Slice:
    """Alignment of the rows of a slice."""
    filled = np.diff(offsets) > 0
    spaced = np.insert(data, offsets[:-1][filled], np.uint8(0x20))
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    b, b_first, whole = coder_b.encode(spaced, offsets)
    if not whole.all():  # rows that do not come back have no tokens
        keep = np.repeat(whole, np.diff(offsets))
        spaced = spaced[keep]
        b = b[np.repeat(whole, np.diff(b_first))]
        offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) * whole)])
        b_first = np.concatenate([[0], np.cumsum(np.diff(b_first) * whole)])
    a, a_first = coder_a.encode(spaced, offsets)
    return Slice(a, np.cumsum(coder_a.token_bytes[a]), a_first, b, np.cumsum(coder_b.size[b]), b_first)


class Postings:
    """The open container of a task: postings (pair and row) with the number of
    links of each."""

    def __init__(self):
        self.key, self.count, self.held = [], [], 0

    def add(self, rows: np.ndarray, pairs: np.ndarray, count: np.ndarray) -> None:
        key, count = _merged(pairs << ROW_BITS | rows, count)
        self.key.append(key)
        self.count.append(count)
        self.held += len(key)
        if self.held > 2 * FLUSH:  # one very long text: merge what is equal
            self._merge()

    def _merge(self) -> None:
        if self.key:
            key, count = _merged(np.concatenate(self.key), np.concatenate(self.count))
            self.key, self.count, self.held = [key], [count], len(key)

    def planes(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Pairs, their numbers of documents, and their planes."""
        self._merge()
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.list_(pa.binary()))
        key, low, count = self.key[0] >> ROW_BITS, self.key[0] & (CONTAINER - 1), self.count[0]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        docs = np.diff(np.append(new, len(key)))
        pair_of = np.repeat(np.arange(len(new)), docs)
        depth = int(count.max()).bit_length()
        at = [np.flatnonzero(count >> k & 1) for k in range(depth)]
        order = np.concatenate(at)
        plane = np.repeat(np.arange(depth), [len(x) for x in at])
        by = np.argsort(pair_of[order] * depth + plane, kind="stable")
        order, plane = order[by], plane[by]
        segment = pair_of[order] * depth + plane
        start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        held = np.diff(np.append(start, len(segment)))
        blob, size = _segments(low[order], start, held)
        # planes below a pair's highest one are there, if only empty
        named = segment[start]
        top = np.maximum.reduceat(named % depth, np.flatnonzero(np.concatenate([[True], np.diff(named // depth) > 0])))
        lists = np.concatenate([[0], np.cumsum(top + 1)])
        sizes = np.zeros(lists[-1], dtype=np.int64)
        sizes[lists[named // depth] + named % depth] = size
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(blob)])
        return key[new], docs, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), flat)


def _merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted postings; equal ones are added up."""
    if len(key) and (count == 1).all():
        key = np.sort(key)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[new], np.diff(np.append(new, len(key)))
    order = np.argsort(key)
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(count, new) if len(new) else count


def _segments(low: np.ndarray, start: np.ndarray, held: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Segments of sorted 16-bit numbers as lists, or as bits from DENSE on."""
    dense = held >= DENSE
    size = np.where(dense, CONTAINER // 8, 2 * held)
    if not dense.any():
        return low.astype("<u2").tobytes(), size
    parts, done = [], 0
    for k in np.flatnonzero(dense):
        parts.append(low[done:start[k]].astype("<u2").tobytes())
        bits = np.zeros(CONTAINER, dtype=np.uint8)
        done = start[k] + held[k]
        bits[low[start[k]:done]] = 1
        parts.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join([*parts, low[done:].astype("<u2").tobytes()]), size


def plane_rows(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of all planes of a column, with the index of the list and the
    plane that each is of."""
    lists = np.repeat(np.arange(len(planes)), np.diff(planes.offsets.to_numpy()))
    flat = planes.flatten()
    _, ends, data = flat.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[flat.offset:flat.offset + len(flat) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(ends)
    first = np.concatenate([[0], np.cumsum(np.diff(planes.offsets.to_numpy()))])[:-1]
    depth = np.arange(len(lists)) - first[lists]
    listed = size < 2 * DENSE
    n = np.where(listed, size // 2, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(ends[:-1], n) + 2 * at
    low = [raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8]
    who, which = [np.repeat(lists, n)], [np.repeat(depth, n)]
    for k in np.flatnonzero(~listed):
        bits = np.flatnonzero(np.unpackbits(raw[ends[k]:ends[k + 1]], bitorder="little"))
        low.append(bits)
        who.append(np.full(len(bits), lists[k]))
        which.append(np.full(len(bits), depth[k]))
    return np.concatenate(low), np.concatenate(who), np.concatenate(which)


_FACTS = ["n_a", "n_b", "n_groups", "n_links"]
_SCHEMA = ("box long, low int, doc long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pair long, docs long, planes array<binary>")


def _facts(box: int, low: np.ndarray, doc: pa.Array, facts: list[np.ndarray], sha: list[str]) -> pa.RecordBatch:
    n = len(low)
    return pa.record_batch({
        "box": pa.array(np.full(n, box)), "low": pa.array(low.astype(np.int32)), "doc": doc,
        **{c: pa.array(v.astype(np.int64)) for c, v in zip(_FACTS, facts, strict=True)}, "groups_sha256": pa.array(sha, pa.string()),
        "pair": pa.nulls(n, pa.int64()), "docs": pa.nulls(n, pa.int64()), "planes": pa.nulls(n, pa.list_(pa.binary()))})


def _container(box: int, postings: Postings) -> Iterator[pa.RecordBatch]:
    pairs, docs, planes = postings.planes()
    for lo in range(0, len(pairs), 50_000):
        part = slice(lo, lo + 50_000)
        n = len(pairs[part])
        yield pa.record_batch({
            "box": pa.array(np.full(n, box)), "low": pa.nulls(n, pa.int32()), "doc": pa.nulls(n, pa.int64()),
            **{c: pa.nulls(n, pa.int64()) for c in _FACTS}, "groups_sha256": pa.nulls(n, pa.string()),
            "pair": pa.array(pairs[part]), "docs": pa.array(docs[part]), "planes": planes.slice(lo, n)})


def index_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Facts of every row (``box, low, doc`` and counts; box and low number the
    row) and the containers (``box, pair, docs, planes``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder_a, coder_b = PlainEncoder.default(), PieceEncoder(vocabulary_path(PIECES))
        texts = Texts(max(len(coder_a.token_bytes), len(coder_b.size)))
        box, used, postings = TaskContext.get().partitionId() << 32, 0, Postings()
        for batch in batches:
            data, offsets = wh.text_buffers(batch.column(1))
            for lo, hi in wh.row_slices(offsets, SLICE_BYTES):
                while lo < hi:  # rows of a slice may fall into two containers
                    upto = min(hi, lo + CONTAINER - used)
                    s = aligned(data[offsets[lo]:offsets[upto]], offsets[lo:upto + 1] - offsets[lo], coder_a, coder_b)
                    facts = [np.diff(s.a_first), np.diff(s.b_first), np.diff(s.row_first), s.row_sums(s.n_a * s.n_b)]
                    yield _facts(box, used + np.arange(upto - lo), batch.column(0).slice(lo, upto - lo), facts, s.digests(texts))
                    for rows, pairs, count in s.links():
                        postings.add(used + rows, pairs, count)
                    used, lo = used + upto - lo, upto
                    if used == CONTAINER or postings.held >= FLUSH:
                        yield from _container(box, postings)
                        box, used, postings = box + 1, 0, Postings()
        yield from _container(box, postings)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = cut_lineage(rows.mapInArrow(run, _SCHEMA))
    facts = made.filter("pair IS NULL").select("box", "low", "doc", *_FACTS, "groups_sha256")
    return facts, made.filter("pair IS NOT NULL").select("box", "pair", "docs", "planes")


def pair_counts(containers: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many documents a pair is linked, and whether
    its A id has no pair with a higher count."""
    counted = containers.groupBy("pair").agg(F.sum("docs").alias("count"))
    # an A id has as many pairs as B has ids, at most
    of_a = Window.partitionBy(F.shiftright("pair", ID_BITS))
    return counted.withColumn("best", F.col("count") == F.max("count").over(of_a))


def return_scores(containers: DataFrame, counts: DataFrame) -> DataFrame:
    """``box, low, n_best, count_sum`` of every row with links."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        planes = table.column("planes").chunk(0)
        low, who, plane = plane_rows(planes)
        links = np.int64(1) << plane
        count, best = table.column("count").to_numpy(), table.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        total, tops = np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
        np.add.at(total, low, links * count[who])
        np.add.at(tops, low, links * best[who])
        rows = np.flatnonzero(total)
        return pa.table({"box": pa.array(np.full(len(rows), table.column("box")[0].as_py())), "low": pa.array(rows.astype(np.int32)),
                         "n_best": pa.array(tops[rows]), "count_sum": pa.array(total[rows])})

    joined = containers.select("box", "pair", "planes").join(counts, "pair").select("box", "planes", "count", "best")
    return joined.groupBy("box").applyInArrow(run, "box long, low int, n_best long, count_sum long")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row ``id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``; and the pairs with their counts."""
    facts, containers = index_pairs(docs, id_col, text_col)
    counts = pair_counts(containers)
    scores = return_scores(containers, counts)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = facts.join(scores, ["box", "low"], "left").select(
        F.col("doc").alias(id_col), *_FACTS, zero("n_best"), zero("count_sum"), "groups_sha256")
    named = counts.select(F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b"), "count", "best")
    return out, named
