"""Jaccard similarity join over word n-grams, and its components.

Two documents link when 100 * |x & y| >= 80 * |x | y| over their sets of
``n``-word shingles. The steps:

1. One pass gives each document's set size and set hash, and counts shingles
   that repeat inside a task. Documents with equal sets are one class from here
   on; a class with many rows is sent on by those of its smallest id alone. The
   most frequent shingles (FREQUENT at most) make the order rare-first; the order
   only has to be the same for all documents, so that bound, and that on classes
   with many rows (COPIED), change the work and never the result.
2. The prefix of a set, its ``|x| - ceil(0.8 |x|) + L(x)`` rarest shingles with
   L(x) = max(1, |x| // 20), is sent to hash buckets. Similar sets share
   min(L(x), L(y)) prefix shingles at least. Entries without a partner of
   fitting length go no further, nor do sets with too few entries left.
3. Pairs of neighbours in a bucket that pass the length and positional filters
   are made unique, pass the suffix filter (parities over 256 hash ranges, a
   lower bound of the symmetric difference) and are verified on whole sets.
4. Components join what is linked. Only pairs across components are still open:
   one more round takes some partners each, the last round, after whole
   components, takes all that pass the filters. A pair is verified once, and none inside a component that
   is linked already, so the links of a group of near copies grow with its texts.

A hash that more than BLOCK entries hold is dealt out by class, so no task sees
all its entries: neighbours are taken inside a part, and the last round forms
blocks of about BLOCK entries of one hash, size band and, where one holds much
of it, component; every pair of blocks whose sizes fit and whose components
differ is one group of a task. Walks step over runs of one component.

Edge cases: a text of fewer than n words is one shingle; texts without words
are empty, have size 0 and link with nothing; rows with a null id link with
nothing and have a null component; rows of one id form one component; extra
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.llm import wordhash as wh
from admitflow.llm.components import components, extended
from admitflow.session import cut_lineage, release

NGRAM, PERCENT = 5, 80
FREQUENT, LEAST_COUNT = 1 << 18, 16      # frequent shingles of the order
KEPT = 1 << 20                           # shingles that a task counts at a time
COPIES, COPIED = 16, 1 << 18             # rows from which a class is sent once, and how many such classes
SLICE_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 16 << 20, 64
BLOOM_BITS = 1 << 26                     # a filter before a join; its size is fixed
SIGNATURE = 4                            # 64-bit words of parities
PARTNERS, NEAR = 4, 64                   # partners of an entry, and how far they may stand, before the last round
BLOCK = 4096                             # entries of a hash that meet in one group
SALTS = 32                               # parts of a token with many entries in joins
HOT = np.uint32(1 << 31)                 # mark of an entry whose hash is dealt out, beside its position


def extra_prefix(n):
    """L: shingles that the prefixes of similar sets of about this size share."""
    return np.maximum(1, n // 20)


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection of similar sets of sizes a and b."""
    return -(-(percent * (a + b)) // (100 + percent))


class Sets:
    """Distinct shingles of the rows of a slice, as (row, hash) pairs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        w = wh.split_words(data, offsets, wh.SPACED, lower=True)
        h, counts = wh.hash_words(w), w.counts()
        at = wh.windows_in_rows(w, n)
        rows, hashes = [w.row[at]], [wh.window_hashes(h, n)[at] if len(at) else np.zeros(0, np.uint64)]
        for k in range(1, n):
            short = np.flatnonzero(counts == k)
            if len(short):
                rows.append(short)
                hashes.append(wh.window_hashes(h, k, lane=10 + k)[w.first[short]])
        row, key = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        self.row, self.key = row[new], key[new]
        self.size = np.bincount(self.row, minlength=len(counts))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wh.mix(self.key ^ np.uint64(0x5851F42D4C957F2D)))])
        mark = total[self.first[1:]] - total[self.first[:-1]]
        self.cls = wh.mix(mark * np.uint64(0x9E3779B97F4A7C15) + self.size.astype(np.uint64)).view(np.int64)

    def distinct_rows(self, least: int) -> np.ndarray:
        """One row per class among those with ``least`` shingles."""
        fit = np.flatnonzero(self.size >= least)
        return np.sort(fit[np.unique(self.cls[fit], return_index=True)[1]])


def _slices(batches: Iterator[pa.RecordBatch], n: int):
    for batch in batches:
        data, offsets = wh.text_buffers(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in wh.row_slices(offsets, SLICE_BYTES):
            yield batch.slice(lo, hi - lo), Sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], n)


class Counts:
    """Counts of a task's shingles in bounded memory. When more than KEPT are
    held, those with the smallest counts go and the others keep theirs: what is
    frequent in a task stays, whatever the number of its slices."""

    def __init__(self):
        self.key, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray) -> None:
        key, count = np.unique(key, return_counts=True)
        merged, at = np.unique(np.concatenate([self.key, key]), return_inverse=True)
        self.count = np.bincount(at, np.concatenate([self.count, count]), len(merged)).astype(np.int64)
        self.key, least = merged, 1
        while len(self.key) > KEPT:
            self.key, self.count = self.key[self.count > least], self.count[self.count > least]
            least += 1


def _first_pass(rows: DataFrame, n: int) -> DataFrame:
    """kind 0: id, size and class of each row; kind 1: shingles that repeat in a
    task, counted once per class of a slice."""
    def run(batches):
        counts = Counts()
        for part, s in _slices(batches, n):
            yield pa.record_batch({"kind": pa.array(np.zeros(len(s.size), np.int32)), "a": part.column(0),
                                   "b": pa.array(s.size.astype(np.int64)), "c": pa.array(s.cls)})
            keep = np.zeros(len(s.size), dtype=bool)
            keep[s.distinct_rows(1)] = True
            counts.add(s.key[keep[s.row]])
        key, count = counts.key[counts.count > 1], counts.count[counts.count > 1]
        yield pa.record_batch({"kind": pa.array(np.ones(len(key), np.int32)), "a": pa.array(key.view(np.int64)),
                               "b": pa.array(count), "c": pa.nulls(len(key), pa.int64())})

    return cut_lineage(rows.mapInArrow(run, "kind int, a long, b long, c long"))


def _repeated(info: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes of COPIES rows and more (the COPIED with the most rows, at most),
    sorted, and the smallest id of each: only its rows are sent on."""
    held = info.filter("doc IS NOT NULL AND n_shingles > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.min("doc").alias("doc"))
    rows = held.filter(F.col("k") >= COPIES).orderBy(F.desc("k"), "cls").limit(COPIED).select("cls", "doc").collect()
    cls, doc = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("cls", "doc"))
    order = np.argsort(cls)
    return cls[order], doc[order]


def _sent(s: Sets, doc: pa.Array, least: int, repeated: tuple) -> np.ndarray:
    """Rows of a slice that stand for their class: one per class, and for a class
    with many rows only one of its smallest id."""
    cls, low = repeated
    known, docs = ~np.asarray(doc.is_null()), doc.fill_null(0).to_numpy()
    fit = known & (s.size >= least)
    if len(cls):
        at = np.minimum(np.searchsorted(cls, s.cls), len(cls) - 1)
        fit &= (cls[at] != s.cls) | (low[at] == docs)
    fit = np.flatnonzero(fit)
    return np.sort(fit[np.unique(s.cls[fit], return_index=True)[1]])


def _frequent(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    counted = first.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    rows = counted.orderBy(F.desc("n"), "a").limit(FREQUENT).collect()
    key = np.array([r["a"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.array([r["n"] for r in rows], dtype=np.int64)[order]


def _prefixes(rows: DataFrame, n: int, percent: int, frequent, repeated, buckets: int) -> DataFrame:
    """Per slice and bucket: prefix shingles with class, size and position."""
    given, block = rows.sparkSession.sparkContext.broadcast((frequent, repeated)), BLOCK

    def run(batches):
        (known, count), copied = given.value
        for part, s in _slices(batches, n):
            use = np.zeros(len(s.size), dtype=bool)
            use[_sent(s, part.column(0), 4, copied)] = True  # smaller sets are similar only if equal
            own = use[s.row]
            row, key = s.row[own], s.key[own]
            often = np.zeros(len(key), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                often[known[at] == key] = count[at[known[at] == key]]
            order = np.lexsort((key, often, row))
            row, key = row[order], key[order]
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            size = s.size[row]
            front = pos < size - -(-percent * size // 100) + extra_prefix(size)
            row, key, pos, size, often = row[front], key[front], pos[front].astype(np.uint32), size[front], often[order][front]
            spread, hot = key.copy(), often > block
            dealt = wh.mix(s.cls[row[hot]].view(np.uint64) ^ key[hot]) % (often[hot] // block + 1).astype(np.uint64)
            spread[hot] = wh.mix(key[hot] + dealt)
            pos[hot] |= HOT
            bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, lo = np.unique(bucket[order], return_index=True)
            hi = np.append(lo[1:], len(order))[:len(lo)]
            cut = lambda a: pa.array([a[order[i:j]].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())
            yield pa.record_batch({"bucket": pa.array(found, pa.int32()), "token": cut(key), "cls": cut(s.cls[row]),
                                   "n": cut(size.astype(np.uint32)), "pos": cut(pos)})

    return rows.mapInArrow(run, "bucket int, token binary, cls binary, n binary, pos binary")


def _passes(n1, p1, n2, p2, percent: int):
    """Length and positional filters for a shared shingle at p1 and p2."""
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return fits & (np.minimum(n1 - p1, n2 - p2) >= least_overlap(n1, n2, percent))


def _entries(prefixes: DataFrame, percent: int) -> DataFrame:
    """kind 0: entries (token, class, size, position) with a partner of fitting
    length; kind 1: pairs of classes that stand side by side; kind 2: entries of
    tokens with more than BLOCK, or of those dealt out, whose partners may be
    elsewhere."""
    block = BLOCK

    def run(table: pa.Table) -> pa.Table:
        col = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t)
        token, cls, n, pos = col("token", np.int64), col("cls", np.int64), col("n", np.uint32), col("pos", np.uint32)
        order = np.lexsort((cls, n, token))
        token, cls, n, pos, hot = token[order], cls[order], n[order].astype(np.int64), (pos & ~HOT)[order].astype(np.int64), pos[order] >= HOT
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n, pos, hot = token[new], cls[new], n[new], pos[new], hot[new]
        if len(token):
            _, at, held = np.unique(token, return_inverse=True, return_counts=True)
            hot = hot | (held[at] > block)
        beside = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
        keep = hot.copy()
        keep[1:] |= beside
        keep[:-1] |= beside
        token, cls, n, pos, hot = token[keep], cls[keep], n[keep], pos[keep], hot[keep]
        by_class = np.lexsort((cls, token))
        pairs = [np.zeros((0, 2), np.int64)]
        for order in (np.arange(len(token)), by_class):
            t, c, m, p = token[order], cls[order], n[order], pos[order]
            ok = (t[1:] == t[:-1]) & _passes(m[1:], p[1:], m[:-1], p[:-1], percent)
            pairs.append(np.stack([c[1:][ok], c[:-1][ok]], axis=1))
        both = np.sort(np.concatenate(pairs), axis=1)
        both = np.unique(both, axis=0) if len(both) else both
        k = len(both)
        join = lambda a, b: pa.array(np.concatenate([a, b]), pa.int64())
        return pa.table({"kind": pa.array(np.concatenate([2 * hot, np.ones(k)]).astype(np.int32)), "x": join(token, both[:, 0]),
                         "y": join(cls, both[:, 1]), "n": join(n, np.zeros(k, np.int64)), "pos": join(pos, np.zeros(k, np.int64))})

    return cut_lineage(prefixes.groupBy("bucket").applyInArrow(run, "kind int, x long, y long, n long, pos long"))


def _bloom_places(cls):
    """Two bit positions of each class, in Spark; a class is a mixed hash, so
    its own bits serve."""
    return F.array(*[F.shiftrightunsigned(cls, k).bitwiseAND(BLOOM_BITS - 1) for k in (0, 32)])


def _in_bloom(bloom: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The same positions looked up in tasks."""
    hit = np.ones(len(cls), dtype=bool)
    for k in (0, 32):
        at = (cls.view(np.uint64) >> np.uint64(k)).astype(np.int64) & (BLOOM_BITS - 1)
        hit &= (bloom[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def _bloom(classes: DataFrame, col: str) -> np.ndarray:
    """Bits of a fixed-size filter: BLOOM_BITS / 8 bytes, whatever the input."""
    counted_from_1 = F.transform(_bloom_places(F.col(col)), lambda p: p + 1)  # as the bitmap functions do
    bits = classes.select(F.explode(counted_from_1).alias("p"))
    made = bits.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(BLOOM_BITS // 8 + 8192, dtype=np.uint8)
    for r in made.toLocalIterator():
        part = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
        out[(r["k"] - 1) * 4096:(r["k"] - 1) * 4096 + len(part)] = part
    return out


def _sets(rows: DataFrame, wanted: DataFrame, n: int, repeated) -> DataFrame:
    """``cls, n, members, sig`` of the wanted classes (and few others)."""
    given = rows.sparkSession.sparkContext.broadcast((_bloom(wanted, "cls"), repeated))

    def classes(batches):
        bloom, copied = given.value
        for part, s in _slices(batches, n):
            at = _sent(s, part.column(0), 4, copied)
            at = at[_in_bloom(bloom, s.cls[at])]
            yield pa.record_batch({"cls": pa.array(s.cls[at]), "members": pa.array(
                [s.key[s.first[r]:s.first[r + 1]].tobytes() for r in at], pa.binary())})

    def signed(batches):
        for batch in batches:
            sigs, sizes = [], []
            for blob in batch.column(1).to_pylist():
                key = np.frombuffer(blob, dtype=np.uint64)
                odd = np.bincount((key >> np.uint64(20)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
                sigs.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                sizes.append(len(key))
            sig = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.record_batch({"cls": batch.column(0), "n": pa.array(sizes, pa.int64()), "members": batch.column(1), "sig": pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1) * SIGNATURE, pa.int32()), pa.array(sig))})

    found = rows.mapInArrow(classes, "cls long, members binary")
    found = found.dropDuplicates(["cls"]).join(wanted, "cls", "left_semi")  # copies of a task go before the exchange
    return cut_lineage(found.mapInArrow(signed, "cls long, n long, members binary, sig array<long>"))


def _suffix_filter(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose parities allow the needed overlap."""
    side = lambda k: sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = sum(F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SIGNATURE))
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return both.filter(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs, by their whole sets; both outcomes are returned."""
    def run(batches):
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = int((x[at] == y).sum())
                links.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "link": pa.array(links, pa.bool_())})

    side = lambda k: sets.select(F.col("cls").alias(k), F.col("members").alias(f"m{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb")
    return cut_lineage(joined.mapInArrow(run, "a long, b long, link boolean"))


def _walk(token, cls, n, pos, comp, sig, percent: int, every: bool) -> np.ndarray:
    """Pairs of entries of one token that pass all filters; an entry steps over
    those of its own component that stand in a row."""
    order = np.lexsort((cls, comp, n, token))
    token, cls, n, pos, comp, sig = (v[order] for v in (token, cls, n, pos, comp, sig))
    m = len(token)
    ends = np.append(np.flatnonzero((token[1:] != token[:-1]) | (comp[1:] != comp[:-1])) + 1, m)
    other = ends[np.searchsorted(ends, np.arange(m), side="right")] if m else np.zeros(0, np.int64)
    out, taken, k = [], np.zeros(m, dtype=np.int64), 0
    left, right = np.arange(m), other.copy()
    while len(left) and (every or k < NEAR):
        k += 1
        ok = right < m
        left, right = left[ok], right[ok]
        ok = (token[left] == token[right]) & (100 * n[left] >= percent * n[right])  # sizes grow within a token
        left, right = left[ok], right[ok]
        differ = comp[left] != comp[right]
        i, j = left[differ], right[differ]
        ok = _passes(n[i], pos[i], n[j], pos[j], percent)
        i, j = i[ok], j[ok]
        ok = _near(n[i], sig[i], n[j], sig[j], percent)
        if not every:
            ok &= (taken[i] < PARTNERS) & (taken[j] < 4 * PARTNERS)
        i, j = i[ok], j[ok]
        np.add.at(taken, i, 1)
        np.add.at(taken, j, 1)
        out.append(np.sort(np.stack([cls[i], cls[j]], axis=1), axis=1))
        if sum(map(len, out)) > 1_000_000:
            out = [np.unique(np.concatenate(out), axis=0)]
        right = np.where(differ, right + 1, other[right])
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _across(x: tuple, y: tuple, percent: int) -> np.ndarray:
    """Pairs of an entry of block x and one of block y that pass all filters."""
    out = [np.zeros((0, 2), np.int64)]
    if len(x[0]) > len(y[0]):
        x, y = y, x
    cls, n, pos, comp, sig = y
    for k in range(len(x[0])):
        c, m, p, own, mark = (v[k] for v in x)
        j = np.flatnonzero((comp != own) & _passes(m, p, n, pos, percent))
        j = j[_near(m, mark, n[j], sig[j], percent)]
        if len(j):
            out.append(np.sort(np.stack([np.full(len(j), c), cls[j]], axis=1), axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _near(n1, sig1, n2, sig2, percent: int):
    """Suffix filter: the parities allow the needed overlap."""
    return np.bitwise_count(sig1 ^ sig2).sum(axis=1) <= n1 + n2 - 2 * least_overlap(n1, n2, percent)


def _pairs_of_groups(placed: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs inside each ``bucket`` of entries: all of them, or those between its
    sides 1 and 2 where it has such."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = lambda c: table.column(c).to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, SIGNATURE).view(np.uint64)
        cols, side = (*(col(c) for c in ("cls", "n", "pos", "comp")), sig), col("side")
        if side.any():
            pairs = _across(*(tuple(v[side == k] for v in cols) for k in (1, 2)), percent)
        else:
            pairs = _walk(col("token"), *cols, percent, every)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    rows = placed.select("bucket", "token", "cls", F.col("n").cast("long").alias("n"), "pos", "comp", "sig", F.col("side").cast("int").alias("side"))
    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def _spread(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of entries with a table about tokens with many (a row for BLOCK
    entries, at most): its rows are repeated and the entries dealt out over the
    copies, so a token's entries are no single task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def _block_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Groups of the last round for tokens with many entries: each is a block,
    or two blocks as sides 1 and 2."""
    # similar sizes are in one band or in two beside each other
    placed = cut_lineage(placed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")))
    held = placed.groupBy("token", "band", "comp").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    much = F.col("k") >= max(1, BLOCK // 2)
    groups = held.withColumn("own", F.when(much, F.col("comp"))).groupBy("token", "band", "own").agg(
        F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = groups.withColumn("parts", F.ceil(F.col("k") / BLOCK).cast("int"))
    blocks = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.monotonically_increasing_id())
    blocks = cut_lineage(blocks)
    x, y = (blocks.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("band", "own", "lo", "hi", "block")]) for k in (1, 2))
    near = F.abs(F.col("band1") - F.col("band2")) <= 1
    fits = (100 * F.col("hi1") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo1"))
    differ = F.col("own1").isNull() | F.col("own2").isNull() | (F.col("own1") != F.col("own2"))
    pairs = x.join(y, "token").filter((F.col("block1") <= F.col("block2")) & near & fits & differ)
    pairs = cut_lineage(pairs.select("block1", "block2").withColumn("bucket", F.monotonically_increasing_id()))
    large = held.filter(much).select("token", "band", F.col("comp"), F.col("comp").alias("own"))
    rows = _spread(placed, large, ["token", "band", "comp"], "left")
    rows = _spread(rows, groups.select("token", "band", F.col("own").alias("_own"), "parts"), ["token", "band"]).filter(F.col("own").eqNullSafe(F.col("_own"))).drop("_own")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cls", "token"), F.col("parts")).cast("int"))
    named = blocks.select("token", "band", F.col("own").alias("_own"), "part", "block")
    rows = _spread(rows, named, ["token", "band", "part"]).filter(F.col("own").eqNullSafe(F.col("_own")))
    rows = rows.select("block", "token", "cls", "n", "pos", "comp").join(sets.select("cls", "sig"), "cls")
    alone = F.col("block1") == F.col("block2")
    first = rows.join(pairs.withColumnRenamed("block1", "block"), "block").withColumn("side", F.when(F.col("block") == F.col("block2"), 0).otherwise(1)).drop("block2")
    second = rows.join(pairs.filter(~alone).withColumnRenamed("block2", "block"), "block").withColumn("side", F.lit(2)).drop("block1")
    return first.unionByName(second)


def _open_pairs(entries: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, every: bool, buckets: int, hot: bool) -> DataFrame:
    """Pairs across components that pass all filters: all of them, or some
    partners of each entry. ``hot``: there are tokens with many entries."""
    def mixed(kind: int) -> tuple[DataFrame, DataFrame]:
        placed = entries.filter(F.col("kind") == kind).join(comps, F.col("cls") == F.col("node"), "left").select(
            "token", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp"))
        tokens = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("held"))
        return placed, tokens.filter("lo < hi").select("token", "held")

    placed, tokens = mixed(0)
    placed = placed.join(tokens, "token", "left_semi").join(sets.select("cls", "sig"), "cls")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    pairs = _pairs_of_groups(placed.withColumn("side", F.lit(0)), percent, every)
    if hot:
        placed, tokens = mixed(2)
        placed = _spread(placed, tokens, ["token"])
        if every:
            placed = _block_pairs(placed.drop("held"), sets, percent)
        else:
            part = F.pmod(F.xxhash64("cls", "token"), F.ceil(F.col("held") / BLOCK))
            placed = placed.withColumn("bucket", F.xxhash64("token", part)).withColumn("side", F.lit(0)).join(sets.select("cls", "sig"), "cls")
        pairs = pairs.unionByName(_pairs_of_groups(placed, percent, every))
    return pairs.distinct()


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
                   percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``id, n_shingles, component_id`` of every row, and the verified links
    between classes (``a, b``; a class is the hash of a set)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    first = _first_pass(rows, ngram)
    info = first.filter("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n_shingles"), F.col("c").alias("cls"))
    repeated = _repeated(info)
    found = _entries(_prefixes(rows, ngram, percent, _frequent(first), repeated, buckets), percent)
    entries = found.filter("kind != 1").select("kind", F.col("x").alias("token"), F.col("y").alias("cls"), "n", "pos")
    hot = not found.filter("kind = 2").isEmpty()
    # a partner may be smaller: ceil(0.8 n) shingles at least
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 20))
    wanted = entries.groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).filter(F.col("k") >= least).select("cls")
    sets = _sets(rows, wanted, ngram, repeated)
    entries = entries.join(sets.select("cls"), "cls", "left_semi")
    release(rows.sparkSession)  # prefixes and sets are in their checkpoints
    pairs = found.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    tested = _verify(_suffix_filter(pairs, sets, percent), sets, percent)
    links = tested.filter("link").select("a", "b")
    # two rounds name most of each component, which is enough where entries take some partners
    comps = cut_lineage(components(links, "a", "b", rounds=2))
    more = _open_pairs(entries, comps, sets, percent, False, buckets, hot).join(tested, ["a", "b"], "left_anti")
    tested = tested.unionByName(_verify(more, sets, percent))
    release(rows.sparkSession)
    # whole components: all pairs between fragments of one would grow with the square of a group
    comps = cut_lineage(extended(comps, tested.filter("link"), "a", "b"))
    release(rows.sparkSession)
    more = _open_pairs(entries, comps, sets, percent, True, buckets, hot).join(tested, ["a", "b"], "left_anti")
    last = _verify(more, sets, percent)
    release(rows.sparkSession)
    links = tested.unionByName(last).filter("link").select("a", "b")
    # rows of one id hold together: link the classes that share one
    shared = info.filter("doc IS NOT NULL AND n_shingles > 0").groupBy("doc").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.collect_set("cls").alias("all"))
    shared = shared.filter("a < b").select("a", F.explode("all").alias("b")).filter("a < b")
    comps = extended(comps, last.filter("link").select("a", "b").unionByName(shared), "a", "b")
    lowest = info.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc").alias("low"))
    named = lowest.join(comps, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = named.join(smallest, "component").select("cls", "component_id")
    alone = F.col("n_shingles") == 0
    out = info.join(by_class, "cls", "left").select(
        F.col("doc").alias(id_col), F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("doc").isNull(), F.lit(None)).when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    return out, links
