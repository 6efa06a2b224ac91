"""Document quality by attention-based multiple-instance learning.

Only whole documents carry labels, so a document is a bag of passages of
``PASSAGE_WORDS`` words. Every passage of the whole text is encoded: the means of
learned embeddings of its hashed n-grams - three characters of a word, words and
pairs of words, and the shapes of neighbouring words - beside shares of character
classes, word lengths and repetition, go through one learned layer. Gated
attention, learned from the document labels, weighs the passages, and the
weighted passage representation is scored. The model is numpy and is trained on
``LIMIT`` labelled documents at most, of each ``BAG_PASSAGES`` passages at most,
evenly spaced; scoring runs in tasks over all passages of all documents.

Edge cases: a null or blank text is a bag of one empty passage and is scored
like any other; labels of unknown or null ids and null labels are not used; if
no label is left, or all are alike, every score is that share of ones (0.5
without labels); extra columns stay, but for one named ``score``; repeated rows
are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from admitflow.llm import samples
from admitflow.llm import wordhash as wh

PASSAGE_WORDS, LIMIT, SEED = 64, 6000, 11
HIDDEN, GATES, EPOCHS, BAGS, RATE, DECAY = 16, 8, 12, 64, 0.01, 1e-4
BAG_PASSAGES = 16                       # passages of a training document
BUCKETS, EMBED, KINDS = 1 << 13, 8, 3   # hashed n-grams, width of their embeddings, kinds of them
SLICE_BYTES, GRAMS_AT_A_TIME = 1 << 20, 1 << 18
# character classes of the encoder, ASCII bytes each; the last one is all bytes beyond ASCII
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "|", "#$%&*@^~<>=+_\\/{}[]",
           ".?", ",;:", "\"'()-`", "\n", " \t\r")


def _class_of() -> np.ndarray:
    table = np.full(256, len(CLASSES), dtype=np.uint8)
    for k, chars in enumerate(CLASSES):
        table[[ord(c) for c in chars]] = k
    return table


_CLASS = _class_of()
FEATURES = len(CLASSES) + 1 + 8


@dataclass
class Bag:
    """Passages: their shares, and per kind the buckets of their n-grams (those
    of passage i stand from ``ends[i]`` to ``ends[i + 1]``)."""

    x: np.ndarray
    grams: list[np.ndarray]
    ends: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.x)

    def take(self, at: np.ndarray) -> Bag:
        parts = [[g[e[i]:e[i + 1]] for i in at] for g, e in zip(self.grams, self.ends, strict=True)]
        return Bag(self.x[at], [np.concatenate(p) if p else g[:0] for p, g in zip(parts, self.grams, strict=True)],
                   [np.concatenate([[0], np.cumsum([len(x) for x in p])]).astype(np.int64) for p in parts])

    @classmethod
    def joined(cls, bags: list[Bag]) -> Bag:
        ends = [np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.ends[k]) for b in bags]))]).astype(np.int64) for k in range(KINDS)]
        return cls(np.concatenate([b.x for b in bags]), [np.concatenate([b.grams[k] for b in bags]) for k in range(KINDS)], ends)

    def pack(self) -> bytes:
        head = np.array([len(self.x), *map(len, self.grams)], dtype=np.int64)
        return b"".join([head.tobytes(), self.x.astype(np.float32).tobytes(), *[e.tobytes() for e in self.ends], *[g.tobytes() for g in self.grams]])

    @classmethod
    def unpack(cls, blob: bytes) -> Bag:
        n, *held = np.frombuffer(blob, np.int64, 1 + KINDS).tolist()
        at = 8 * (1 + KINDS)
        x = np.frombuffer(blob, np.float32, n * FEATURES, at).reshape(n, FEATURES)
        at += x.nbytes
        ends = []
        for _ in range(KINDS):
            ends.append(np.frombuffer(blob, np.int64, n + 1, at))
            at += 8 * (n + 1)
        grams = []
        for k in held:
            grams.append(np.frombuffer(blob, np.uint16, k, at))
            at += 2 * k
        return cls(x, grams, ends)


def _bucket(h: np.ndarray) -> np.ndarray:
    """The upper 13 bits (BUCKETS) of mixed 32-bit values, in place."""
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - 13)
    return h.astype(np.uint16)


def _grams(data: np.ndarray, w: wh.Words, h: np.ndarray, kind: np.ndarray, passage: np.ndarray, n: int) -> tuple[list, list]:
    """Buckets of the n-grams of every passage, by kind."""
    size = w.end - w.start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - w.start, size)  # bytes of words
    low, ends = data[at].astype(np.uint32), np.cumsum(size)
    chars = low << np.uint32(8)
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[ends[:-1]] = 0  # a word's edges
    after[ends - 1] = 0
    chars |= before << np.uint32(16)
    chars |= after
    pair = np.flatnonzero(passage[1:] == passage[:-1])  # words with a next one in their passage
    words = np.concatenate([h, h[pair] * np.uint64(3) + h[pair + 1]])
    order = np.argsort(np.concatenate([passage, passage[pair]]), kind="stable")
    shape = kind[w.end[pair] - 1].astype(np.uint32) << np.uint32(8) | kind[w.start[pair + 1]].astype(np.uint32) << np.uint32(4)
    shape |= np.minimum(size[pair + 1], 15).astype(np.uint32)
    count = np.bincount(passage, minlength=n)
    pairs = np.bincount(passage[pair], minlength=n)
    held = [np.bincount(passage, size, minlength=n), count + pairs, pairs]
    found = [_bucket(chars), _bucket((words[order] >> np.uint64(32)).astype(np.uint32)), _bucket(shape)]
    return found, [np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in held]


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[Bag, np.ndarray]:
    """The passages of all rows, and the first passage of each row."""
    w = wh.split_words(data, offsets, wh.SPACED)
    rows, n = len(offsets) - 1, w.counts()
    per = np.maximum(1, -(-n // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros((first[-1], FEATURES), dtype=np.float32)
    if not len(w):
        return Bag(out, [np.zeros(0, np.uint16)] * KINDS, [np.zeros(len(out) + 1, np.int64)] * KINDS), first
    place = np.arange(len(w)) - w.first[w.row]
    passage = first[w.row] + place // PASSAGE_WORDS
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    at, stops = passage[begins], np.append(begins[1:], len(w))
    lo, hi = w.start[begins], w.end[stops - 1]
    size, words = np.maximum(hi - lo, 1), (stops - begins).astype(np.float64)
    kind = _CLASS[data]
    for k in range(len(CLASSES) + 1):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        out[at, k] = (total[hi] - total[lo]) / size
    h, length = wh.hash_words(w), (w.end - w.start).astype(np.float64)
    share = lambda flags: np.add.reduceat(flags.astype(np.float64), begins) / words
    mean = share(length)
    head, tail = kind[w.start], kind[w.end - 1]
    again = wh.window_hashes(h, 4)
    pair = np.lexsort((again, w.row[: len(again)]))
    repeat = np.zeros(len(w), dtype=bool)
    repeat[pair[1:]] = (again[pair[1:]] == again[pair[:-1]]) & (w.row[pair[1:]] == w.row[pair[:-1]])
    order = np.lexsort((h, passage))
    distinct = np.ones(len(w), dtype=bool)
    distinct[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (passage[order[1:]] != passage[order[:-1]])
    extra = (np.log1p(words) / 4, np.log1p(mean) / 3, np.sqrt(np.maximum(share(length**2) - mean**2, 0)) / 10,
             share(head == 0), share((tail == 5) | (tail == 3)), share(length == 1), share(repeat), share(distinct))
    for k, values in enumerate(extra):
        out[at, len(CLASSES) + 1 + k] = values
    return Bag(out, *_grams(data, w, h, kind, passage, len(out))), first


@dataclass
class Model:
    """Gated attention over encoded passages."""

    mean: np.ndarray
    scale: np.ndarray
    base: float
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def embed(self, bag: Bag) -> np.ndarray:
        """Means of the embeddings of each kind, side by side."""
        out = np.zeros((len(bag), KINDS * EMBED), dtype=self.p["W"].dtype)
        for k in range(KINDS):
            ends, table = bag.ends[k], self.p[f"E{k}"]
            for lo, hi in wh.row_slices(ends, GRAMS_AT_A_TIME):  # bounds the embeddings in memory
                some = lo + np.flatnonzero(np.diff(ends[lo:hi + 1]))
                if len(some):
                    total = np.add.reduceat(table[bag.grams[k][ends[lo]:ends[hi]]], ends[some] - ends[lo], axis=0)
                    out[some, k * EMBED:(k + 1) * EMBED] = total / (ends[some + 1] - ends[some])[:, None]
        return out

    def forward(self, bag: Bag, first: np.ndarray) -> dict[str, np.ndarray]:
        """All values of documents that start at passages ``first[:-1]``."""
        p, starts = self.p, first[:-1]
        x = np.concatenate([np.clip((bag.x - self.mean) / self.scale, -8, 8), self.embed(bag)], axis=1).astype(p["W"].dtype)
        hid = np.tanh(x @ p["W"] + p["b"])
        tan, gate = np.tanh(hid @ p["V"]), 1 / (1 + np.exp(-(hid @ p["U"])))
        raw = (tan * gate) @ p["w"]
        owner = np.repeat(np.arange(len(starts)), np.diff(first))
        e = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
        att = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(att[:, None] * hid, starts, axis=0)
        return {"x": x, "hid": hid, "tan": tan, "gate": gate, "owner": owner, "att": att, "z": z,
                "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def score(self, bag: Bag, first: np.ndarray) -> np.ndarray:
        if not self.p:
            return np.full(len(first) - 1, self.base)
        return self.forward(bag, first)["score"].astype(np.float64)

    def gradient(self, bag: Bag, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f, p, starts = self.forward(bag, first), self.p, first[:-1]
        dlogit = (f["score"] - y) / len(y)
        dz = dlogit[:, None] * p["c"]
        datt = (dz[f["owner"]] * f["hid"]).sum(axis=1)
        draw = f["att"] * (datt - np.add.reduceat(f["att"] * datt, starts)[f["owner"]])
        dtan = draw[:, None] * p["w"] * f["gate"] * (1 - f["tan"] ** 2)
        dgate = draw[:, None] * p["w"] * f["tan"] * f["gate"] * (1 - f["gate"])
        dhid = f["att"][:, None] * dz[f["owner"]] + dtan @ p["V"].T + dgate @ p["U"].T
        dpre = dhid * (1 - f["hid"] ** 2)
        out = {"W": f["x"].T @ dpre, "b": dpre.sum(0), "V": f["hid"].T @ dtan, "U": f["hid"].T @ dgate,
               "w": (f["tan"] * f["gate"]).T @ draw, "c": f["z"].T @ dlogit, "d": dlogit.sum(keepdims=True)}
        dx = dpre @ p["W"].T
        for k in range(KINDS):
            n = np.diff(bag.ends[k])
            each = dx[:, FEATURES + k * EMBED:FEATURES + (k + 1) * EMBED] / np.maximum(n, 1)[:, None]
            row = np.repeat(np.arange(len(n)), n)
            out[f"E{k}"] = np.stack([np.bincount(bag.grams[k], each[row, j], BUCKETS) for j in range(EMBED)], axis=1)
        return out


class Adam:
    """The usual adaptive step over a dictionary of parameters."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, decay: float):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            d = d + self.decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def train(bags: list[Bag], y: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Fits a model to the passages of documents and their labels."""
    if not bags or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), float(y.mean()) if len(y) else 0.5)
    rng, every = np.random.default_rng(seed), np.concatenate([b.x for b in bags])
    n = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"W": n(FEATURES + KINDS * EMBED, HIDDEN), "b": np.zeros(HIDDEN), "V": n(HIDDEN, GATES), "U": n(HIDDEN, GATES),
         "w": n(GATES), "c": n(HIDDEN), "d": np.zeros(1)}
    p |= {f"E{k}": rng.normal(0, 0.1, (BUCKETS, EMBED)).astype(np.float32) for k in range(KINDS)}
    model = Model(every.mean(0), every.std(0) + 1e-3, float(y.mean()), {k: v.astype(np.float32) for k, v in p.items()})
    adam = Adam(model.p, RATE, DECAY)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BAGS):
            take = order[lo:lo + BAGS]
            own = [bags[i] for i in take]
            first = np.concatenate([[0], np.cumsum([len(b) for b in own])])
            adam.step(model.gradient(Bag.joined(own), first, y[take]))
    return model


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, label: str = "quality",
        id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, seed: int = SEED) -> Model:
    """Trains on ``limit`` labelled documents at most, of those whose ``id``
    fulfils ``train_on``."""
    known = samples.labelled(labels, label)
    sample = samples.draw(known if train_on is None else known.filter(train_on), limit, seed)
    texts = samples.texts_of(docs, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wh.text_buffers(batch.column(2))
            for lo, hi in wh.row_slices(offsets, SLICE_BYTES):
                bag, first = encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                some = [bag.take(i + np.unique(np.linspace(0, j - i - 1, BAG_PASSAGES).astype(np.int64))).pack()
                        for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch({"id": batch.column(0)[lo:hi], "label": batch.column(1)[lo:hi].cast(pa.int32()), "x": pa.array(some, pa.binary())})

    rows = sorted(texts.select("id", "label", "text").mapInArrow(run, "id long, label int, x binary").collect())
    bags = [Bag.unpack(bytes(r["x"])) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], dtype=np.float64), seed)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: better), which
    replaces a column of that name."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wh.text_buffers(batch.column(batch.schema.get_field_index(text_col)))
            for lo, hi in wh.row_slices(offsets, SLICE_BYTES):
                bag, first = encode(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                yield part.append_column("score", pa.array(given.value.score(bag, first), pa.float64()))

    if docs.schema[at].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} must be a string column")
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
