"""Toxicity by non-negative positive-unlabelled learning.

The classifiers see confirmed toxic documents and unlabelled ones, never
confirmed clean ones. With the class prior pi, the risk is
pi * E_pos[l(f)] + max(0, E_unl[l(-f)] - pi * E_pos[l(-f)]), with the sigmoid
loss; where the second part falls below zero, its step is reversed. The
prior is the share of toxic rows among all labelled training rows.

Features are the presence of words and of word beginnings (4, 5 and 6 bytes),
lower-cased, by their 64-bit hashes. The ``FEATURES`` that differ most between
the two samples are kept. ``MODELS`` linear classifiers, started from different
seeds, are averaged. Training sees ``LIMIT`` documents of each kind at most;
scoring runs in tasks over all words of all documents.

Edge cases: a null or blank text has no features and gets the bias alone; null
ids and labels are not learned from; without a confirmed toxic document every
score is 0; extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm import samples
from admitflow.llm import wordhash as wh

LIMIT, FEATURES, LEAST_DOCS, MODELS, SEED = 6000, 2048, 5, 3, 23
EPOCHS, BATCH, RATE, DECAY, SLACK, SURE = 60, 256, 0.03, 1e-5, 0.0, 3.5
BEGINNINGS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature hash) pairs of a slice."""
    w = wh.split_words(data, offsets, wh.ALNUM, lower=True)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = w.end - w.start
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))[w.start]
    rows, hashes = [w.row], [wh.hash_words(w)]
    for k in BEGINNINGS:
        own = size > k
        rows.append(w.row[own])
        hashes.append(wh.mix((lanes[own] & np.uint64((1 << (8 * k)) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def known_features(keys: np.ndarray, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places in the sorted ``keys`` of the features found there."""
    if not len(keys):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    return row[hit], at[hit]


@dataclass
class Model:
    keys: np.ndarray      # sorted feature hashes
    weights: np.ndarray   # one row per classifier
    bias: np.ndarray

    def score(self, row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.bias):
            return np.zeros(rows)
        row, at = known_features(self.keys, row, h)
        logits = [np.bincount(row, weights=w[at], minlength=rows) + b for w, b in zip(self.weights, self.bias, strict=True)]
        return np.mean([1 / (1 + np.exp(-np.clip(z, -60, 60))) for z in logits], axis=0)


def first_weights(pos: list[np.ndarray], unl: list[np.ndarray], n: int) -> np.ndarray:
    """Log-odds of the features that clearly mark one sample (SURE standard
    errors), 0 for the others: the sigmoid loss is flat far from the border, so
    training starts with toxic documents on the right side."""
    p, u = (np.bincount(np.concatenate(d), minlength=n) if d else np.zeros(n) for d in (pos, unl))
    p, u = (p + 0.5) / (len(pos) + 1), (u + 0.5) / (len(unl) + 1)
    z = (p - u) / np.sqrt(p * (1 - p) / (len(pos) + 1) + u * (1 - u) / (len(unl) + 1))
    return np.where(np.abs(z) >= SURE, np.log(p / u), 0.0)


def train_one(pos: list[np.ndarray], unl: list[np.ndarray], n: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """One linear classifier under the non-negative risk estimator."""
    rng = np.random.default_rng(seed)
    w, b = first_weights(pos, unl, n) + rng.normal(0, 0.01, n), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(n + 1), np.zeros(n + 1), 0

    def grad(docs, sign, scale):
        """Mean sigmoid loss of sign * f over ``docs``, and its scaled gradient."""
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        s = 1 / (1 + np.exp(np.clip(sign * (np.bincount(row, weights=w[flat], minlength=len(docs)) + b), -60, 60)))
        d = -sign * scale * s * (1 - s) / len(docs)
        return s.mean(), np.append(np.bincount(flat, weights=d[row], minlength=n), d.sum())

    steps = max(len(pos), len(unl)) // BATCH + 1
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        p_order, u_order = rng.permutation(len(pos)), rng.permutation(len(unl))
        for p_take, u_take in zip(np.array_split(p_order, steps), np.array_split(u_order, steps), strict=True):
            if not len(p_take) or not len(u_take):
                continue
            p_docs, u_docs = [pos[i] for i in p_take], [unl[i] for i in u_take]
            _, g_pos = grad(p_docs, 1.0, prior)
            p_neg, g_pneg = grad(p_docs, -1.0, prior)
            u_neg, g_unl = grad(u_docs, -1.0, 1.0)
            rest = g_unl - g_pneg
            g = g_pos + rest if u_neg - prior * p_neg >= -SLACK else -rest
            g = g + DECAY * np.append(w, 0.0)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, b


def _slices(batch: pa.RecordBatch, text: str):
    data, offsets = wh.text_buffers(batch.column(batch.schema.get_field_index(text)))
    for lo, hi in wh.row_slices(offsets):
        yield lo, hi, *features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, label: str = "toxic",
        id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, seed: int = SEED) -> Model:
    """Trains on ``limit`` confirmed toxic and ``limit`` unlabelled documents at
    most, of those whose ``id`` fulfils ``train_on``."""
    chosen = F.lit(True) if train_on is None else train_on
    known = samples.labelled(labels, label).filter(chosen)
    prior = known.agg(F.avg("label").alias("p")).first()["p"]
    if not prior:
        return Model(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))
    positive = samples.draw(known.filter("label = 1").select("id", F.lit(1).alias("kind")), limit, seed)
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").filter(chosen).distinct()
    unlabelled = samples.draw(ids.select("id", F.lit(0).alias("kind")), limit, seed + 1)
    texts = samples.texts_of(docs, positive.unionByName(unlabelled), id_col, text_col).select("id", "kind", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, row, h in _slices(batch, "text"):
                keys, ix = np.unique(h, return_inverse=True)
                pos = np.bincount(ix, weights=kind[lo + row], minlength=len(keys))
                yield pa.record_batch({"h": pa.array(keys.view(np.int64)), "p": pa.array(pos.astype(np.int64)),
                                       "n": pa.array(np.bincount(ix, minlength=len(keys)).astype(np.int64))})

    sizes = {r["kind"]: r["count"] for r in texts.groupBy("kind").count().collect()}
    n_pos, n_unl = sizes.get(1, 0), max(1, sizes.get(0, 0))
    if not n_pos:
        return Model(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))
    p, u = F.col("p") / n_pos, (F.col("n") - F.col("p")) / n_unl
    differ = F.abs(p - u) / F.sqrt(p * (1 - p) / n_pos + u * (1 - u) / n_unl + F.lit(1.0 / n_pos / n_unl))
    counted = texts.mapInArrow(count, "h long, p long, n long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    best = counted.filter(F.col("n") >= LEAST_DOCS).orderBy(differ.desc(), "h").limit(FEATURES).select("h").collect()
    keys = np.sort(np.array([r["h"] for r in best], dtype=np.int64).view(np.uint64))

    def chosen_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, h in _slices(batch, "text"):
                row, at = known_features(keys, row, h)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.record_batch({"id": batch.column(0)[lo:hi], "kind": batch.column(1)[lo:hi].cast(pa.int32()), "at": pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(at, pa.int32()))})

    rows = sorted(texts.mapInArrow(chosen_features, "id long, kind int, at array<int>").collect(), key=lambda r: (r["kind"], r["id"]))
    pos, unl = ([np.array(r["at"], dtype=np.int64) for r in rows if r["kind"] == k] for k in (1, 0))
    fitted = [train_one(pos, unl, len(keys), float(prior), seed + k) for k in range(MODELS)]
    return Model(keys, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row (0 to 1, higher: more toxic)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, h in _slices(batch, "text"):
                yield pa.record_batch({"id": batch.column(0)[lo:hi], "score": pa.array(given.value.score(row, h, hi - lo))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
