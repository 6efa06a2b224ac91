"""Packing by an exact round trip, sharding by its margins and its uniformity."""

import numpy as np
import pyarrow as pa
import pytest

from admitflow.llm import packing, sharding
from admitflow.llm.tokens import SPECIAL_MARK, Encoder, vocabulary_path
from admitflow.llm.wordhash import text_buffers
from tests.llm import corpus as C


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def test_ids_are_the_tokenizers(tokenizer):
    import random
    rng = random.Random(3)
    parts = ["a", "é", " ", "  ", "\n", "'s", "1", ".", "<|endoftext|>", "\t", "　", " the", "😀", "\x1c", "\x85", "'ll", " ", "\xa0", ""]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + [None, "", "z" * 5000]
    ids, bounds = Encoder.default().encode(*text_buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    assert SPECIAL_MARK in "<|endoftext|>".encode()


def check_sequences(pieces, limits):
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0] + [r["length"] for r in rows])[:-1].tolist()
        assert sum(r["length"] for r in rows) <= limits.tokens
        assert len(rows) <= limits.segments and sum(r["n_loss"] for r in rows) <= limits.loss_tokens
    return by


def test_round_trip(spark, tokenizer):
    rows = [(i, (t or "") * (1 + i % 40) if t is not None else None) for i, t in C.random_corpus(9, n=150, words=120)]
    pieces = packing.pack(C.docs(spark, rows, 2)).collect()
    limits = packing.Limits()
    by = check_sequences(pieces, limits)
    docs = {}
    for r in pieces:
        docs.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        own = sorted(docs[i], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in own]).tolist()
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert all(r["doc_tokens"] == len(ids) for r in own)
    total = sum(r["length"] for r in pieces)
    assert total / (1024 * len(by)) > 0.95


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 40, waiting=16), packing.Limits(128, 256, 20, waiting=8)])
def test_all_limits_hold(spark, limits):
    rows = C.random_corpus(10, n=80)
    df = C.docs(spark, rows, 1).withColumn("prompt", C_prompt())
    pieces = packing.pack(df, prompt_col="prompt", limits=limits).collect()
    check_sequences(pieces, limits)
    covered = {}
    for r in pieces:
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for spans in covered.values():
        spans.sort()
        assert [s for s, _, _ in spans] == np.cumsum([0] + [n for _, n, _ in spans])[:-1].tolist()
        assert sum(n for _, n, _ in spans) == spans[0][2]


def C_prompt():
    from pyspark.sql import functions as F
    return F.when(F.col("doc_id") % 2 == 0, F.lit("what is asked here ?"))


def test_packing_edges(spark):
    got = packing.pack(C.docs(spark, [(None, None), (1, ""), (1, "")], 1)).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"], bytes(r["ids"])) for r in got) == [
        ("1", 0, 1, b"\0" * 4), ("1", 0, 1, b"\0" * 4), ("None", 0, 1, b"\0" * 4)]
    assert packing.pack(C.docs(spark, [])).count() == 0


def test_matrix_margins():
    parts, blocks = np.array([5, 0, 17, 100, 3]), np.array([40, 1, 44, 40])
    m = sharding.draw_matrix(parts, blocks, 1)
    assert m.sum(axis=1).tolist() == parts.tolist() and m.sum(axis=0).tolist() == blocks.tolist()
    means = np.mean([sharding.draw_matrix(parts, blocks, s) for s in range(400)], axis=0)
    assert np.abs(means - np.outer(parts, blocks) / 125).max() < 0.7


def test_shards(spark):
    rows = C.random_corpus(11, n=300) + [(7, "same"), (7, "same"), (7, "same"), (None, None), (None, None)]
    got = sharding.shuffle_into_shards(C.docs(spark, rows), 7, seed=3, keep=("lang", "score")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_into_shards(C.docs(spark, rows, 5), 7, seed=3, keep=("lang", "score")).collect()
    place = lambda rs: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in rs)
    assert place(again) == place(got)  # however the input is dealt out
    assert sharding.shuffle_into_shards(C.docs(spark, []), 4).count() == 0


def test_shuffle_is_uniform(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    got = sharding.shuffle_into_shards(df, 4, seed=9).toPandas()
    ids = got["doc_id"].to_numpy()
    for column in ("shard", "slot"):
        assert abs(np.corrcoef(ids, got[column].to_numpy())[0, 1]) < 0.06
    counts = np.zeros((10, 4))
    np.add.at(counts, (ids // 400, got["shard"].to_numpy()), 1)
    assert ((counts - 100) ** 2 / 100).sum() < 60  # 27 degrees of freedom


def test_write_shards(spark, tmp):
    df = spark.range(100).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    sharding.write_shards(sharding.shuffle_into_shards(df, 4), tmp + "/shards")
    assert spark.read.parquet(tmp + "/shards").groupBy("shard").count().filter("count = 25").count() == 4
