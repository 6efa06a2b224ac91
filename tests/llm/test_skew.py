"""Groups of near copies, repeated rows, null ids and hot ids: results against
plain Python, and the size of the largest group."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from admitflow.llm import blocks, fingerprints, jaccard_join, sharding, substring_dedup
from tests.llm import corpus


def _near_copies(n, seed=1):
    """n texts that differ from one text in one word, beside n random texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(60)]
    near = []
    for i in range(n):
        text = list(base)
        text[rng.randrange(60)] = f"x{i}"
        near.append((i, " ".join(text)))
    return near + [(n + i, " ".join(word() for _ in range(60))) for i in range(n)]


def test_links_of_a_group_grow_with_its_texts(spark):
    held = {}
    for n in (500, 1000):
        out, links = jaccard_join.link_documents(spark.createDataFrame(_near_copies(n), "doc_id long, text string").repartition(4))
        held[n] = links.count()
        sizes = sorted(r["count"] for r in out.groupBy("component_id").count().collect())
        assert sizes == [1] * n + [n]
    assert held[1000] <= 3 * held[500] and held[1000] <= 6 * 1000


def test_a_text_in_every_task_is_sent_once(spark):
    rng = random.Random(3)
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(i, text if i % 3 == 0 else " ".join(f"r{rng.randrange(9999)}" for _ in range(20))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(8)
    first = jaccard_join._first_pass(docs, 5)
    info = first.filter("kind = 0").selectExpr("a AS doc", "b AS n_shingles", "c AS cls")
    repeated = jaccard_join._repeated(info)
    assert len(repeated[0]) == 1 and repeated[1].tolist() == [0]
    sent = jaccard_join._prefixes(docs, 5, 80, jaccard_join._frequent(first), repeated, 8)
    hot = info.filter("doc = 0").first()["cls"]
    held = [np.frombuffer(r["cls"], np.int64) for r in sent.select("cls").collect()]
    assert sum((c == hot).sum() for c in held) <= 14  # its prefix, once


def test_counts_keep_what_is_frequent_in_a_task(monkeypatch):
    monkeypatch.setattr(jaccard_join, "KEPT", 100)
    counts = jaccard_join.Counts()
    for k in range(20):  # one shingle in every slice, 60 others in one only
        counts.add(np.concatenate([[np.uint64(7)], np.arange(60, dtype=np.uint64) + np.uint64(1000 * (k + 1))]))
    assert len(counts.key) <= 100 and counts.count[counts.key == 7].tolist() == [20]


@pytest.mark.parametrize("ids", ["equal", "null", "one"])
def test_repeated_rows_in_operators(spark, ids):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(20))
    rows = []
    for i in range(900):
        own = " ".join(word() for _ in range(10)) + " " + passage + f" {i}"
        if i % 3 == 0:
            rows.append((0, passage) if ids == "equal" else (None if ids == "null" else 5000, own))
        else:
            rows.append((i, own if i % 2 else " ".join(word() for _ in range(25))))
    docs = corpus.docs(spark, rows, 4)

    if ids != "one":  # rows of one id are one document there
        got = substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed").collect()
        plain = {}
        for i, t in rows:
            plain.setdefault(i, t)
        smallest = min(i for i, t in rows if i is not None and passage in t)
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] in (None, smallest):
                assert r["n_removed"] == 0
            elif ids == "equal" and passage in plain[r["doc_id"]]:
                assert r["n_removed"] >= 20

    placed = sharding.shuffle_into_shards(docs, 7, seed=3).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in placed) == sorted((str(i), t) for i, t in rows)
    counts = [sum(r["shard"] == k for r in placed) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in placed if r["shard"] == k) == list(range(counts[k])) for k in range(7))

    linked, _ = jaccard_join.link_documents(docs)
    assert linked.count() == len(rows)
    fp = fingerprints.fingerprint_documents(docs)
    assert fp.count() == len(rows)


def test_equal_rows_reach_their_block_once_per_batch(spark):
    rows = [(1, "the same text")] * 3000 + [(i, f"text {i}") for i in range(2, 1000)] + [(None, "no id")] * 500
    keyed, _ = blocks.keyed(corpus.docs(spark, rows, 2), "doc_id", "text")
    held = keyed.groupBy("block").count().agg(F.max("count")).first()[0]
    assert held < 60 and keyed.agg(F.sum("copies")).first()[0] == len(rows)


def test_repeated_cuts_long_runs():
    table = pa.table({"x": [1, 2, 3]})
    got = blocks.repeated(table, np.array([1, 25, 10]), most=10).to_pydict()
    assert got == {"x": [1, 2, 2, 2, 3], "copies": [1, 10, 10, 5, 10]}


def test_equal_rows_lie_in_several_parts_of_the_shuffle(spark):
    keys = spark.range(3000).select(F.lit(1).alias("_id"), F.lit(2).alias("_hash"), F.col("id").alias("_copy"))
    placed = sharding.assign(keys, 4, seed=1)
    assert placed.count() == 3000 and placed.groupBy("shard").count().filter("count != 750").count() == 0
