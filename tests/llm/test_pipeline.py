"""The pipeline's stages against plain Python on a small corpus, and the queries' columns."""

import pytest
from pyspark.sql import functions as F

from tests.llm import corpus as C

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = C.random_corpus(12, n=40, words=30)
    lines = stages["line_dedup"](spark, frame(spark, rows), SF)
    want = C.brute_lines(rows)
    assert lines.columns == COLUMNS
    assert {r["doc_id"]: r["text"] or "" for r in lines.collect()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] is not None)
    near = stages["near_duplicates"](spark, frame(spark, rows), SF)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, c in C.brute_components(rows)[0].values()})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows += [(900, "so it says " + items[0][1] + " and more"), (901, items[1][1].upper()), (None, None), (None, items[2][1])]
    clean = stages["decontamination"](spark, frame(spark, rows), SF)
    hit = C.brute_contamination([(k, t) for k, (_, t) in enumerate(rows)], items)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for k, (i, _) in enumerate(rows) if not hit[k][1])
    assert near.columns == clean.columns == COLUMNS


def test_empty_tables(spark):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == COLUMNS


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    kept = out.select("doc_id").distinct().count()
    assert 0.5 * n < kept < n
    assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).filter("n != t").count() == 0


def test_digest_columns(spark):
    from admitflow.llm.queries import QUERIES
    want = {"op1": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op3": "doc_id size text_crc32 law shard slot grown_shard",
            "op5": "doc_id held_out score predicted", "op10": "page_id url text n_chars"}
    for name, query in QUERIES.items():
        if (columns := want.get(name.split("_")[0])):
            df = query(spark, SF)
            assert set(columns.split()) <= set(df.columns)
            rows = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op10') else 'documents'}.parquet").count()
            assert df.select("page_id" if name.startswith("op10") else "doc_id").distinct().count() == rows


def test_repeated_rows_stay_once(spark):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text)] * 20 + [(2, text)] * 3 + [(1, "other part of it")] + [(None, text)] * 4 + [(None, "x y"), (5, None), (5, None), (6, "")]
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in stage(spark, frame(spark, rows), SF).collect())
    assert got == sorted([("1", text), ("1", "other part of it"), ("None", text), ("None", "x y"), ("5", "None"), ("6", "")])
