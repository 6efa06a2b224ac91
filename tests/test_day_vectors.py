"""Days made of narrow lines: values against plain Python, and what the plans move."""

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from admitflow.operators import sequences as seq
from admitflow.plans import fixtures as fx

DAY = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders (one twice, one without a customer), lines (some on one day) and vectors (one id twice)."""
    d = str(tmp_path_factory.mktemp("days"))
    orders = [(k, None if k == 3 else k % 4, DAY) for k in range(12)] + [(5, 1, DAY)]
    lines = [(k % 14, 3 * k + k % 5, DAY + dt.timedelta(days=(k * k) % 4), float(k), 10.0 * k, 0.1, 0.2, "RAN"[k % 3]) for k in range(70)]
    rng = np.random.default_rng(3)
    vecs = [(k, [float(v) for v in rng.normal(size=64).astype("float32")]) for k in [*range(8), 2]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double,"
                                 " l_discount double, l_tax double, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, orders, lines, vecs


def _expected(tables):
    """(id, day) -> vector and how many rows of it there are; a vector id that is no row counts not at all."""
    _, orders, lines, vecs = tables
    of, held, told = defaultdict(list), defaultdict(list), defaultdict(list)
    for k, v in vecs:
        of[k].append(v)
    for line in lines:
        held[line[0], line[2].date()] += of[line[1] % len(vecs)]
    for k, c, _ in orders:
        for (o, day), vs in held.items():
            if o == k and vs:
                told[None if c is None else f"{c}_{k}", day].append(np.mean(vs, axis=0))
    return told


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_day_vectors_64(spark, tables, monkeypatch, sent):
    monkeypatch.setattr(fx, "VECTORS_SENT", sent)
    want = _expected(tables)
    got = defaultdict(list)
    for r in fx.day_vectors_64(spark, tables[0]).collect():
        got[r["id"], r["day"]].append(r["features"])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-6)


def test_positions(spark, tables):
    """Each id's days in order; every copy of a row takes every position of its day; no id, no position."""
    want = _expected(tables)
    for rows, keys in ((fx.day_rows_64(spark, tables[0]), set(want)), (fx.day_rows(spark, tables[0]), None)):
        got = defaultdict(list)
        for r in rows.collect():
            got[r["id"], r["day"]].append(r["day_idx"])
        assert None not in {k[0] for k in got}
        if keys is not None:
            assert set(got) == {k for k in keys if k[0] is not None}
        for i in {k[0] for k in got}:
            n = 2 if i == "1_5" else 1
            for at, day in enumerate(sorted(k[1] for k in got if k[0] == i)):
                assert sorted(got[i, day]) == sorted(list(range(at * n, at * n + n)) * n)


def _moves(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


def test_vectors_are_not_exchanged(spark, tables):
    """Pooled days of 64 positions move no vector; only the table of vectors is sent."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = seq.mean_pool(fx.day_vectors_64(spark, tables[0]), "id", "features")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = plan[:plan.index("BroadcastHashJoin")]
    assert "Exchange" not in above and "SortMergeJoin" not in above
