"""The next row over ranges of keys: the texts move once."""

from pyspark.sql import functions as F

from admitflow.llm.fingerprints import with_next


def test_texts_move_once(spark):
    rows = [(k // 2, f"t{k:02d}") for k in range(40)] + [(7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "k long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_next(df, "k", "text", lambda x: x.withColumn("u", F.upper("text")), ["text", "u"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["k"], r["text"], r["next_text"], r["next_u"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan  # no row moves again to meet the head of the next range
    ordered = sorted(rows)
    assert got == sorted((*r, n[1], n[1].upper()) for r, n in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert out.columns == ["k", "text", "u", "next_text", "next_u"]
