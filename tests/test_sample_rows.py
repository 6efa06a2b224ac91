"""Sample rows made in one pass: days, zero rows, following rows, carried columns."""
import pytest
from pyspark.sql import functions as F

from admitflow.functions import text as T
from admitflow.functions import vectors as V
from admitflow.operators import assembly
from admitflow.operators import sequences as seq
from admitflow.operators import text as tx
from admitflow.operators.ordered import with_next_within
from admitflow.plans import fixtures as fx
from admitflow.session import stored

from conftest import rows


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_ids_come_out_of_one_read_of_the_rows(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    days = spark.range(3).select(F.when(F.col("id") < 2, "a").otherwise("z").alias("id"), F.lit(None).cast("int").alias("day_idx"), F.array(F.col("id").cast("double")).alias("features"))
    out = seq.fill_missing(ids, days, width=1, missing_rows=2)
    assert plan(out).count("Range (") == 1
    assert sorted(rows(out, "id", "day_idx", "features", "filled"), key=str) == [
        ("a", None, [0.0], False), ("a", None, [1.0], False), ("b", 0, [0.0], True), ("b", 1, [0.0], True), (None, 0, [0.0], True), (None, 1, [0.0], True)]


def test_following_rows_of_groups_over_many_partitions(spark):
    data = [(g, i) for g, n in (("a", 500), ("b", 1), ("c", 500), ("d", 3)) for i in range(n)] + [(None, 0), (None, 1)]
    df = spark.createDataFrame(data, "g string, o int").repartition(7)
    out = with_next_within(df, ["g"], ["o"], ["o"])
    assert out.columns == ["g", "o", "next_o"] and " Join LeftOuter" not in plan(out)
    last = {"a": 499, "b": 0, "c": 499, "d": 2}
    assert sorted(rows(out, "g", "o", "next_o"), key=str) == sorted([(g, o, None if g is None or o == last[g] else o + 1) for g, o in data], key=str)


def test_words_are_the_split_of_the_normalised_text(spark):
    texts = ["Été, l'eau x y", "a____b  ___", "", None, "İstanbul Σίσυφος ΣΑΣ", "٣٤ x² Ⅷ 漢字。かな 𝒳y 😀z", "\x1c\x1dtab\tnew\n\n\nline-of_words "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.filter(F.split(T.normalise("text"), T._SPACE_RUN), lambda w: (F.length(w) > 0) & ~w.isin(*T.STOP_WORDS))
    for r in df.select(old.alias("old"), T.words("text").alias("new")).collect():
        assert r.old == r.new
    terms = tx.doc_terms(df.withColumn("note_id", F.lit("n")))
    assert "regexp_replace" not in plan(terms)


def test_vectors_of_a_known_width(spark):
    df = spark.createDataFrame([([1.0, 2.5, None],), ([3.0, -1.0, 4.0],), (None,)], "v array<double>")
    st = [F.array(*[F.lit(x) for x in xs]) for xs in ([1.0, 0.5, 2.0], [2.0, 0.0, 4.0])]
    for c in (V.vsum, V.vchecksum):
        for r in df.select(c("v").alias("a"), c("v", 3).alias("b")).collect():
            assert r.a == r.b
    for r in df.select(V.standardise("v", *st, "one").alias("a"), V.standardise("v", *st, "one", 3).alias("b")).collect():
        assert r.a == r.b


def test_collation_reads_the_rows_once(spark):
    members = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "id string, batch_id long")
    days = spark.range(3).select(F.lit("a").alias("id"), F.col("id").cast("int").alias("pos"), F.lit(1.0).alias("s"))
    out = assembly.collate(members, days, ["s"], [F.lit(0.0)])
    assert "Range (" not in plan(out)
    assert sorted(rows(out, "batch_id", "id", "pos", "s", "padded")) == [(0, "a", i, 1.0, False) for i in range(3)] + [(0, "b", i, 0.0, True) for i in range(3)]


def test_columns_go_along_with_the_notes(spark):
    head = spark.createDataFrame([("s_1", "s", True), ("s_2", "s", False)], "id string, subject string, has_note boolean")
    ordered = spark.createDataFrame([("s", 0, "s_9", 2.0), ("s", 1, "s_1", 3.0)], "subject string, note_pos long, note_id string, v double")
    out = assembly.sample_notes(head, ordered, columns={"v": F.lit(0.0)})
    assert sorted(rows(out, "id", "pos", "note_id", "v"), key=str) == [("s_1", 0, "s_9", 2.0), ("s_1", 1, "s_1", 3.0), ("s_2", 0, None, 0.0)]


def test_heads_without_labels(spark):
    cohort = spark.createDataFrame([("s_1", "s", "train"), ("s_2", "s", "test")], "id string, subject string, split string")
    out = assembly.heads(cohort, spark.createDataFrame([("s_1",)], "note_id string"))
    assert sorted(rows(out, "id", "subject", "split", "has_note")) == [("s_1", "s", "train", True), ("s_2", "s", "test", False)]


def test_stored_rows(spark):
    df = spark.createDataFrame([("a", 1, [0.1]), (None, None, None)], "a string, b int, c array<double>")
    assert sorted(rows(stored(df), "a", "b", "c"), key=str) == sorted(rows(df, "a", "b", "c"), key=str)


@pytest.fixture()
def tables(spark, tmp):
    orders = "SELECT * FROM VALUES (7L, 1L, TIMESTAMP'2020-01-01'), (7L, 1L, TIMESTAMP'2020-01-01'), (7L, 2L, TIMESTAMP'2020-01-02'), (9L, CAST(NULL AS BIGINT), TIMESTAMP'2020-01-01'), (19L, 3L, TIMESTAMP'2020-01-01'), (CAST(NULL AS BIGINT), 3L, TIMESTAMP'2020-01-01') AS t(o_orderkey, o_custkey, o_orderdate)"
    lines = [(7, None, "R"), (7, "2020-01-02", "R"), (7, "2020-01-02", "A"), (7, "2020-01-05", "N"), (9, "2020-01-02", "N"), (19, "2020-01-03", "N"), (None, "2020-01-02", "N"), (8, "2020-01-02", "N")]
    made = spark.createDataFrame(lines, "l_orderkey long, s string, l_returnflag string").select(
        "l_orderkey", F.lit(1).alias("l_linenumber"), F.to_timestamp("s").alias("l_shipdate"), "l_returnflag",
        *[F.lit(x).alias(c) for c, x in (("l_quantity", 2.0), ("l_extendedprice", 10.0), ("l_discount", 0.5), ("l_tax", 0.25))])
    spark.sql(orders).write.parquet(f"{tmp}/orders.parquet")
    made.write.parquet(f"{tmp}/lineitem.parquet")
    return tmp


def test_days_are_summed_before_they_meet_the_ids(spark, tables):
    days = fx.day_rows(spark, tables)
    text = plan(days)
    assert text.index("Join Inner") < text.index("Aggregate [l_orderkey")  # the plan's root comes first
    got = sorted((r.id, str(r.day), r.day_idx, r.features[0], r.features[5]) for r in days.collect())
    # day null comes first and has no row; each of two equal orders takes each of its two positions
    assert got == sorted([("1_7", d, i, q, f) for d, at, q, f in (("2020-01-02", (2, 3), 4.0, 1.0), ("2020-01-05", (4, 5), 2.0, 0.0)) for i in at for _ in range(2)]
                         + [("2_7", "2020-01-02", 1, 4.0, 1.0), ("2_7", "2020-01-05", 2, 2.0, 0.0), ("3_19", "2020-01-03", 0, 2.0, 0.0)])
    assert sorted(r.id for r in fx.day_rows(spark, tables, "test").collect()) == ["3_19"]
    only = spark.createDataFrame([("2_7",), ("2_7",), ("x",)], "id string")
    assert sorted(str(r.day) for r in fx.day_vectors(spark, tables, only=only).collect()) == ["2020-01-02", "2020-01-05", "None"]
    assert len(fx.day_vectors(spark, tables).collect()) == 3 * 3 + 2
