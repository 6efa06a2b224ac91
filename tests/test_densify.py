"""Dense rows of sparse entries."""

from pyspark.sql import functions as F


def test_sorted_entries_are_made_once(spark):
    """the order of a note's entries is found once, not once per entry."""
    from admitflow.functions import vectors as V

    df = spark.createDataFrame([([(3, 2.0), (0, 1.0)],), ([],)], "e array<struct<ix:int,value:double>>").select(V.densify(F.col("e"), 5).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1
    assert [r["v"] for r in df.collect()] == [[1.0, 0.0, 0.0, 2.0, 0.0], [0.0] * 5]
