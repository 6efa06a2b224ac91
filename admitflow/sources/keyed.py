"""Store for keyed reads (S4 S9 J11): rows in key order with Bloom filters.

A Parquet folder that is read by key alone is scanned whole: every row group's
minimum and maximum span all keys. Here rows are range-partitioned and sorted by
key, in row groups of bounded size, and each row group has a Bloom filter of its
keys. A read of some keys then skips the row groups whose range or filter rules
them out. Several rows of a key: the last by ``order`` wins, if given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: keys that are sent to the scan; more are joined
PUSHED = 1000
#: values of one pushed IN that Spark turns into equalities (its default)
_IN = 10


def write_keyed(df: DataFrame, path: str, key: str = "note_id", order: str | None = None, row_group_bytes: int = 8 << 20,
                keys_per_group: int = 100_000, mode: str = "overwrite") -> str:
    """Writes ``df`` for reads by ``key``; null keys are refused."""
    if order is not None:
        value = F.struct(*[c for c in df.columns if c != key])
        df = df.groupBy(key).agg(F.max_by(value, order).alias("_v")).select(key, "_v.*")
    bad = F.raise_error(F.lit(f"null in {key}")).cast("boolean")
    df = df.filter(F.when(F.col(key).isNull(), bad).otherwise(F.lit(True)))
    (df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", keys_per_group)
     .option("parquet.block.size", row_group_bytes).parquet(path))
    return path


def read_keyed(spark: SparkSession, path: str, keys: DataFrame, key: str = "note_id") -> DataFrame:
    """The rows of the keys in ``keys``. Up to ``PUSHED`` keys, counted first, are
    sent to the scan; more are joined, which reads the store once."""
    stored, wanted = spark.read.parquet(path), keys.select(key).filter(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in wanted.limit(PUSHED + 1).collect()]
    if len(few) > PUSHED:
        return stored.join(wanted, key, "left_semi")
    if not few:
        return stored.limit(0)
    few.sort()
    asked = [F.col(key).isin(few[i:i + _IN]) for i in range(0, len(few), _IN)]
    while len(asked) > 1:  # a balanced tree, as a long chain is deep
        asked = [asked[i] | asked[i + 1] if i + 1 < len(asked) else asked[i] for i in range(0, len(asked), 2)]
    return stored.filter(asked[0])
