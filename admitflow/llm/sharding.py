"""A uniform shuffle into shards of exact size by a communication matrix.

Rows belong to parts by the hash of their key. The number of rows that each
part sends to each block of each shard is drawn from the multivariate
hypergeometric law that a uniform shuffle gives these counts, with the row
counts of the parts and the sizes of the blocks as margins. Then each part
permutes its rows and deals them out by its counts, rows go to their blocks,
and each block permutes again; a row's place in its block is its slot. Shard
sizes differ by one row at most, and slots have no gaps.

Only keys are permuted; a text moves once, to its assignment. Part counts and
the matrix go through the driver: at most MATRIX_CELLS numbers, whatever the
input; parts and blocks grow with the input up to that bound. All randomness
comes from hashes of (seed, key), so a task done again gives the same rows.

Edge cases: a null text has no bytes; null ids are a key like any other;
repeated rows each get a slot of their own and lie in any part; an empty table gives an empty
table; extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS, BLOCK_ROWS, MATRIX_CELLS = 1 << 16, 1 << 20, 1 << 24
LEAST_PARTS, LEAST_BLOCKS = 64, 4  # a small table is dealt out too
NO_ID = -(1 << 63)  # stands for a null id, beside a flag


def draw_matrix(parts: np.ndarray, blocks: np.ndarray, seed: int) -> np.ndarray:
    """Counts of rows from each part to each block, with these margins."""
    rng, left = np.random.default_rng(seed), blocks.astype(np.int64).copy()
    out = np.zeros((len(parts), len(blocks)), dtype=np.int32)
    for p, n in enumerate(parts.tolist()):
        if n:
            out[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
            left -= out[p]
    return out


def shard_sizes(n: int, shards: int) -> np.ndarray:
    return np.array([n // shards + (s < n % shards) for s in range(shards)], dtype=np.int64)


def block_sizes(n: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, size and first slot of every block."""
    per = int(min(max(LEAST_BLOCKS, -(-n // shards // BLOCK_ROWS)), MATRIX_CELLS // LEAST_PARTS // shards))
    sizes = np.stack([shard_sizes(m, per) for m in shard_sizes(n, shards).tolist()])
    return np.repeat(np.arange(shards), per), sizes.ravel(), (np.cumsum(sizes, axis=1) - sizes).ravel()


def assign(keys: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Adds ``shard`` and ``slot`` to the rows of ``keys``."""
    spark, columns = keys.sparkSession, [F.col(c) for c in keys.columns]
    n = keys.count()
    shard_of, sizes, base = block_sizes(n, shards)
    n_parts = int(min(max(LEAST_PARTS, -(-n // PART_ROWS)), MATRIX_CELLS // len(sizes)))
    parted = keys.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(n_parts)).cast("int"))
    counts = np.zeros(n_parts, dtype=np.int64)
    for r in parted.groupBy("_part").count().collect():  # n_parts rows at most
        counts[r["_part"]] = r["count"]
    dealt = spark.sparkContext.broadcast(np.cumsum(draw_matrix(counts, sizes, seed), axis=1, dtype=np.int64))

    @F.pandas_udf("int")
    def block_of(part: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(part), dtype=np.int32)
        for p in part.unique():
            own = (part == p).to_numpy()
            out[own] = np.searchsorted(dealt.value[p], rank.to_numpy()[own], side="right")
        return pd.Series(out)

    by_chance = lambda k: [F.xxhash64(F.lit(seed * 2 + k), *columns), *columns]
    local = Window.partitionBy("_part").orderBy(*by_chance(1))
    again = Window.partitionBy("_block").orderBy(*by_chance(2))
    placed = (parted.withColumn("_rank", F.row_number().over(local) - 1)
              .withColumn("_block", block_of("_part", "_rank"))
              .withColumn("_place", F.row_number().over(again) - 1))
    shard, first = (F.array(*[F.lit(int(x)) for x in a]) for a in (shard_of, base))
    return placed.select(*columns, F.element_at(shard, F.col("_block") + 1).cast("int").alias("shard"),
                         (F.element_at(first, F.col("_block") + 1) + F.col("_place")).cast("long").alias("slot"))


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id",
                        text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``text_col`` and ``keep`` of every row with ``shard, slot``.

    Equal rows are counted first, inside the tasks, and their text moves once;
    each of them is a key of its own, by its number among them."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(id_col).cast("long").isNull().alias("_null"),
                       F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("_hash", F.xxhash64("_null", F.col("_text").isNull(), "_text", *[f"_keep_{c}" for c in keep]))
    counted = rows.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    keys = counted.select("_id", "_hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"))
    place = assign(keys, shards, seed).drop("_copy")
    row = F.struct("_null", "_text", *[f"_keep_{c}" for c in keep])
    texts = rows.groupBy("_id", "_hash").agg(F.first(row).alias("_row"))
    return texts.join(place, ["_id", "_hash"]).select(
        F.when(~F.col("_row._null"), F.col("_id")).alias(id_col), F.col("_row._text").alias(text_col),
        *[F.col(f"_row._keep_{c}").alias(c) for c in keep], "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
