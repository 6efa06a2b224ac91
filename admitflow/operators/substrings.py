"""Substring join by automata (J4 X13): which keys occur inside which texts.

Keys are dealt into blocks of bounded size by their hash, texts into splits; a
task holds one block as an Aho-Corasick automaton and reads the texts of one
split once each, whatever the number and the lengths of the keys. No substring
is made, sorted or exchanged. A text meets every block, so texts move once per
block; blocks are few, since they are as large as ``keys_per_block``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contains_join(keys: DataFrame, texts: DataFrame, key: str, text: str, keys_per_block: int = 200_000,
                  texts_per_split: int = 500_000) -> DataFrame:
    """``key, text`` of every pair of distinct values where the text contains the
    key. Nulls match nothing; the empty key is in every text."""
    own = keys.select(F.col(key).cast("string").alias("k")).filter("k IS NOT NULL").distinct()
    told = texts.select(F.col(text).cast("string").alias("t")).filter("t IS NOT NULL").distinct()
    blocks = max(1, -(-own.count() // keys_per_block))
    splits = max(1, -(-told.count() // texts_per_split))
    spread = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    own = own.select("k", part("k", blocks).alias("block"), spread(splits, "split"))
    told = told.select("t", part("t", splits).alias("split"), spread(blocks, "block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        found, words = ahocorasick.Automaton(), left.column("k").to_pylist()
        for word in words:
            if word:
                found.add_word(word, word)
        found.make_automaton()
        empty, out = "" in words, ([], [])
        for line in right.column("t").to_pylist():
            hits = {word for _, word in found.iter(line)} if len(found) else set()
            if empty:
                hits.add("")
            out[0].extend(hits)
            out[1].extend([line] * len(hits))
        return pa.table({"k": pa.array(out[0], pa.string()), "t": pa.array(out[1], pa.string())})

    pairs = own.groupBy("block", "split").cogroup(told.groupBy("block", "split")).applyInArrow(run, "k string, t string")
    return pairs.select(F.col("k").alias(key), F.col("t").alias(text))
