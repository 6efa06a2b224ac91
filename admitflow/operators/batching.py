"""Batches, padding and masks.

Batch membership comes from the distributed global index (no single-task
window over the whole table); the per-batch maximum is a window over at most
``size`` rows, so it is bounded by the batch size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.functions import vectors as V
from admitflow.operators.ordered import with_global_index


def shuffle_key(key: str, seed: int) -> Column:
    """T4: a reproducible shuffle order - md5 of the key and the seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def batches(df: DataFrame, order_by: Sequence, size: int = 128, key: str = "id",
            shuffle_seed: int | None = None) -> DataFrame:
    """Consecutive groups of ``size`` rows in ``order_by`` order (or in a
    seeded shuffled order), with ``batch_id`` and ``batch_pos``."""
    order = [shuffle_key(key, shuffle_seed), F.col(key)] if shuffle_seed is not None else list(order_by)
    ix = with_global_index(df, order, "_bix")
    return (ix.withColumn("batch_id", F.floor(F.col("_bix") / size).cast("long"))
            .withColumn("batch_pos", (F.col("_bix") % size).cast("int")).drop("_bix"))


def shuffled(df: DataFrame, key: str = "id", seed: int = 42, name: str = "shuffle_ix") -> DataFrame:
    """T4: position of each row in a seeded shuffled order."""
    return with_global_index(df, [shuffle_key(key, seed), F.col(key)], name)


def collate(df: DataFrame, length: str, batch: str = "batch_id", prefix: str = "", reported: str | None = None) -> DataFrame:
    """W5 + A17 + X20: the batch's longest sequence beside each row, the
    padding mask (True = padded) and the number of padded positions. The mask
    begins at ``length``, or at the column ``reported`` (see ``reported_length``)."""
    max_len = F.max(F.col(length)).over(Window.partitionBy(batch))
    out = df.withColumn(prefix + "max_len", max_len.cast("int"))
    start = F.col(reported or length)
    mask = V.padding_mask(start, F.col(prefix + "max_len"))
    return (out.withColumn(prefix + "mask", mask)
            .withColumn(prefix + "n_masked", F.greatest(F.col(prefix + "max_len") - start, F.lit(0)).cast("int")))


def reported_length(length: str, has_note: str, width: int, compat_mask: bool = False) -> Column:
    """Where a note sequence's mask begins. A sample without notes has one zero
    row and is masked behind it; the reference measures the zero vector before
    it becomes a row, so it reports the vector's ``width`` (Q7): ``compat_mask``."""
    return F.when(~F.col(has_note), F.lit(width)).otherwise(F.col(length)).cast("int") if compat_mask else F.col(length).cast("int")


def _sides(n: Column) -> Column:
    """The smallest s with s * s >= n."""
    s = F.floor(F.sqrt(n.cast("double"))).cast("long")
    s = F.when(s * s > n, s - 1).otherwise(s)
    return F.when(s * s >= n, s).otherwise(s + 1)


def permuted(ix: Column, n: Column, seed: int, epoch: Column | int = 0, rounds: int = 4, walks: int = 64) -> Column:
    """T4 + W2 without a sort: a keyed bijection of 0 .. n - 1.

    ``ix`` is written as (left, right) to the base s, the smallest with
    s * s >= n; a Feistel network over these two, whose round function is the md5
    of (seed, epoch, round, right), permutes s * s numbers, and a result beyond n
    goes through it again until it is below (cycle walking). That happens with a
    probability of about 2 / s, so ``walks`` of them are never used up.
    """
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    n, s = n.cast("long"), _sides(n.cast("long"))

    def network(x: Column) -> Column:
        pair = F.struct(F.floor(x / s).cast("long").alias("l"), F.pmod(x, s).cast("long").alias("r"))

        def turn(p: Column, k: Column) -> Column:
            text = F.concat_ws("|", F.lit(str(seed)), e.cast("string"), k.cast("string"), p["r"].cast("string"))
            noise = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
            return F.struct(p["r"].alias("l"), F.pmod(p["l"] + noise, s).cast("long").alias("r"))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pair, turn)
        return done["l"] * s + done["r"]

    once = network(ix.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once, lambda x, _: F.when(x < n, x).otherwise(network(x)))


def epochs(df: DataFrame, index: str, n: Column, epochs: int, size: int = 128, seed: int = 42) -> DataFrame:
    """T4 + W2 over several epochs: each row once per epoch with its
    ``shuffle_ix``, ``batch_id`` and ``batch_pos`` there. ``index`` is any dense
    index of the rows (``with_global_index``), made once; no epoch sorts or
    exchanges rows."""
    rows = df.withColumn("_n", n).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("shuffle_ix", permuted(F.col(index), F.col("_n"), seed, F.col("epoch"))).drop("_n")
    return rows.withColumns({"batch_id": F.floor(F.col("shuffle_ix") / size).cast("long"), "batch_pos": (F.col("shuffle_ix") % size).cast("int")})


def pad(df: DataFrame, seq: str, max_len: str, width: int, out: str | None = None) -> DataFrame:
    """Right-pad an array-of-vectors column to the batch maximum."""
    return df.withColumn(out or seq, V.pad_rows(F.col(seq), F.col(max_len), width))


def padding_steps(df: DataFrame, key, length: str, max_len: str, pos: str = "pos") -> DataFrame:
    """X19 in long form: the zero rows a sequence receives, one per padded
    position ``length .. max_len-1``."""
    padded = df.filter(F.col(max_len) > F.col(length))
    keys = [key] if isinstance(key, str) else list(key)
    return padded.select(*keys, F.explode(F.sequence(F.col(length), F.col(max_len) - 1)).alias(pos))
