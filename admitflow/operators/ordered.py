"""Skew-safe ordered operators: running sums, global row index, rank within a
group, next row within a group, as-of joins.

A window partitioned by a key sends the whole key to one task; a key that
holds a third of the rows then becomes a straggler. Here the rows are
range-partitioned on the full ordering (group columns, order columns, a unique
tie-breaker), so a hot group lies in many partitions. Sums run inside each
(partition, group) part; a small table of part totals - one row per part, and a
group has a part per partition at most - gives each part what came before it,
and is joined on (partition, group), never on the bare group. The next row is
in the same partition, or it is the first of the next one.

Range bounds come from sampling, so the range-partitioned rows are checkpointed
before they are read twice. Give ``key`` (unique columns) to order the keys
alone: only group, order and key columns are then moved and stored, and the
result joins back to the payload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.session import cut_lineage, shuffle_partitions


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def with_running_sums(df: DataFrame, group_by: Sequence[str], order_by: Sequence, sums: dict[str, Column],
                      num_partitions: int | None = None) -> DataFrame:
    """Add, per name in ``sums``, the sum over the rows of the same group that
    come before the row (0 for the first). ``order_by`` should be a total order
    inside a group; ties get an arbitrary order."""
    n = num_partitions or shuffle_partitions(df.sparkSession)
    group, order = list(group_by), _cols(order_by)
    df = df.withColumns({f"_o{i}": c for i, c in enumerate(order)} | {f"_v_{k}": v for k, v in sums.items()})
    by = [f"_o{i}" for i in range(len(order))]
    s = cut_lineage(df.repartitionByRange(n, *group, *by).withColumn("_p", F.spark_partition_id()))
    parts = s.groupBy("_p", *group).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_p", *group, (F.count(F.lit(1)).over(earlier) > 0).alias("_late"),
                         *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_p", *group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({f"_r_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    if group:  # null groups are groups too
        # of a partition's groups only the first can have begun before it: one row per partition at most
        parts = parts.filter("_late").drop("_late").withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(["_p", *group])})
        on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(["_p", *group])]
        joined = s.join(F.broadcast(parts), on, "left").drop(*[f"_g{i}" for i in range(len(on))])
    else:  # one row per partition: as many as shuffle partitions
        joined = s.join(F.broadcast(parts.drop("_late")), "_p")
    return joined.withColumns({k: F.coalesce(F.col(f"_b_{k}"), F.lit(0)) + F.col(f"_r_{k}") for k in sums}).drop(
        "_p", *by, *[f"_{x}_{k}" for x in "vbr" for k in sums])


def with_rank_within(df: DataFrame, group_by: Sequence[str], order_by: Sequence, name: str = "pos", base: int = 0,
                     key: Sequence[str] | None = None) -> DataFrame:
    """Position of each row inside its group (``row_number() - 1 + base``)."""
    if key is None:
        ranked = with_running_sums(df, group_by, order_by, {name: F.lit(1).cast("long")})
        return ranked.withColumn(name, F.col(name) + F.lit(base))
    order = {f"_k{i}": c for i, c in enumerate(_cols(order_by))}
    keys = df.withColumns(order).select(*dict.fromkeys([*group_by, *key, *order]))
    ranked = with_rank_within(keys, group_by, list(order), name, base).select(*key, name)
    return df.join(ranked, list(key))


def with_global_index(df: DataFrame, order_by: Sequence, name: str = "ix", num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based index that follows ``order_by`` over the whole table.

    ``order_by`` should be a total order (end with a unique column); ties get
    distinct, arbitrary positions.
    """
    return with_running_sums(df, [], order_by, {name: F.lit(1).cast("long")}, num_partitions)


def with_next_within(df: DataFrame, group_by: Sequence[str], order_by: Sequence,
                     columns: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Add the values of the following row in the same group (``lead``); rows whose
    group holds a null have none. What follows the last row of a partition is the
    first row of the next one: a table with one row per partition."""
    n, group, order = shuffle_partitions(df.sparkSession), list(group_by), _cols(order_by)
    kept, by = df.columns, [f"_o{i}" for i in range(len(order))]
    df = df.withColumns(dict(zip(by, order, strict=True)))
    s = cut_lineage(df.repartitionByRange(n, *group, *by).withColumn("_p", F.spark_partition_id()))
    # equal places: the values decide, so that the first row of a partition is the same row everywhere
    place = [*by, *columns]
    value = F.struct(*[F.col(c).alias(prefix + c) for c in columns])
    firsts = s.groupBy("_p").agg(F.min(F.struct(*dict.fromkeys([*group, *place]))).alias("_f"))
    firsts = firsts.select("_p", F.lead("_f").over(Window.orderBy("_p")).alias("_f"))
    inside = Window.partitionBy("_p", *group).orderBy(*place)
    s = s.withColumn("_n", F.lead(value).over(inside)).join(F.broadcast(firsts), "_p")
    across = F.col("_f").isNotNull()
    for c in group:
        across = across & (F.col(f"_f.{c}") == F.col(c))
    found = F.coalesce("_n", F.when(across, F.struct(*[F.col(f"_f.{c}").alias(prefix + c) for c in columns])))
    for c in group:
        found = F.when(F.col(c).isNotNull(), found)
    s = s.withColumn("_n", found)
    return s.select(*group, *[c for c in kept if c not in group], *[F.col(f"_n.{prefix}{c}").alias(prefix + c) for c in columns])


def with_prefix(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], sums: dict[str, Column],
                lasts: dict[str, Column], num_partitions: int | None = None) -> DataFrame:
    """Add, over the rows of the same group that come before the row, per name in
    ``sums`` their sum (0 for the first) and per name in ``lasts`` the last value
    that is not null. Order columns are ascending, nulls first.

    As in ``with_running_sums`` a group may lie in many range partitions; what a
    partition's part of a group ends with is carried over to the next ones by a
    table with one row per part.
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    group, by = list(group_by), [f"_o{i}" for i in range(len(order_by))]
    df = df.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order_by)}
                        | {f"_s_{k}": v for k, v in sums.items()} | {f"_l_{k}": v for k, v in lasts.items()})
    s = cut_lineage(df.repartitionByRange(n, *group, *by).withColumn("_p", F.spark_partition_id()))
    ends = [F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums]
    ends += [F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.struct(*by))).alias(f"_e_{k}") for k in lasts]
    parts = s.groupBy("_p", *group).agg(*ends)
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_p", *group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    parts = parts.select("_p", *group, *[total(f"_t_{k}", earlier).alias(f"_bs_{k}") for k in sums],
                         *[last(f"_e_{k}", earlier).alias(f"_bl_{k}") for k in lasts])
    parts = parts.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(["_p", *group])})
    s = s.withColumns({f"_rs_{k}": total(f"_s_{k}", inside) for k in sums} | {f"_rl_{k}": last(f"_l_{k}", inside) for k in lasts})
    joined = s.join(parts, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(["_p", *group])])
    out = joined.withColumns({k: F.col(f"_bs_{k}") + F.col(f"_rs_{k}") for k in sums}
                             | {k: F.coalesce(f"_rl_{k}", f"_bl_{k}") for k in lasts})
    gone = [f"_{x}_{k}" for x in ("s", "bs", "rs") for k in sums] + [f"_{x}_{k}" for x in ("l", "bl", "rl") for k in lasts]
    return out.drop("_p", *by, *[f"_g{i}" for i in range(len(group) + 1)], *gone)


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], on: Sequence[str], columns: Sequence[str] = (),
          sums: dict[str, Column] | None = None, strict: bool = False) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the last row of ``right`` that has
    the same ``by`` and is not later in ``on`` (ascending; several columns break
    ties), and with ``sums`` over all such rows. ``strict`` leaves out rows that
    are equal in ``on``.

    Both sides are one union in order, so a group is never one task and no (left,
    right) pairs are made. Columns of ``right`` that ``left`` has too are refused.
    A left row without an earlier one has nulls and sums of 0; rows whose ``by``
    or ``on`` holds a null match nothing.
    """
    sums = sums or {}
    clash = set(left.columns) & {*columns, *sums}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    keys, whole = [*by, *on], lambda cs: F.forall(F.array(*[F.col(c).isNull() for c in cs]), lambda x: ~x)
    own = left.select(*keys, F.lit(0 if strict else 1).alias("_kind"), F.struct(*left.columns).alias("_row"))
    told = right.filter(whole(keys)).select(
        *keys, F.lit(1 if strict else 0).alias("_kind"), F.struct(F.lit(True).alias("_seen"), *columns).alias("_value"),
        *[v.alias(f"_sum_{k}") for k, v in sums.items()])
    both = own.unionByName(told, allowMissingColumns=True)
    placed = with_prefix(both, by, [*on, "_kind"], {k: F.coalesce(F.col(f"_sum_{k}"), F.lit(0)) for k in sums}, {"_found": F.col("_value")})
    fits = whole(keys)
    return placed.filter(F.col("_row").isNotNull()).select(
        "_row.*", *[F.when(fits, F.col(f"_found.{c}")).alias(c) for c in columns],
        *[F.when(fits, F.col(k)).otherwise(F.lit(0)).alias(k) for k in sums])
