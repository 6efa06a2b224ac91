"""Connected components of a link table, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one (large
star), then its smaller neighbours (small star); the rounds end when no link
moves. Minima are pre-aggregated, and every round is cut off by a checkpoint.

Edge cases: links with a null end and links of a node to itself are left out;
repeated links and both directions of one count once; a node without a link has
no row; no links give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.session import cut_lineage

PART_LINKS = 50_000  # links of a partition between rounds


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """``node, component`` of every linked node; the component is named by its
    smallest node. After ``rounds`` rounds the work may stop early: nodes of one
    name are connected then, but a component may still have several names."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = cut_lineage(e)
    state, done = _state(e), 0
    parts = max(1, -(-state[0] // PART_LINKS))  # few links need few tasks and files
    while state[0] and (rounds is None or done < rounds):
        done += 1
        e = e.coalesce(parts)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        if rounds is None:
            before, state = state, _state(e)
            if state == before:
                break
    both = e.unionByName(e.select(F.col("v").alias("u"), "v"))
    return both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def extended(comps: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``comps`` (``node, component``, as of ``components``, also of a work that
    stopped early) after further ``links``: only the links between names are
    followed, so this costs what is new and not what is joined already."""
    name = lambda k: comps.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).join(name("x"), "x", "left").join(name("y"), "y", "left")
    between = ends.select(F.coalesce("_x", "x").alias("p"), F.coalesce("_y", "y").alias("q")).filter("p != q").distinct()
    above = cut_lineage(components(between, "p", "q"))
    joined = comps.join(above.select(F.col("node").alias("component"), F.col("component").alias("_up")), "component", "left")
    new = above.join(comps.select("node"), "node", "left_anti")
    return joined.select("node", F.coalesce("_up", "component").alias("component")).unionByName(new.select("node", "component"))
