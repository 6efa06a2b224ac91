"""Repair of conversation structure as a lightest derivation.

A conversation's turns become one code each: the class of its role (system,
user, assistant, other) and its fault (none, truncated, or one that must go).
Repaired roles must read ``(s?(ua)+)?``. Its states are START, SYSTEM (after a
system turn), USER (after a user turn) and PAIRED (after an assistant turn). An
item ``(span, p, r)`` says that the turns of a span can be edited so that state p
becomes r; its value is ``(cost, audit)``, the audit being the edits' initials.
Items of single turns are axioms, and ``(left, p, q), (right, q, r) |-
(both, p, r)`` adds costs and joins audits. The agenda is popped in the order
(cost, turns of the span, audit): no deduction gives a value before those it was
made of, and a smaller value never makes a larger one, so an item is final when
it is popped (Knuth 1977), and the work ends when the goal is.

Two audits of one span and of equal cost never are beginnings of each other (the
longer one would insert more, which costs), so joining keeps their order.

Turns are cut into blocks of ``BLOCK``; longer conversations join the items of up
to ``FAN`` blocks at a time, level by level, so no task holds all turns of a
conversation, however long. The structural part moves hashes and codes, never
texts. Equal rows of a conversation are merged to one with a count before any
exchange.

``repaired_turns`` brings each conversation's texts to one task, in order and in
batches, as a digest over them needs; it keeps none of them.

Edge cases: a null id is a conversation of its own; null roles and texts are one
space; rows with a null turn come first; rows of one turn are ordered by role
and then by the md5 of their text; a row is a duplicate of an earlier one with
its role and text; a conversation without rows has zeros and an empty audit;
gaps that no long holds are null; extra columns are dropped; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.operators.ordered import with_running_sums
from admitflow.session import cut_lineage

BLOCK, FAN = 2048, 64
BLANKS = " \t\n\x0b\f\r"
START, SYSTEM, USER, PAIRED = range(4)
STATES = 4
#: costs of the edits; a truncated turn that stays adds UNFINISHED
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
ROLES = "sua"                    # classes 0 to 2; all other initials are class 3
FINE, TRUNCATED, GONE = range(3)  # faults of a code; a code is 3 * class + fault
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _after(state: int, kind: int) -> int | None:
    """The state behind a turn of class ``kind``, None where it may not stand."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return PAIRED if kind == 2 and state == USER else None


def _insertions() -> dict:
    """Values of a gap between turns: none, one or two insertions."""
    best = {(p, p): (0, "") for p in range(STATES)}
    for p in range(STATES):
        state, audit = p, ""
        for _ in range(2):
            state, audit = (PAIRED if state == USER else USER), audit + "I"
            if (p, state) not in best:
                best[p, state] = (INSERT * len(audit), audit)
    return best


GAP = _insertions()


@lru_cache(maxsize=None)
def axioms(code: int) -> dict:
    """Items of one turn with the gap before it."""
    kind, fault = divmod(code, 3)
    best: dict = {}
    for (p, q), (cost, audit) in GAP.items():
        found = [(q, DELETE, "D")]
        if fault != GONE:
            extra = UNFINISHED if fault == TRUNCATED else 0
            found.append((_after(q, kind), extra, "K"))
            found += [(_after(q, new), extra + REROLE, "R") for new in (1, 2)]
        for r, more, letter in found:
            if r is not None:
                best[p, r] = min(best.get((p, r), (1 << 62, "")), (cost + more, audit + letter))
    return best


def derive(leaves: list[dict], goals: set | None = None) -> dict:
    """Final values of the items over all ``leaves``, by the agenda: all items,
    or the first of ``goals`` that is final."""
    parent, span, sons = {}, [1] * len(leaves), {}
    level = list(range(len(leaves)))
    while len(level) > 1:  # spans: a balanced tree over the leaves
        above = []
        for k in range(0, len(level) - 1, 2):
            node, left, right = len(span), level[k], level[k + 1]
            span.append(span[left] + span[right])
            sons[node], parent[left], parent[right] = (left, right), node, node
            above.append(node)
        level = above + level[len(level) // 2 * 2:]
    root = level[0]
    agenda = [(cost, 1, audit, node, p, r) for node, leaf in enumerate(leaves) for (p, r), (cost, audit) in leaf.items()]
    heapq.heapify(agenda)
    final: list[dict] = [{} for _ in span]
    while agenda:
        cost, _, audit, node, p, r = heapq.heappop(agenda)
        own = final[node]
        if (p, r) in own:
            continue
        own[p, r] = (cost, audit)
        if node == root:
            if goals and (p, r) in goals:
                return {(p, r): (cost, audit)}
            continue
        up = parent[node]
        left, right = sons[up]
        if node == left:
            for (q, s), (more, tail) in final[right].items():
                if q == r and (p, s) not in final[up]:
                    heapq.heappush(agenda, (cost + more, span[up], audit + tail, up, p, s))
        else:
            for (q, s), (less, head) in final[left].items():
                if s == p and (q, r) not in final[up]:
                    heapq.heappush(agenda, (cost + less, span[up], head + audit, up, q, r))
    return final[root]


def goal(leaves: list[dict]) -> tuple[int, str]:
    """The lightest value of a whole conversation; a gap follows the last turn."""
    found = derive([*leaves, GAP], {(START, START), (START, PAIRED)})
    return next(iter(found.values()))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of
    ``conv_id:turn`` modulo 20 chooses (see the module of queries)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    kind = F.pmod(F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")), F.lit(20))
    rows = rows.withColumn("_kind", kind).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_c")).drop("_c")


def _keyed(rows: DataFrame) -> DataFrame:
    """``conv`` (never null), turn, role, mark (md5 of the text) and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(_conv(), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text")).withColumn(
        "mark", F.md5(F.encode("text", "UTF-8")))


def _conv():
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def _faulted(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, ``pos`` (of the first copy) and ``code``."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    looks = _keyed(rows).select("conv", "turn", "role", "mark", (body == "").alias("blank"), F.right(body, F.lit(1)).isin(".", "!", "?").alias("ended"))
    merged = looks.groupBy("conv", "turn", "role", "mark", "blank", "ended").agg(F.count(F.lit(1)).alias("copies"))
    placed = cut_lineage(with_running_sums(merged, ["conv"], ["turn", "role", "mark"], {"pos": F.col("copies")}))
    first = placed.groupBy("conv", "role", "mark").agg(F.min("pos").alias("first"))
    placed = placed.join(first, ["conv", "role", "mark"])
    fault = F.when(F.col("blank") | (F.col("pos") > F.col("first")), GONE).when(~F.col("ended"), TRUNCATED).otherwise(FINE)
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))  # 0 where there is none
    kind = F.when((initial == 0) | (F.col("role") == ""), len(ROLES)).otherwise(initial - 1)
    return placed.withColumn("code", (3 * kind + fault).cast("int"))


def _codes(faulted: DataFrame) -> DataFrame:
    """``conv, block, codes``: a letter per row, in order; copies behind the first
    are duplicates."""
    nth = faulted.select("conv", "pos", "code", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    code = F.when(F.col("k") == 0, F.col("code")).otherwise(F.col("code") - F.col("code") % 3 + GONE)
    one = nth.select("conv", (F.col("pos") + F.col("k")).alias("pos"), F.char(code + ord("a")).alias("c"))
    packed = one.groupBy("conv", F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("rows"))
    return packed.select("conv", "block", F.array_join(F.transform("rows", lambda x: x["c"]), "").alias("codes"))


_ITEMS = "conv string, block long, illegal long, head int, tail int, costs array<long>, audits array<string>"
_BATCH = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("illegal", pa.int64()), ("head", pa.int32()), ("tail", pa.int32()),
                    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _packed(items: dict) -> tuple[list, list]:
    found = [items.get(divmod(k, STATES)) for k in range(STATES * STATES)]
    return [v and v[0] for v in found], [v and v[1] for v in found]


def _unpacked(costs: list, audits: list) -> dict:
    return {divmod(k, STATES): (c, a) for k, (c, a) in enumerate(zip(costs, audits, strict=True)) if c is not None}


def _illegal(kinds: list[int]) -> int:
    return sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))


def _block_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, block, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = [ord(c) - ord("a") for c in codes]
            kinds = [v // 3 for v in values]
            out.append((conv, block, _illegal(kinds), kinds[0], kinds[-1], *_packed(derive([axioms(v) for v in values]))))
        yield _record(out, _BATCH)


def _joined_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, block, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            borders = sum((x["tail"], y["head"]) not in LEGAL for x, y in zip(parts, parts[1:], strict=False))
            items = derive([_unpacked(x["costs"], x["audits"]) for x in parts])
            out.append((conv, block, sum(x["illegal"] for x in parts) + borders, parts[0]["head"], parts[-1]["tail"], *_packed(items)))
        yield _record(out, _BATCH)


_DONE = pa.schema([("conv", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


@lru_cache(maxsize=1 << 16)
def _short(codes: str) -> tuple[int, int, str]:
    values = [ord(c) - ord("a") for c in codes]
    return _illegal([v // 3 for v in values]), *goal([axioms(v) for v in values])


def _finished_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _record([(conv, *_short(codes)) for conv, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True)], _DONE)


def _finished_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _record([(conv, illegal, *goal([_unpacked(costs, audits)])) for conv, illegal, costs, audits in zip(
            *(c.to_pylist() for c in batch.columns), strict=True)], _DONE)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _audits(faulted: DataFrame) -> DataFrame:
    """``conv, illegal, cost, audit`` of every conversation with rows."""
    codes = cut_lineage(_codes(faulted))
    long = codes.filter("block > 0").select("conv").distinct()
    done = "conv string, illegal long, cost long, audit string"
    out = codes.join(long, "conv", "left_anti").select("conv", "codes").mapInArrow(_finished_codes, done)
    highest = codes.agg(F.max("block").alias("b")).first()["b"] or 0
    if highest:
        items = codes.join(long, "conv", "left_semi").select("conv", "block", "codes").mapInArrow(_block_items, _ITEMS)
        while highest:
            part = F.struct("block", "illegal", "head", "tail", "costs", "audits")
            groups = items.groupBy("conv", F.floor(F.col("block") / FAN).cast("long").alias("b")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
            items = cut_lineage(groups.mapInArrow(_joined_items, _ITEMS))
            highest //= FAN
        out = out.unionByName(items.select("conv", "illegal", "costs", "audits").mapInArrow(_finished_items, done))
    return out


def plan_repairs(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of
    every conversation of ``conversations``; ``rows`` are the rows to repair (by
    default the same)."""
    rows = conversations if rows is None else rows
    faulted = cut_lineage(_faulted(rows))
    none, fault = F.lit(0).cast("long"), F.col("code") % 3
    turns = faulted.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(none)).alias("blank"),
        F.sum(F.when(F.col("blank"), none).otherwise(F.col("copies") - (fault != GONE).cast("long"))).alias("duplicate"),
        F.sum(F.when(fault == TRUNCATED, 1).otherwise(0)).alias("truncated"))
    wide = F.col("turn").cast("decimal(38,0)")
    told = turns.groupBy("conv").agg(
        (F.max(wide) - F.min(wide) + 1 - F.count("turn")).try_cast("long").alias("gaps"), F.count("turn").alias("known"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    told = told.withColumn("gaps", F.when(F.col("known") == 0, none).otherwise(F.col("gaps"))).drop("known").join(_audits(faulted), "conv")
    ids = conversations.select("conv_id", _conv()).distinct()
    zero = lambda c: F.when(F.col("_none"), none).otherwise(F.col(c)).alias(c)
    return ids.join(told, "conv", "left").withColumn("_none", F.col("audit").isNull()).select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"))


def _walk(state: int, letter: str, role: str | None) -> tuple[int, str | None]:
    """State behind an edit and the role that it leaves, if any."""
    if letter == "D":
        return state, None
    if letter == "K":
        return _after(state, ROLES.find(role[:1])), role
    return (PAIRED, "assistant") if state == USER else (USER, "user")


_TURNS = pa.schema([("conv", pa.string()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition by conversation: its audit, then its rows in order."""
    conv, audit, at, state, n, out = None, "", 0, START, 0, []

    def inserted():
        nonlocal at, state, n
        while at < len(audit) and audit[at] == "I":
            state, role = _walk(state, "I", None)
            out.append((conv, n, role, ""))
            at, n = at + 1, n + 1

    for batch in batches:
        for c, plan, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "audit", "role", "text")), strict=True):
            if plan is not None:
                inserted()
                conv, audit, at, state, n = c, plan, 0, START, 0
                continue
            inserted()
            state, left = _walk(state, audit[at], role)
            if left is not None:
                out.append((conv, n, left, text))
                n += 1
            at += 1
        yield _record(out, _TURNS)
        out.clear()
    inserted()
    yield _record(out, _TURNS)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv, n, role, text``: the turns that the audits leave, in the order of
    (conv, n) inside each partition; a conversation lies in one partition."""
    columns = ["conv", "audit", "turn", "role", "mark", "text"]
    texts = _keyed(rows).withColumn("audit", F.lit(None).cast("string")).select(*columns)
    none = F.lit(None).cast("string")
    heads = plans.select(_conv(), "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("mark"), none.alias("text"))
    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), "turn", "role", "mark")
    return both.select("conv", "audit", "role", "text").mapInArrow(_repaired, "conv string, n long, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    conv, digest, out = None, None, []
    for batch in batches:
        for c, n, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                if conv is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
        yield _record(out, schema)
        out.clear()
    yield _record([(conv, digest.hexdigest())] if conv is not None else [], schema)


def with_digests(plans: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds ``repaired_sha256`` of each conversation's ``role:text`` lines."""
    import hashlib

    found = turns.mapInArrow(_digests, "conv string, repaired_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return plans.withColumn("conv", _conv()).join(found, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty)).drop("conv")
