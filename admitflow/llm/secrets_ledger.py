"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is named by the sha256 of its content (its blob). The
ledger holds which (blob, rule, rule version) were scanned and what was found. A
scan looks at pairs that are not in it: each unseen blob once, however many paths
and versions hold it, and each known one only for rules that are new or changed.
Findings join back to all paths by their blob.

A rule's matches are leftmost and do not overlap. Their places come from the
lengths of the pieces between them (``split``) and of the matches themselves
(``regexp_extract_all``), added up by a window over the matches of one text, so
the work is linear in the text. A cheap test goes first; only texts that pass it
are cut into pieces.

Copies of a content are merged inside the tasks before their text is moved. When
few blobs are new (``FEW``, counted first), only their texts are moved at all.
Findings are written before the marks of what was scanned, and read as distinct
rows: a scan that fails between the two is repeated without harm.

Rules ``assign``, ``access`` and ``hex`` are the base; ``pem`` (heads of private
keys) and ``jwt`` (signed tokens) add spans. Places are code points, the end
exclusive.

Edge cases: a null text is the empty content; repeated rows of a path each get
their findings; rows with a null path too; a column of the paths that clashes
with ``blob`` or ``findings`` is refused; an empty table gives an empty table and
leaves the ledger as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admitflow.session import cut_lineage
from admitflow.sources.sinks import _exists

FEW = 100_000  # blobs whose names are broadcast, at most


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str      # what is searched, leftmost and without overlaps
    least: int = 1    # characters of the group, at least
    group: int = 0
    test: str = ""    # cheaper pattern that every text with a finding matches

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_WORDS = r"(?i:password|passwd|secret|token|api_?key)"
#: runs of at least so many signs are the runs whose length is tested afterwards
RULES = (
    Rule("assign", 1, r"""%s["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % _WORDS, 8, 1,
         r"""%s["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""" % _WORDS),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
)
BASE = ("assign", "access", "hex")


class Ledger:
    """Tables ``findings`` and ``scanned`` under a shared folder."""

    FINDINGS = "blob string, rule string, start long, stop long"
    SCANNED = "blob string, rule string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS).distinct()

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED).distinct()

    def is_empty(self) -> bool:
        return not _exists(self.spark, f"{self.folder}/scanned")

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _contents(versions: DataFrame, text_col: str) -> DataFrame:
    return versions.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unseen(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``blob, rules``: the blobs that some rule has not scanned, with these rules."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = _contents(versions, text_col).select("blob").distinct()
    if ledger.is_empty():
        return blobs.withColumn("rules", wanted)
    # a blob has a row per rule version, whatever the number of its paths
    known = ledger.scanned().groupBy("blob").agg(F.collect_set("rule").alias("known"))
    left = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
    return blobs.join(known, "blob", "left").select("blob", left.alias("rules")).filter(F.size("rules") > 0)


def find(texts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``blob, rule, start, stop`` of the matches in ``blob, text, rules``; a
    blob has one row."""
    def parts(rule: Rule) -> Column:
        found = lambda g: F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(g))
        lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
        cut = F.arrays_zip(lengths(F.split("text", rule.pattern, -1)).alias("gap"), lengths(found(0)).alias("size"), lengths(found(rule.group)).alias("held"))
        due = F.array_contains("rules", rule.key) & F.col("text").rlike(rule.test or rule.pattern)
        return F.when(due, F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), cut.alias("parts")))

    hits = texts.select("blob", F.filter(F.array(*[parts(r) for r in rules]), lambda x: x.isNotNull()).alias("hits"))
    one = hits.filter(F.size("hits") > 0).select("blob", F.explode("hits").alias("h"))
    cut = one.select("blob", "h.rule", "h.least", F.posexplode("h.parts").alias("k", "p")).select(
        "blob", "rule", "least", "k", "p.gap", "p.size", "p.held")
    sofar = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(sofar)
    placed = cut.withColumn("stop", end).filter(F.col("size").isNotNull() & (F.col("held") >= F.col("least")))
    return placed.select("blob", "rule", (F.col("stop") - F.col("size")).alias("start"), "stop")


def scan(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text_col: str = "text") -> None:
    """Scans what the ledger does not hold and adds it."""
    texts = _contents(versions, text_col)
    if ledger.is_empty():
        todo = texts.groupBy("blob").agg(F.min("text").alias("text")).withColumn("rules", F.array(*[F.lit(r.key) for r in rules]))
        marks = unseen(versions, ledger, rules, text_col)
    else:
        marks = cut_lineage(unseen(versions, ledger, rules, text_col))
        few = marks.count()
        if not few:
            return
        if few <= FEW:
            texts = texts.join(F.broadcast(marks.select("blob")), "blob", "left_semi")
        todo = texts.groupBy("blob").agg(F.min("text").alias("text")).join(marks, "blob")
    marks = marks.select("blob", F.explode("rules").alias("rule"))
    ledger.add(find(todo, rules), marks)


def locate(paths: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``paths`` (without their text) with ``blob`` and ``findings``:
    an array of (start, order of the rule, kind, stop), sorted."""
    if {"blob", "findings"} & set(paths.columns):
        raise ValueError("paths has a column blob or findings")
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    kind = F.substring_index("rule", "@", 1)
    current = ledger.findings().filter(F.col("rule").isin([r.key for r in rules]))
    found = current.groupBy("blob").agg(F.array_sort(F.collect_list(
        F.struct("start", order[F.col("rule")].alias("nth"), kind.alias("kind"), "stop"))).alias("findings"))
    # read from a table of their own, so that Spark can split the paths of a hot blob
    found = cut_lineage(found)
    named = paths.withColumn("blob", blob_of(F.col(text_col))).drop(text_col)
    joined = named.join(found, "blob", "left")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)))


def as_text(findings: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")
