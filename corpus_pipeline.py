"""Corpus pipeline over ``documents``: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet into the shared checkpoint folder and
read again as the next one's ``docs``.

1. ``quality``: documents scored under 0.3 go.
2. ``line_dedup``: repeated lines go; the text and ``n_chars`` become those of
   the lines that stay. No document goes here, even if no line is left.
3. ``near_duplicates``: of each component of similar documents the one with the
   smallest ``doc_id`` stays; documents without words link with nothing and stay.
   Of rows with the same id and the same text one stays, also of those with a
   null id; rows of one id with different texts are parts of one document.
4. ``decontamination``: documents with a word in a benchmark window go.
5. ``packing``: the pieces of all documents, packed into sequences.

Stages 1 to 4 return the columns of ``documents``; rows with a null id pass
stages 2 to 4 as single documents, apart from their exact copies in stage 3
(near-equal ones stay, for no id names them).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm import decontamination, jaccard_join, line_dedup, packing, quality, samples
from admitflow.session import ensure_checkpoint_dir

LEAST_QUALITY = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # fitted scores and packing are beyond SQL; tests/llm compares with plain Python


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator of op9, learned outside the same held-out fifth."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), train_on=samples.fold(F.col("id"), 5) != 0)
    return quality.score_documents(docs, model).filter(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator of op7; a null text stays null."""
    rows = line_dedup.dedup_lines(docs, keep=("lang", "source", "n_chars"))
    cut = F.col("n_dropped") > 0
    return rows.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
                       F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator of op4; one document of each component stays, and one of
    its equal rows."""
    linked, _ = jaccard_join.link_documents(docs)
    gone = linked.filter("component_id < doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    # copies are merged inside the tasks first, so a repeated id is no hot key
    first = F.min(F.struct(*COLUMNS)).alias("r")
    return kept.groupBy(F.col("doc_id").alias("_id"), F.md5(F.col("text").cast("binary")).alias("_h")).agg(first).select("r.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator of op8; documents that are hit go."""
    found = decontamination.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    gone = found.filter(F.size("hit_words") > 0).select(F.col("doc_id"), "text_hash").distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator of op1: one row per piece, with its token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
