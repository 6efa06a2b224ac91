"""The queries of the subpackage: each applies an operator, with production
parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm import (alignment, conversation_repair, decontamination, fingerprints, html_extract, jaccard_join, line_dedup,
                           packing, quality, samples, secrets_ledger, sharding, substring_dedup, toxicity)
from admitflow.session import cut_lineage, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SHARDS = 40


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query
def op1_packing(spark, sf_dir):
    """Vector bin packing of all documents into sequences of 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "n_loss")


@query
def op2_substring_dedup(spark, sf_dir):
    """Words of 13-word windows that an earlier document holds are removed."""
    rows = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


@query
def op3_sharding(spark, sf_dir):
    """Uniform shuffle of all documents into 40 shards, row counts at most one apart."""
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS, seed=7)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                         F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_jaccard_join(spark, sf_dir):
    """Components of documents whose 5-word shingles have a similarity of 0.8."""
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))[0]


@query
def op5_toxicity(spark, sf_dir):
    """Toxicity of every document, learned outside the held-out third."""
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(samples.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_on=samples.fold(F.col("id"), 3) != 1)
    rows = toxicity.score_documents(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_fingerprints(spark, sf_dir):
    """Winnowed fingerprints of every text, its edited text and the next text."""
    rows = fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))
    rows = rows.withColumns({f"{c}_set": fingerprints.hashes(F.col(c)) for c in ("fp", "edited_fp", "next_fp")})
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       sha256("edited").alias("edited_sha256"), fingerprints.as_text(F.col("fp")).alias("fingerprint"),
                       fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       fingerprints.likeness(F.col("fp_set"), F.col("edited_fp_set")).alias("near_edited"),
                       fingerprints.likeness(F.col("fp_set"), F.col("next_fp_set")).alias("near_next"))


@query
def op7_line_dedup(spark, sf_dir):
    """Lines held by several documents stay in the smallest doc_id alone."""
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", sha256("kept_text").alias("kept_sha256"))


@query
def op8_decontamination(spark, sf_dir):
    """Words of documents inside windows of benchmark items."""
    rows = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return rows.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"), sha256(F.array_join(ids, ",")).alias("items_sha256"),
                       (F.size("hit_words") > 0).alias("contaminated"))


@query
def op9_quality(spark, sf_dir):
    """Quality of every document, learned outside the held-out fifth."""
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(samples.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train_on=samples.fold(F.col("id"), 5) != 0)
    rows = quality.score_documents(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_html_extraction(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    rows = html_extract.extract(pages, html_extract.fit(pages))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_secret_scans(spark, sf_dir):
    """Secrets in every document, scanned blob by blob into a new ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets_ledger.Ledger(spark, f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    secrets_ledger.scan(docs, ledger)
    rows = secrets_ledger.locate(docs, ledger)
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    return rows.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets_ledger.BASE],
                       sha256(secrets_ledger.as_text(of(*secrets_ledger.BASE))).alias("base_sha256"),
                       secrets_ledger.as_text(F.col("findings")).alias("spans"))


@query
def op12_tokenizer_alignment(spark, sf_dir):
    """Alignment of two tokenizers over every document."""
    return alignment.align(table(spark, sf_dir, "documents"))[0]


@query
def op13_conversation_repair(spark, sf_dir):
    """Lightest repairs of every conversation, after damage."""
    conversations = table(spark, sf_dir, "conversations")
    damaged = conversation_repair.damage(conversations)
    plans = conversation_repair.plan_repairs(conversations, damaged)
    plans = cut_lineage(plans)
    return conversation_repair.with_digests(plans, conversation_repair.repaired_turns(damaged, plans))
