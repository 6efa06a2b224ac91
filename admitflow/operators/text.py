"""TF-IDF job (M6: X8-X11 A7 T3 W9 S9).

Plan: tokens are built by built-in regex/array expressions; one shuffle
counts (doc, term), and these counts - far smaller than the text - are
stored, so the text is tokenised once however many steps follow; one
aggregation gives corpus statistics; the top-N
vocabulary (at most ``vocab_size`` rows, so its broadcast is bounded by a
parameter, not by the data) is broadcast back to weight and normalise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitflow.functions import text as T
from admitflow.functions import vectors as V
from admitflow.session import shuffle_partitions, stored


def cleaned(df: DataFrame, doc: str = "note_id", text: str = "text", out: str = "clean_text") -> DataFrame:
    """The cleaned note text."""
    return by_document(df, doc, text).withColumn(out, T.clean_text(F.col(text)))


def by_document(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Hash-partition the texts by document before tokenising: the regex work
    is spread over every shuffle partition whatever the input layout, and the
    later per-(doc, term) count and per-doc norm reuse this partitioning (a
    hash on ``doc`` satisfies both), so this shuffle replaces the doc-term
    shuffle instead of adding one."""
    return df.select(doc, text).repartition(shuffle_partitions(df.sparkSession), doc)


def doc_terms(df: DataFrame, doc: str = "note_id", text: str = "text") -> DataFrame:
    """A7 (first half): term count per document."""
    return (by_document(df, doc, text).select(doc, F.explode(T.pieces(F.col(text))).alias("term"))
            .filter(T.is_token("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("cnt")))


def term_stats(terms: DataFrame) -> DataFrame:
    """Corpus term count ``tf`` and document frequency ``df``."""
    return terms.groupBy("term").agg(F.sum("cnt").alias("tf"), F.count(F.lit(1)).alias("df"))


def vocabulary(stats: DataFrame, vocab_size: int = 1024) -> DataFrame:
    """T3 + W9: the ``vocab_size`` most frequent terms (ties: smaller term
    wins), indexed in alphabetical order. ``orderBy().limit()`` plans as a
    per-partition top-N, so no partition ever holds more than N rows."""
    top = stats.orderBy(F.desc("tf"), F.asc("term")).limit(vocab_size)
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("term_ix"),
                      "tf", "df")


def weights(terms: DataFrame, vocab: DataFrame, n_docs, doc: str = "note_id") -> DataFrame:
    """X9 + X10: ``cnt * (ln((1+n)/(1+df)) + 1)``, L2-normalised per document.
    A document's rows are bounded by the vocabulary size, so the per-document
    window is bounded too."""
    n = n_docs.cast("double")
    w = terms.join(F.broadcast(vocab.select("term", "term_ix", "df")), "term").select(
        doc, "term_ix",
        (F.col("cnt") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, "term_ix", (F.col("w") / norm).alias("value"))


def fit_transform(df: DataFrame, doc: str = "note_id", text: str = "text", vocab_size: int = 1024):
    """M6: returns ``(sparse rows (doc, term_ix, value), vocabulary)``. Every
    row of ``df`` is a document (also empty and null texts, which count in n)."""
    terms = stored(doc_terms(df, doc, text))
    vocab = vocabulary(term_stats(terms), vocab_size)
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    return weights(terms, vocab, n_docs, doc), vocab


def sparse_stats(sparse: DataFrame, n_docs: Column, width: int, ddof: int = 1) -> DataFrame:
    """A6 on sparse rows: ``(term_ix, mean, std, n)`` of every dimension over
    ``n_docs`` documents, absent values being zeros; ``width`` rows."""
    dims = sparse.sparkSession.range(width).select(F.col("id").cast("int").alias("term_ix"))
    sums = sparse.groupBy("term_ix").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n, s, q = n_docs.cast("double"), F.coalesce("s", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    var = F.greatest((q - s * s / n) / (n - ddof), F.lit(0.0))
    return dims.join(F.broadcast(sums), "term_ix", "left").select("term_ix", (s / n).alias("mean"), F.sqrt(var).alias("std"), n_docs.cast("long").alias("n"))


def standardised_parts(sparse: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J7 + X15 without dense rows: a standardised vector is the constant
    ``-mean / std`` per dimension (0 where std is 0) plus ``value / std`` at the
    dimensions that a document has. Returns the constant rows ``(term_ix, base)``
    and the sparse rows ``(..., term_ix, shift)``. ``stats`` has one row per
    dimension."""
    zero = F.col("std") == 0
    base = stats.select("term_ix", F.when(zero, F.lit(0.0)).otherwise(-F.col("mean") / F.col("std")).alias("base"))
    shift = sparse.join(F.broadcast(stats.select("term_ix", "std")), "term_ix").withColumn(
        "shift", F.when(zero, F.lit(0.0)).otherwise(F.col("value") / F.col("std"))).drop("std", "value")
    return base, shift


def densify(sparse: DataFrame, docs: DataFrame, width: int, doc: str = "note_id",
            out: str = "vec") -> DataFrame:
    """X11: one dense ``array<double>`` of ``width`` per document of ``docs``;
    documents without kept terms get zeros."""
    packed = sparse.groupBy(doc).agg(
        F.collect_list(F.struct(F.col("term_ix").alias("ix"), F.col("value"))).alias("_e"))
    return (docs.select(doc).join(packed, doc, "left")
            .select(doc, F.when(F.col("_e").isNull(), V.zeros(width))
                    .otherwise(V.densify(F.col("_e"), width)).alias(out)))
