"""Notes: label store, ordering, subject relations, gate, statistics and
sample assembly (M7 S6 J4 J5 J6 J12 W1 T1 F2 A6 A9 X12 X13 X18 M8 P7 P12).

Note sequences stay in long form ``(subject, note_pos, note_id, vec)``: one
row per note, stored once per subject. An admission refers to its subject's
sequence by key instead of copying it, so no (admission x note) pairs are
ever produced, and a subject with a third of all notes is just many rows
spread over the range-partitioned positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions import keys as K
from admitflow.operators.ordered import as_of, with_rank_within


def note_labels(notes: DataFrame) -> DataFrame:
    """M7 + S6: the label store ``(note_id, subject, hadm, note_seq)``; an
    unreadable sequence number becomes -1."""
    return notes.select(
        "note_id", F.col("subject").cast("string").alias("subject"), F.col("hadm").cast("string").alias("hadm"),
        K.note_seq_of(F.col("note_seq")).alias("note_seq"))


def with_labels(notes: DataFrame, labels: DataFrame) -> DataFrame:
    """Notes left-joined to the label store; a note without a label row has
    sequence number -1, and of several rows of one note the largest counts."""
    one = labels.groupBy("note_id").agg(F.max("note_seq").alias("note_seq"))
    return notes.drop("note_seq").join(one, "note_id", "left").withColumn(
        "note_seq", F.coalesce("note_seq", F.lit(K.BAD_NOTE_SEQ)).cast("long"))


def note_order(labels: DataFrame) -> DataFrame:
    """W1 + T1 + F2: 0-based position of a note inside its subject, by
    ``note_seq`` and then ``note_id`` (a stable, reproducible tie rule)."""
    return with_rank_within(labels, ["subject"], ["note_seq", "note_id"], "note_pos")


def related_subjects(ids: DataFrame, notes: DataFrame, key: str = "id") -> DataFrame:
    """J12 + X12: each id with its subject and the number of notes that
    subject has (0 when none) - the equi form of the relation."""
    per_subject = notes.groupBy(K.subject_of(F.col("note_id")).alias("subject")).agg(
        F.count(F.lit(1)).alias("n_notes"))
    return (ids.select(key, K.subject_of(F.col(key)).alias("subject"))
            .join(per_subject, "subject", "left")
            .select(key, "subject", F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes")))


def related_contains(subjects: DataFrame, notes: DataFrame, subject: str = "subject", splits: int = 16) -> DataFrame:
    """J4 + X13: every (subject, note_id) where the note id contains the
    subject string - the reference's substring rule.

    Exact and hash-joinable: each note id is expanded into its distinct
    substrings, only of lengths that occur among the subjects (a small set, read
    as one value), which are equi-joined to the subject keys. Keys are repeated
    ``splits`` times and notes spread over the copies, as a short subject occurs
    in very many ids. No nested loop, no cross product.
    """
    nid = F.col("note_id")
    n = F.length(nid)
    keys = subjects.select(F.col(subject).alias("_s")).distinct()
    lengths = F.coalesce(keys.agg(F.collect_set(F.length("_s"))).scalar(), F.array().cast("array<int>"))
    found = F.flatten(F.transform("_lengths", lambda k: F.when(k <= n, F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda start: F.substring(nid, start, k))).otherwise(F.array().cast("array<string>"))))
    subs = notes.select("note_id").distinct().withColumn("_lengths", lengths).select(
        "note_id", F.pmod(F.xxhash64("note_id"), F.lit(splits)).cast("int").alias("_split"), F.explode(F.array_distinct(found)).alias("_s"))
    keys = keys.select("_s", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("_split"))
    return subs.join(keys, ["_s", "_split"]).select(F.col("_s").alias("subject"), "note_id")


def gate(ids: DataFrame, notes: DataFrame, key: str = "id") -> DataFrame:
    """J5 + P7: does a note keyed by the admission id itself exist."""
    own = notes.select(F.col("note_id").alias(key)).distinct().withColumn("has_note", F.lit(True))
    return ids.select(key).join(own, key, "left").select(
        key, F.coalesce("has_note", F.lit(False)).alias("has_note"))


def sequences(ordered: DataFrame, vecs: DataFrame, vec: str = "vec") -> DataFrame:
    """A9 + S4: each subject's notes with their vectors, long form, in
    ``note_pos`` order. A note without a vector keeps a null ``vec``."""
    return ordered.select("subject", "note_pos", "note_id").join(vecs.select("note_id", vec), "note_id", "left")


def history(admissions: DataFrame, notes: DataFrame, on: list[str], sums: dict[str, Column] | None = None,
            columns: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """J5 + J12 + A9 as of the admission (``as_of``): each admission with the
    notes of its subject that are not later in ``on`` - their number ``n_before``,
    the last one's ``last_note`` and ``columns``, and, per name in ``sums``, the
    sum of an expression over them. The reference takes all notes of the subject,
    also those written after the admission (Q2)."""
    told = notes.withColumn("last_note", F.col("note_id"))
    return as_of(admissions, told, ["subject"], on, ["last_note", *columns], {"n_before": F.lit(1).cast("long"), **(sums or {})}, strict)
