"""Key and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# Separator between subject and admission in an id: "<subject>_<...>".
ID_SEPARATOR = "_"
# Run folder name format (year-month-day_hour:minute:second).
RUN_ID_FORMAT = "yyyy-MM-dd_HH:mm:ss"
# Value used when a note's sequence number cannot be read.
BAD_NOTE_SEQ = -1
# What counts as an integer sequence number (optional sign, digits only).
INTEGER_TEXT = r"^[+-]?[0-9]+$"
# -----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subject_of(id_col) -> Column:
    """Text before the first separator."""
    return F.substring_index(_col(id_col), ID_SEPARATOR, 1)


def contains(haystack, needle) -> Column:
    """Substring test."""
    return F.contains(_col(haystack), _col(needle))


def stem(name) -> Column:
    """The text before the first dot ("model_3.csv" → "model_3")."""
    return F.substring_index(_col(name), ".", 1)


def swap_suffix(name, old: str, new: str) -> Column:
    """Rewrite a file suffix (".pt" → ".txt")."""
    return F.regexp_replace(_col(name), F.lit(_escape(old) + "$"), F.lit(new))


def has_suffix(name, suffix: str) -> Column:
    return F.endswith(_col(name), F.lit(suffix))


def run_id() -> Column:
    """Wall-clock run name."""
    return F.date_format(F.current_timestamp(), RUN_ID_FORMAT)


def note_seq_of(raw) -> Column:
    """Integer sequence number, -1 when it is missing or unreadable."""
    text = F.trim(_col(raw).cast("string"))
    whole = F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))
    return F.coalesce(whole, F.lit(BAD_NOTE_SEQ))


def _escape(s: str) -> str:
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in s)
