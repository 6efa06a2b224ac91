"""Column expressions for note cleaning and tokenising.

Everything here is a built-in Spark expression: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's behaviour -----------------
# Stop words removed after cleaning (exact, lower-case match).
STOP_WORDS = ["the", "and", "is", "in", "to", "a", "for", "of", "on", "with",
              "at", "by", "as", "an", "it"]
# Placeholder text replaced by one space before anything else.
PLACEHOLDER = "___"
# Python's Unicode whitespace (str.isspace), as a Java regex class body.
WHITESPACE_CLASS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
                    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# A "word" character: any letter, any number, or underscore.
WORD_CLASS = r"\p{L}\p{N}_"
# Shortest token kept by the TF-IDF tokeniser.
MIN_TOKEN_CHARS = 2
# -----------------------------------------------------------------------------

_NOT_WORD = f"[^{WORD_CLASS}]+"
_NOT_WORD_NOT_SPACE = f"[^{WORD_CLASS}{WHITESPACE_CLASS}]"
_SPACE_RUN = f"[{WHITESPACE_CLASS}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(text) -> Column:
    """X1-X4 plus P8: null → '', ``___`` → ' ', newline runs → one, lower,
    non-word non-space → ' '."""
    t = F.coalesce(_col(text), F.lit(""))
    t = F.replace(t, F.lit(PLACEHOLDER), F.lit(" "))
    t = F.regexp_replace(t, r"\n+", "\n")
    t = F.lower(t)
    return F.regexp_replace(t, _NOT_WORD_NOT_SPACE, " ")


def pieces(text) -> Column:
    """The whitespace split of the normalised text, in one pass: no white space is
    a word character, so its pieces are what lies between runs of other characters."""
    t = F.replace(F.coalesce(_col(text), F.lit("")), F.lit(PLACEHOLDER), F.lit(" "))
    return F.split(F.lower(t), _NOT_WORD)


def is_token(word) -> Column:
    """X8 for one piece: long enough and no stop word."""
    return (F.length(_col(word)) >= MIN_TOKEN_CHARS) & ~_col(word).isin(*STOP_WORDS)


def words(text) -> Column:
    """X5 + X6/U5: whitespace split of the normalised text, empty pieces and
    stop words removed; duplicates and order are kept."""
    parts = pieces(text)
    # a membership test of literals is a hash lookup, that of an array compares with every element
    return F.filter(parts, lambda w: (F.length(w) > 0) & ~w.isin(*STOP_WORDS))


def clean_text(text) -> Column:
    """The cleaned string, words joined by one space."""
    return F.array_join(words(text), " ")


def tokens(text) -> Column:
    """TF-IDF tokens - cleaned words of at least two characters."""
    return F.filter(words(text), lambda w: F.length(w) >= MIN_TOKEN_CHARS)
