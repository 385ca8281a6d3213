"""Text helpers: Python-compatible trimming, NFC normalisation, language guess."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.vocab import SPACE_CHARS, SPACE_CLASS, ZERO_WIDTH_CLASS

# No character below U+0300 takes part in composition, so text made of those
# only is already in NFC and never has to leave the JVM.
_MAY_COMPOSE = "[^\\u0000-\\u02ff]"


def strip(c: Column) -> Column:
    """Trim any Unicode white space (``trim`` removes plain spaces only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def blank_to_empty(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def squash_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), SPACE_CLASS + "+", " ")


def _nfc_udf():
    # a local function travels by value: executors need not import this package
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([t and unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(compose, "string")  # of the kind of the other functions on answers: they share one call of a worker


def to_nfc(c: Column) -> Column:
    """NFC, sending only text that could change to the Arrow UDF."""
    candidate = F.when(c.rlike(_MAY_COMPOSE), c)
    return F.coalesce(_nfc_udf()(candidate), c)


def normalize_text(c: Column) -> Column:
    """NFC, zero-width characters removed, trimmed, white space collapsed."""
    text = F.regexp_replace(to_nfc(F.coalesce(c, F.lit(""))), ZERO_WIDTH_CLASS, "")
    return squash_spaces(text)


def token_count(normalized: Column) -> Column:
    """Number of space-separated tokens of a normalised text."""
    spaces = F.length(normalized) - F.length(F.replace(normalized, F.lit(" "), F.lit("")))
    return F.when(normalized == "", F.lit(0)).otherwise(spaces + 1).cast("int")


def language_guess(normalized: Column) -> Column:
    """ENGLISH_LIKELY when more than 95 % of the characters are ASCII."""
    total = F.length(normalized)
    others = F.length(F.regexp_replace(normalized, "[\\x00-\\x7f]+", ""))
    share = (total - others) / total
    return F.when((total > 0) & (share > 0.95), "ENGLISH_LIKELY").otherwise("UNKNOWN")
