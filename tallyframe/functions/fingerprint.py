"""Fingerprint: the first 16 base32 characters of the SHA-256 of the normalized text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import normalize_sql

# Algorithm version, RFC 4648 alphabet in lower case, digits of Spark's base-32 conv.
FP_VERSION = 1
_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _base32(hex40: Column) -> Column:
    """Eight base32 characters for ten hex digits (40 bits)."""
    digits = F.lpad(F.conv(hex40, 16, 32), 8, "0")
    return F.translate(digits, _CONV_DIGITS, _BASE32)


def fingerprint(text: Column) -> Column:
    """16-character key ``ck`` of a statement text; equal for texts that differ in literals only."""
    sha = F.sha2(normalize_sql(text), 256)
    ck = F.concat(_base32(F.substring(sha, 1, 10)), _base32(F.substring(sha, 11, 10)))
    # Never NULL; saying so keeps a join on ck from testing it in the scan, at the price of a second
    # evaluation.
    return F.coalesce(ck, F.lit(""))


def fingerprint_versioned(text: Column) -> list[Column]:
    """``ck`` and the version of the algorithm that produced it."""
    return [fingerprint(text).alias("ck"), F.lit(FP_VERSION).alias("fp_version")]
