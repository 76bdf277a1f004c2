"""Statement text normalization as column expressions.

The patterns run in linear time on any text: a comment or a string literal that never closes is
passed over once instead of being retried from each of its characters, and no pattern recurses per
character. One hostile statement therefore cannot stall or kill a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of algorithm version 1. Which characters count as white space, word or digit:
WHITESPACE = r"\p{IsWhite_Space}\x1c-\x1f"
# U+10400 is in \p{L} already; a literal supplementary character makes the look-behind read whole
# code points.
WORD = r"\p{L}\p{N}_" + "\U00010400"
DIGIT = r"\p{Nd}"

# Each pattern starts with the cheapest test that most characters fail.
# /* ... */ goes; an unclosed comment is captured to the end and put back as it was.
_BLOCK_COMMENT = r"(?s)/\*(?:.*?\*/|(?<=(/\*))(.*+))"
_LINE_COMMENT = r"--[^\n]*+"
# Runs of white space, without the single blanks that would be replaced by themselves.
_SPACES = rf"[^!-~](?<=[{WHITESPACE}])(?:(?<! )[{WHITESPACE}]*+|[{WHITESPACE}]++)"
# Literals are matched back to back from the start (\G), each with the unquoted text before it.
# Once a quote does not close, no later one does, so stopping there is exact.
_STRING = r"\G([^']*+)'(?:[^'\\]++|\\.)*+'"
_NUMBER = rf"[{DIGIT}](?<![{WORD}][{DIGIT}])[{DIGIT}]*+(?:\.[{DIGIT}]++)?(?![{WORD}])"


def strip_block(text: Column) -> Column:
    """Remove ``/* ... */`` comments; nothing is put in their place."""
    stripped = F.regexp_replace(text, _BLOCK_COMMENT, "$1$2")
    return F.when(text.contains("/*"), stripped).otherwise(text)


def strip_line(text: Column) -> Column:
    """Remove ``-- ...`` comments up to the end of the line."""
    return F.regexp_replace(text, _LINE_COMMENT, "")


def lower_text(text: Column) -> Column:
    return F.lower(text)


def squeeze(text: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def mask_strings(text: Column) -> Column:
    """Replace ``'...'`` literals by ``?``. Expects text without line breaks."""
    return F.regexp_replace(text, _STRING, "$1?")


def mask_numbers(text: Column) -> Column:
    """Replace free-standing integers and decimals by ``?``."""
    return F.regexp_replace(text, _NUMBER, "?")


def normalize_sql(text: Column) -> Column:
    """Literal-, comment-, case- and spacing-insensitive form of a statement. NULL counts as ''."""
    out = F.coalesce(text, F.lit(""))
    for step in (strip_block, strip_line, lower_text, squeeze, mask_strings, mask_numbers):
        out = step(out)
    return out
