"""What a statement says about how it came: the key=value tokens of its first comment, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import WHITESPACE

# The marker, and the exact prefix that coverage counts as routed.
MARKER = "abx"
ROUTED_PREFIX = "/* abx "

# Marker, one white-space character, then anything without '*' up to the closing '*/'.
_TAG = rf"^[{WHITESPACE}]*+/\*[{WHITESPACE}]*+{MARKER}([{WHITESPACE}][^*]++)\*/"


def is_gateway_routed(text: Column) -> Column:
    """Strict test used by coverage: exact prefix, closing ``*/`` not required. NULL stays NULL."""
    return text.startswith(ROUTED_PREFIX)


def has_tag(text: Column) -> Column:
    """Lenient test: a complete tag comment, leading white space allowed."""
    return F.coalesce(text, F.lit("")).rlike(_TAG)


def tag_tokens(text: Column) -> Column:
    """The ``key=value`` tokens of the tag; NULL without a tag or if any token lacks ``=``."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), _TAG, 1)
    tokens = F.filter(F.split(body, f"[{WHITESPACE}]+"), lambda t: t != "")
    return F.when((body != "") & F.forall(tokens, lambda t: t.contains("=")), tokens)


def token_value(tokens: Column, key: str) -> Column:
    """Value of the last token with this key, NULL if there is none."""
    hits = F.filter(tokens, lambda t: t.startswith(f"{key}="))
    return F.get(F.split(F.try_element_at(hits, F.lit(-1)), "=", 2), 1)


def tag_value(text: Column, key: str) -> Column:
    return token_value(tag_tokens(text), key)


def parse_tag(text: Column) -> Column:
    """The tag as a map; the last of duplicate keys wins. NULL where :func:`tag_tokens` is NULL."""
    entries = F.array_sort(
        F.transform(
            tag_tokens(text),
            lambda t, i: F.struct(
                F.get(F.split(t, "=", 2), 0).alias("key"),
                i.alias("pos"),
                F.get(F.split(t, "=", 2), 1).alias("value"),
            ),
        )
    )
    # Sorted by key and position, an entry survives if the next one has another key. The one-element
    # array binds the sorted entries to a variable, so they are computed once.
    last = F.transform(
        F.array(entries),
        lambda es: F.filter(es, lambda e, i: ~F.get(es, i + 1)["key"].eqNullSafe(e["key"])),
    )[0]
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
