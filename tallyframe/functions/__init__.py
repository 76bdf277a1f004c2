"""Column functions: SQL text normalization, fingerprints and gateway tags. No UDF."""

from tallyframe.functions.fingerprint import FP_VERSION, fingerprint, fingerprint_versioned
from tallyframe.functions.scalar import to_number, to_second, utc_day, utc_midnight
from tallyframe.functions.tags import has_tag, is_gateway_routed, parse_tag, tag_tokens, tag_value, token_value
from tallyframe.functions.text import (
    lower_text,
    mask_numbers,
    mask_strings,
    normalize_sql,
    squeeze,
    strip_block,
    strip_line,
)

__all__ = [
    "FP_VERSION",
    "fingerprint",
    "fingerprint_versioned",
    "has_tag",
    "is_gateway_routed",
    "lower_text",
    "mask_numbers",
    "mask_strings",
    "normalize_sql",
    "parse_tag",
    "squeeze",
    "strip_block",
    "strip_line",
    "tag_tokens",
    "tag_value",
    "to_number",
    "to_second",
    "token_value",
    "utc_day",
    "utc_midnight",
]
