"""Large text and binary values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and suffix of the reproduced behaviour.
MAX_TEXT_CHARS = 10 * 1024 * 1024
MAX_BINARY_BYTES = 50 * 1024 * 1024
CUT_SUFFIX = "...[truncated]"
DATA_URI = "^data:image/[^;]+;base64,"


def cap_text(text: Column, limit: int = MAX_TEXT_CHARS) -> Column:
    """Text longer than ``limit`` characters is cut there and marked."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(CUT_SUFFIX))).otherwise(text)


def is_cut(text: Column, limit: int = MAX_TEXT_CHARS) -> Column:
    return F.length(text) > limit


def encode_binary(data: Column, limit: int = MAX_BINARY_BYTES) -> Column:
    """Base64 of at most ``limit`` bytes, else NULL. Spark wraps base64 at 76 characters; the line ends are removed."""
    plain = F.regexp_replace(F.base64(data), "[\r\n]", "")
    return F.when(F.octet_length(data) <= limit, plain)


def decode_binary(text: Column) -> Column:
    """Bytes of plain base64 or of an image data URI; text that is neither becomes NULL."""
    body = F.regexp_replace(text, DATA_URI, "")
    return F.try_to_binary(body, F.lit("base64"))
