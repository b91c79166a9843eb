"""Measures of a text body: token estimate and line count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def other_chars(text: Column) -> Column:
    """Code points outside ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(
        F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    )


def tokens_of(ascii_chars: Column, other: Column, scale: Column | None = None) -> Column:
    """Four ASCII characters or one and a half others per token, at least 1.

    The two counts add up over texts, so the estimate of any concatenation
    comes from summed counts and is exact.
    """
    raw = ascii_chars / F.lit(4.0) + other / F.lit(1.5)
    scaled = raw if scale is None else raw * scale
    total = ascii_chars + other
    # Unknown stays unknown: greatest() alone would turn a null into 1.
    return F.when(total == 0, F.lit(0).cast("long")).when(
        total > 0, F.greatest(F.lit(1).cast("long"), F.rint(scaled).cast("long"))
    )


def tokens(text: Column, scale: Column | None = None) -> Column:
    other = other_chars(text)
    return tokens_of(F.length(text) - other, other, scale)


def lines(text: Column, scale: Column | None = None) -> Column:
    """Line feeds, plus one for a last line without; scaled when cut short."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    n = (breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")
    if scale is not None:
        n = F.when(scale == 1.0, n).otherwise(
            F.greatest(F.lit(1).cast("long"), F.rint(n * scale).cast("long"))
        )
    return F.when(text == "", F.lit(0).cast("long")).when(text.isNotNull(), n)


def cut_scale(size: Column, byte_len: Column, truncated: Column) -> Column:
    """Factor from the bytes read to the bytes on disk."""
    return F.when(
        truncated & (size > 0) & (byte_len > 0), size.cast("double") / byte_len.cast("double")
    ).otherwise(F.lit(1.0))
