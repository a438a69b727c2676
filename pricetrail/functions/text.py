"""Trimming and truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_nullable(value: Column, length: int) -> Column:
    """Spaces-only trim, blank to null, cut to ``length`` characters."""
    trimmed = F.trim(value)
    return F.when(trimmed == "", F.lit(None).cast("string")).otherwise(
        F.substring(trimmed, 1, max(length, 0))
    )


def trim_required(value: Column, length: int) -> Column:
    return F.coalesce(trim_nullable(value, length), F.lit(""))


def strip(value: Column) -> Column:
    """Trim any Unicode whitespace from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def null_if_blank(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def strip_and_cut(value: Column, length: int) -> Column:
    """Whitespace trim, blank or null to '', cut to ``length`` characters."""
    return F.coalesce(F.substring(strip(value), 1, length), F.lit(""))


def trim_message(value: Column) -> Column:
    return strip_and_cut(value, 400)
