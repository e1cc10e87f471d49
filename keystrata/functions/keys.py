"""Key extraction from delimited text and size rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_atoi(field: Column) -> Column:
    """C's ``atoi`` as a long: leading blanks, an optional sign, digits; anything else is 0. Null stays null.

    Numbers beyond 32 bits are kept, never wrapped; beyond 64 bits they give 0.
    """
    digits = F.regexp_extract(field, r"^[ \t\n\r\f\x0B]*([+-]?[0-9]+)", 1)
    parsed = F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(field.isNotNull(), parsed)


def text_key(line: Column, key_pos: int = 1, delimiter: str = "|") -> Column:
    """The integer key of a delimited line: field 1 when ``key_pos`` is 1, field 2 otherwise."""
    return c_atoi(F.split_part(line, F.lit(delimiter), F.lit(1 if key_pos == 1 else 2)))


def round_up(x: Column, multiple: int) -> Column:
    """Smallest multiple that is at least x."""
    return (F.ceil(x / F.lit(multiple)) * multiple).cast("bigint")


def round_down(x: Column, multiple: int) -> Column:
    """Largest multiple that is at most x."""
    return (F.floor(x / F.lit(multiple)) * multiple).cast("bigint")


def clamp_or_zero(x: Column, low, high) -> Column:
    """x inside [low, high], else 0; null gives 0."""
    return F.when(x.between(low, high), x).otherwise(F.lit(0.0))
