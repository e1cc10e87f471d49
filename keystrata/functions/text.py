"""Number and time texts, and numbers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(number: Column) -> Column:
    """Whole number with commas between groups of three; negative ones in parentheses."""
    grouped = F.format_number(F.abs(number.cast("bigint")), 0)
    return F.when(number < 0, F.concat(F.lit("("), grouped, F.lit(")"))).otherwise(grouped)


def patterned(number: Column, pattern: str) -> Column:
    """The number in a printf pattern, such as '%d watt' for whole numbers or '%.2f' for doubles."""
    return F.format_string(pattern, number)


def text_to_long(text: Column) -> Column:
    """Leading whole number as C reads it with base 0: 0x marks hexadecimal, a leading 0 octal; 0 where there is none."""
    trimmed = F.regexp_extract(text, r"^[ \t\n\r\f\x0B]*([+-]?(?:0[xX][0-9a-fA-F]+|[0-9]+))", 1)
    sign = F.when(F.startswith(trimmed, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    digits = F.lower(F.regexp_replace(trimmed, r"^[+-]", ""))
    octal = F.regexp_extract(digits, r"^0([0-7]+)", 1)
    value = (
        F.when(F.startswith(digits, F.lit("0x")), F.conv(F.substr(digits, F.lit(3)), 16, 10).try_cast("bigint"))
        .when(F.startswith(digits, F.lit("0")), F.conv(F.coalesce(F.nullif(octal, F.lit("")), F.lit("0")), 8, 10).try_cast("bigint"))
        .otherwise(F.nullif(digits, F.lit("")).try_cast("bigint"))
    )
    return F.when(text.isNotNull(), F.coalesce(value, F.lit(0).cast("bigint")) * sign)


def text_to_double(text: Column) -> Column:
    """Leading decimal number; 0.0 where there is none."""
    found = F.regexp_extract(text, r"^[ \t\n\r\f\x0B]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(text.isNotNull(), F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0)))


def time_text(ts: Column) -> Column:
    """year:month:day:hour:minute:second, months counted from 0 as the logs have them."""
    return F.format_string("%d:%02d:%02d:%02d:%02d:%02d", F.year(ts), F.month(ts) - 1, F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))


def parse_time_text(text: Column) -> Column:
    """The timestamp behind time_text(); null where a field is missing or out of range."""
    part = lambda i: F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("int")
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(1), part(2) + 1, *[part(i) for i in (3, 4, 5, 6)]), F.lit("yyyy-MM-dd HH:mm:ss"))
