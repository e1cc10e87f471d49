"""Bit fields of 64-bit register images held as longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_mask(begin: int, end: int) -> int:
    """Bits begin..end set, ends given in either order, as a signed 64-bit literal."""
    low, high = sorted((begin, end))
    mask = ((1 << (high - low + 1)) - 1) << low
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bit_extract(value: Column, begin: int, end: int) -> Column:
    """Bits begin..end of value as a non-negative number (ends in either order)."""
    low, high = sorted((begin, end))
    shifted = F.shiftrightunsigned(value.cast("bigint"), low)
    return shifted.bitwiseAND(F.lit(bit_mask(0, high - low)).cast("bigint"))


def bit_set(value: Column, begin: int, end: int) -> Column:
    return value.cast("bigint").bitwiseOR(F.lit(bit_mask(begin, end)).cast("bigint"))


def bit_clear(value: Column, begin: int, end: int) -> Column:
    return value.cast("bigint").bitwiseAND(F.lit(~bit_mask(begin, end)).cast("bigint"))


def bits_all_set(value: Column, begin: int, end: int) -> Column:
    mask = F.lit(bit_mask(begin, end)).cast("bigint")
    return value.cast("bigint").bitwiseAND(mask) == mask


def bit_count_range(value: Column, begin: int, end: int) -> Column:
    return F.bit_count(bit_extract(value, begin, end))


def bit_swap(value: Column, a: int, b: int) -> Column:
    """value with bits a and b exchanged."""
    differ = bit_extract(value, a, a).bitwiseXOR(bit_extract(value, b, b))
    both = F.lit(bit_mask(a, a) | bit_mask(b, b)).cast("bigint")
    return F.when(differ == 1, value.cast("bigint").bitwiseXOR(both)).otherwise(value.cast("bigint"))


def byte_fields(value: Column, prefix: str) -> list[Column]:
    """The eight 8-bit fields of a register, lowest first, as ``prefix0`` .. ``prefix7``."""
    return [bit_extract(value, 8 * i, 8 * i + 7).alias(f"{prefix}{i}") for i in range(8)]
