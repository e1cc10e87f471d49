"""Power, energy and frequency arithmetic on register fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import bit_extract

# Joules to watt-hours; 32-bit counter range; default junction limit; voltage scale; bus clocks.
WATT_HOURS_PER_JOULE = 0.00027777777778
COUNTER_RANGE = 4294967296
DEFAULT_TJ_MAX = 100
VOLTAGE_SCALE = 8192.0
BUS_HZ_100 = 100000000
BUS_HZ_133 = 133333333

# Model variants that share a family.
MODEL_FAMILY = {
    "CORE_2": "CORE_1",
    "ATOM_2": "ATOM_1",
    "ATOM_CENTERTON": "ATOM_1",
    "ATOM_BAYTRAIL": "ATOM_1",
    "ATOM_AVOTON": "ATOM_1",
    "NEHALEM_EP": "NEHALEM",
    "NEHALEM_EX": "NEHALEM",
    "CLARKDALE": "NEHALEM",
    "WESTMERE_EP": "NEHALEM",
    "WESTMERE_EX": "NEHALEM",
    "JAKETOWN": "SANDY_BRIDGE",
    "IVYTOWN": "IVY_BRIDGE",
    "HASWELL_ULT": "HASWELL",
    "HASWELL_2": "HASWELL",
    "HASWELL_E": "HASWELL",
}

# Display names of models.
CODE_NAMES = {
    "NEHALEM_EP": "Nehalem/Nehalem-EP",
    "NEHALEM": "Nehalem/Nehalem-EP",
    "ATOM_1": "Atom(tm)",
    "CLARKDALE": "Westmere/Clarkdale",
    "WESTMERE_EP": "Westmere-EP",
    "NEHALEM_EX": "Nehalem-EX",
    "WESTMERE_EX": "Westmere-EX",
    "SANDY_BRIDGE": "Sandy Bridge",
    "JAKETOWN": "Sandy Bridge-EP/Jaketown",
    "IVYTOWN": "Ivy Bridge-EP/EN/EX/Ivytown",
    "IVY_BRIDGE": "Ivy Bridge",
    "HASWELL": "Haswell",
}


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def model_family(model: Column) -> Column:
    return _lookup(model, MODEL_FAMILY, model)


def code_name(model: Column) -> Column:
    return _lookup(model, CODE_NAMES, F.lit("Unknown"))


def vendor_name(family: Column) -> Column:
    return F.when(family == 6, F.lit("Intel")).otherwise(F.lit("Unknown"))


def bus_hz(model: Column) -> Column:
    """100 MHz for the bridge and Haswell families and one server Atom, 133.33 MHz for the rest."""
    fast = model_family(model).isin("SANDY_BRIDGE", "IVY_BRIDGE", "HASWELL") | (model == "ATOM_AVOTON")
    return F.when(fast, F.lit(BUS_HZ_100)).otherwise(F.lit(BUS_HZ_133)).cast("bigint")


def nominal_hz(platform_info: Column, model: Column) -> Column:
    return bit_extract(platform_info, 8, 15) * bus_hz(model)


def multiplier(perf_status: Column, model: Column) -> Column:
    """Current clock multiplier; where its bits lie depends on the family."""
    family = model_family(model)
    half = bit_extract(perf_status, 14, 14).cast("double") * F.lit(0.5)
    return (
        F.when(family == "NEHALEM", bit_extract(perf_status, 0, 7).cast("double"))
        .when(family.isin("SANDY_BRIDGE", "IVY_BRIDGE", "HASWELL"), bit_extract(perf_status, 8, 15).cast("double"))
        .otherwise(bit_extract(perf_status, 8, 12).cast("double") + half)
    )


def unit_scale(register: Column, begin: int, end: int) -> Column:
    """1 / 2^field: power in bits 0..3, energy in 8..12, time in 16..19 of the unit register."""
    return F.lit(1.0) / F.pow(F.lit(2.0), bit_extract(register, begin, end).cast("double"))


def time_window(register: Column, y_bits: tuple[int, int], z_bits: tuple[int, int], unit: Column) -> Column:
    """2^Y * (1 + Z/4) * unit, the package power-limit window."""
    y, z = (bit_extract(register, *b).cast("double") for b in (y_bits, z_bits))
    return F.pow(F.lit(2.0), y) * (F.lit(1.0) + z / F.lit(4.0)) * unit


def plain_time_window(register: Column, y_bits: tuple[int, int], f_bits: tuple[int, int], unit: Column) -> Column:
    """2^Y * F * unit, the window of the core and memory planes."""
    y, f = (bit_extract(register, *b).cast("double") for b in (y_bits, f_bits))
    return F.pow(F.lit(2.0), y) * f * unit


def temperature_limit(register: Column) -> Column:
    """Bits 16..23 in degrees, 100 where the register could not be read."""
    return F.coalesce(bit_extract(register, 16, 23), F.lit(DEFAULT_TJ_MAX).cast("bigint"))


def temperature(tj_max: Column, slope: Column, readout: Column) -> Column:
    return tj_max - slope * readout


def voltage(register: Column) -> Column:
    return bit_extract(register, 32, 47).cast("double") / F.lit(VOLTAGE_SCALE)


def busy_percent(mperf: Column, aperf: Column) -> Column:
    """Truncated 100 * a / m; null when m is 0."""
    return F.floor(F.try_divide(aperf * 100, mperf)).cast("bigint")


def busy_p_state(percent: Column, max_ratio: Column) -> Column:
    return F.floor((max_ratio.cast("double") + F.lit(0.5)) * percent / F.lit(100.0)).cast("bigint")


def joule_to_watt_hour(joules: Column) -> Column:
    return joules * F.lit(WATT_HOURS_PER_JOULE)


def joule_to_milliwatt_hour(joules: Column) -> Column:
    return joule_to_watt_hour(joules) * F.lit(1000.0)


def fixed_point(value: Column, base: int, factor: int) -> Column:
    """value * factor / base in whole steps: (1000, 976) counts milliseconds, (10000, 153) millijoules."""
    whole = F.floor(value / F.lit(base))
    return (whole * factor + F.floor((value - whole * base) * factor / F.lit(base))).cast("bigint")
