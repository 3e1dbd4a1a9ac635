"""Column expressions on single readings. No UDFs: everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality flags whose readings are discarded.
REJECTED_FLAGS = ("3", "7", "9")
# Integers that mean "no reading", lenient and strict reader.
MISSING_CODES = (9999, -9999, 999, -999)
MISSING_CODES_STRICT = (9999, -9999)
# Numbers that mean "no reading" in columns already in degrees.
MISSING_CELSIUS = (9999.0, -9999.0, 999.9, -999.9)

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_BLANKS = " \t\n\r\f\x0b"


def null_if_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def parse_encoded(col: Column, strict: bool = False) -> Column:
    """Decode ``value,flag`` in tenths of a degree.

    Lenient: no comma means a good flag, and all text after the first comma is the flag.
    Strict: exactly one comma is required and 999 is an ordinary value.
    """
    text = col.cast("string")
    if not strict:
        text = F.btrim(text, F.lit(_BLANKS))
    comma = F.instr(text, ",")
    flag = F.substr(text, comma + 1)
    # A cast to an integer rejects fractions and other text, and ignores blanks around the digits.
    value = F.substring_index(text, ",", 1).try_cast("bigint")
    codes = MISSING_CODES_STRICT if strict else MISSING_CODES
    if strict:
        accepted = (comma > 0) & (F.instr(flag, ",") == 0) & ~flag.isin(*REJECTED_FLAGS)
    else:
        accepted = (comma == 0) | ~flag.isin(*REJECTED_FLAGS)
    return F.when(accepted & ~value.isin(*codes), value / 10.0)


def parse_celsius(col: Column) -> Column:
    """Read a column that already holds degrees."""
    value = null_if_nan(col.try_cast("double"))
    return F.when(~value.isin(*MISSING_CELSIUS), value)


def is_plain_number(col: Column) -> Column:
    """True where a text cell is a bare number, i.e. not ``value,flag``."""
    return F.btrim(col.cast("string"), F.lit(_BLANKS)).rlike(_NUMBER)


def in_range(col: Column, low: float, high: float) -> Column:
    """Keep values in the closed range, else NULL."""
    return F.when(col.between(F.lit(low), F.lit(high)), col)


def out_of_range(col: Column, low: float, high: float) -> Column:
    return (col < F.lit(low)) | (col > F.lit(high))


def above_other(col: Column, other: Column) -> Column:
    return col > other


def clamp_to(col: Column, ceiling: Column) -> Column:
    """``col`` no higher than ``ceiling``; unchanged where either side is NULL."""
    return F.when(above_other(col, ceiling), ceiling).otherwise(col)


def wind_components(direction: Column) -> tuple[Column, Column]:
    """Unit-vector parts of a compass direction in degrees."""
    angle = direction * F.lit(math.pi) / F.lit(180.0)
    return F.cos(angle), F.sin(angle)


def diurnal_profile(temp: Column, dew: Column, horizon: int = 24) -> Column:
    """Sine-shaped day around ``temp``, lowered by dryness; one decimal, hours 1..horizon."""
    # an expression an hour, whose wave is a constant: no lambda is called row by row
    wave = lambda h: F.sin((F.lit(h) - F.lit(9)) * F.lit(2.0) * F.lit(math.pi) / F.lit(24.0))
    return F.array(*[F.round(temp + wave(h) * F.lit(4.5) - (temp - dew) * F.lit(0.15), 1) for h in range(1, horizon + 1)])
