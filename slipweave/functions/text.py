"""Scalar string functions whose results must equal Python's."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points str.strip() removes.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """str.strip(): trim() alone removes U+0020 only."""
    return F.btrim(text, F.lit(STRIPPED))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Path.stem: a leading dot is part of the stem, only the last suffix goes."""
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased Path.suffix; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def path_parts(path: Column) -> Column:
    """Sort key of Path: component by component, not character by character."""
    return F.split(path, "/")


def newlines(text: Column) -> Column:
    """Universal newlines, as a text-mode read does."""
    return F.regexp_replace(text, "\r\n?", "\n")


def rounded(value: Column, places: int) -> Column:
    """Python's round(value, places) of a double: by its binary value, half to even.
    F.round() rounds the shortest decimal text instead. Huge and non-finite values stay."""
    half, unit = float(f"5e-{places + 1}"), float(f"1e-{places}")
    # The formatter is off where no digit is left: the double next to half a unit may lie on either side of it.
    up = F.abs(value) >= half if Fraction(half) > Fraction(5, 10 ** (places + 1)) else F.abs(value) > half
    plain = F.regexp_replace(F.format_number(value, places), ",", "").cast("double")
    return (
        F.when(F.isnan(value) | (F.abs(value) >= 1e15), value)
        .when(F.abs(value) < unit, F.when(up, F.signum(value) * unit).otherwise(F.lit(0.0)))
        .otherwise(plain)
    )


def or_default(value: Column, default: Column, empty: Column) -> Column:
    """Python's `value or default` for one falsy literal besides null."""
    return F.coalesce(F.nullif(value, empty), default)
