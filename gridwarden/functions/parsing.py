"""Typing of untrusted text columns. Junk becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def to_double(c: Column) -> Column:
    """Number or null: decimal notation or `inf`. What else Java reads as a number (`12.9d`,
    hexadecimal `0x1p3`, `nan`) is junk."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def to_utc_timestamp(c: Column, formats: tuple[str, ...] = ()) -> Column:
    """ISO first, then the given patterns; row by row, so the answer needs no neighbours."""
    # a bare time of day would be read as today's date, which no rerun could reproduce
    tries = [F.when(c.rlike(r"^\s*\d{4}"), c.try_cast("timestamp"))]
    tries += [F.try_to_timestamp(c, F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)
