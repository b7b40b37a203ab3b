"""Reproducible draws: the same row gets the same number under any partitioning, in any engine
that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12  # hexadecimal
SPAN = 16**DIGITS
NULL, BETWEEN = "\x00", "\x1f"


def ticket(*values: Column) -> Column:
    """A number in 0..SPAN-1 from the values as text."""
    texts = [F.coalesce(v.cast("string"), F.lit(NULL)) for v in values]
    digest = F.md5(F.concat_ws(BETWEEN, *texts))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint")
