"""Line and substring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col


def lines(content) -> Column:
    """Lines as a scanner gives them: without line ends, and none after the last one."""
    raw = F.split(col(content), "\n", -1)
    kept = F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    return F.transform(kept, lambda x: F.when(x.endswith("\r"), F.regexp_replace(x, "\r$", "")).otherwise(x))


def occurrences(hay, needle: str) -> Column:
    """How often needle occurs, without overlap."""
    h = col(hay)
    return ((F.length(h) - F.length(F.replace(h, F.lit(needle), F.lit("")))) / len(needle)).cast("int") if needle else F.lit(0)


def bytes_of(c) -> Column:
    return F.octet_length(col(c))
