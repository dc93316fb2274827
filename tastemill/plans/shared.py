"""Column helpers for query outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: str | Column, name: str | None = None) -> Column:
    """Six decimals, under the same or a given name."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def moment(c: str) -> Column:
    """Timestamp as text with microseconds."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


# the same text in DuckDB
MOMENT = "%Y-%m-%d %H:%M:%S.%f"
