"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    d = doubles(v)
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n))
