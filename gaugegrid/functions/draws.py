"""Reproducible pseudo-random draws from row keys.

A draw depends only on the key and a salt, so a task that runs twice, or a different partitioning, draws the
same numbers, and another engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2**32


def draw(*parts: Column | str) -> Column:
    """Integer in [0, 2^32) from the key parts joined with ``|``."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str) -> Column:
    """Double in [0, 1)."""
    return draw(*parts) / F.lit(float(DRAW_RANGE))
