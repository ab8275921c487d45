"""Reproducible draws without state: rows in the order of a hash of seed and identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int | str | Column, *identity: Column | str) -> Column:
    """md5 of seed and identity; the same in every engine, session and partitioning."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in identity)))


def coin(seed: int | str | Column, *identity: Column | str) -> Column:
    """0 or 1 with equal chance."""
    return F.conv(F.substring(draw_key(seed, *identity), 1, 8), 16, 10).cast("long") % 2


def pick(n: Column | int, seed: int | str | Column, *identity: Column | str) -> Column:
    """A number from 0 to n - 1, with replacement over calls."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.conv(F.substring(draw_key(seed, *identity), 1, 8), 16, 10).cast("long") % n
