"""Regex matches with their positions, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def texts_and_matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern that matches no empty string, and the texts around them, one more than matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative ``combine``.

    Each pass combines every element with the one a power of two before it, so an array of n takes log2(n) linear passes;
    appending to a growing array would copy it n times.
    """
    steps = F.when(F.size(values) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size(values) - 0.5)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int")))
    none = F.array().cast("array<int>")

    def one_pass(held: Column, step: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i >= step, combine(F.get(held, i - step), x)).otherwise(x))

    return F.aggregate(F.coalesce(steps, none), values, one_pass)


def totals(lengths: Column) -> Column:
    return running(lengths, lambda a, b: a + b)


def spans(found: Column, around: Column) -> Column:
    """array<struct<start int, end int, match string>> of texts_and_matches(): code points, end exclusive.

    Both arrays stand outside the lambdas, where they are computed once; inside, an inlined one would be computed per element.
    """
    ends = totals(F.zip_with(found, F.slice(around, 1, F.size(found)), lambda m, t: F.length(t) + F.length(m)))
    return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
