"""Keyed permutations of 0..n-1 of any n, computed a place at a time: draws without replacement from numbered rows that are never listed.

The swap-or-not shuffle: in each round a number either changes places with its partner or not, as one bit of the greater of the two says,
so every round is its own inverse and the whole a permutation, without tables and whatever n is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistrel.functions.draw import draw_key

#: Rounds of the shuffle, and the multiplier of the bit that decides a swap.
ROUNDS, MULTIPLIER = 24, 1103515245


def round_numbers(seed: int | str, *identity: Column | str) -> Column:
    """The rounds' numbers of 32 bits; computed once for each permutation, not for each place."""
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda k: F.conv(F.substring(draw_key(seed, *identity, k), 1, 8), 16, 10).cast("long"))


def permuted(place: Column, n: Column, numbers: Column) -> Column:
    """Where the permutation of 0..n-1 with these round_numbers() takes a place."""

    def one_round(x: Column, number: Column) -> Column:
        partner = F.pmod(number % n - x, n)
        swap = F.floor(((F.greatest(x, partner) % 2**31) * MULTIPLIER + number) % 2**32 / 65536) % 2 == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(numbers, place.cast("long"), one_round)
