"""An order that is stable for a day: a seeded permutation, of a list or of places in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

M32 = 0xFFFFFFFF


def fnv1a(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & M32
    return h


def mulberry32(seed: int):  # noqa: ANN201
    """Yields floats in [0, 1) by the published generator."""
    a = seed & M32
    while True:
        a = (a + 0x6D2B79F5) & M32
        t = ((a ^ (a >> 15)) * (a | 1)) & M32
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & M32)) & M32
        yield ((t ^ (t >> 14)) & M32) / 4294967296


def permutation(n: int, day: str) -> list[int]:
    """Fisher-Yates over 0..n-1, seeded by the day; for pages that fit one machine."""
    order, draw = list(range(n)), mulberry32(fnv1a(day))
    for i in range(n - 1, 0, -1):
        j = int(next(draw) * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def daily_key(day: str, key: str) -> tuple[Column, Column]:
    """Order columns with the same contract at any size: another order each day."""
    return F.xxhash64(F.lit(day), F.col(key)).asc(), F.col(key).asc()


def fnv1a_of(text: Column) -> Column:
    """``fnv1a`` of each row's text, by code points."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(M32)))


#: Rounds of the keyed permutation, and the prime of its round function.
ROUNDS, PRIME = 4, 2**31 - 1


def feistel(n: int, day: str) -> tuple[int, int, list[tuple[int, int]], int]:
    """(a, b, keys, steps) of the permutation of 0..n-1: the places are an a x b rectangle with fewer than a places to spare.

    A step that ends on a spare place is followed by another.  ``steps`` is how many can be needed:
    one more than spare places, or for large n so many that more are needed with a chance below 10^-40.
    """
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    b = max(-(-n // a), 1)
    keys = [(fnv1a(f"{day}:{k}:x") % PRIME, fnv1a(f"{day}:{k}:y") % PRIME) for k in range(ROUNDS)]
    enough = math.ceil(2 * (1 + 40 / math.log10(n))) if n > 10_000 else n + 1
    return a, b, keys, min(a * b - n + 1, enough)


def permuted(place: Column, n: int, day: str) -> Column:
    """The position of a place of 0..n-1 in the day's order: a bijection, computed for each row by itself.

    An unbalanced Feistel network: to one half a number that depends on the other half is added,
    in turns, so every step can be undone.
    """
    a, b, keys, steps = feistel(n, day)

    def turn(h: Column, k: int) -> Column:
        x = h["r"] if k % 2 == 0 else h["l"]
        more = ((x + keys[k][0]) % PRIME) * ((x + keys[k][1]) % PRIME) % PRIME
        left, right = (((h["l"] + more) % a, h["r"]) if k % 2 == 0 else (h["l"], (h["r"] + more) % b))
        return F.struct(left.alias("l"), right.alias("r"))

    def step(v: Column) -> Column:
        h = F.struct(F.call_function("div", v, F.lit(b)).alias("l"), (v % b).alias("r"))
        for k in range(ROUNDS):
            h = let(h, lambda x, k=k: turn(x, k))
        return let(h, lambda x: x["l"] * b + x["r"])

    again = F.array_repeat(F.lit(0), steps - 1)
    return F.aggregate(again, step(place.cast("long")), lambda v, _: F.when(v < n, v).otherwise(step(v)))
