"""Edit distance of texts of any length, exact, with a column of the table of distances as bits of whole numbers.

A column of the table differs from row to row by at most one, so that two bits a row tell it, and all rows of the next column
follow from a few operations on whole numbers (bit-parallel recurrences of Myers and Hyyro). Texts that are much alike need
only the diagonals near the middle: a band of ``k`` diagonals gives an upper bound, which is the distance if it isn't above
``k``; else the band doubles, at most to the bound, until it would be wider than the whole column.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diagonals to begin with.
BAND = 64


def _places(text: str) -> dict[str, int]:
    """For each character, the places where it stands as bits."""
    found: dict[str, bytearray] = {}
    size = len(text) // 8 + 1
    for i, c in enumerate(text):
        bits = found.get(c)
        if bits is None:
            bits = found[c] = bytearray(size)
        bits[i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(b, "little") for c, b in found.items()}


def _whole(places: dict[str, int], m: int, text: str) -> int:
    """The distance from all rows."""
    full, last = (1 << m) - 1, m - 1
    up, down, score = full, 0, m
    for c in text:
        x = places.get(c, 0)
        same = (((x & up) + up) ^ up | x | down) & full
        right, left = down | ((same | up) ^ full), same & up
        score += (right >> last) - (left >> last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ((same | right) ^ full), same & right
    return score


def _banded(places: dict[str, int], m: int, text: str, k: int) -> int:
    """An upper bound of the distance, exact if it is at most k. Bit b stands for row j - above + b in column j."""
    n = len(text)
    below, above = min(m, (k + m - n) // 2), min(n, (k + n - m) // 2)
    width = below + above + 1
    full, top = (1 << width) - 1, width - 1
    up, down, score = full ^ ((1 << above) - 1), 0, below
    for j, c in enumerate(text, 1):
        x, shift = places.get(c, 0), j - above - 1
        x = (x >> shift if shift >= 0 else x << -shift) & full
        same = (((x & up) + up) ^ up | x | down) & full
        right, left = down | ((same | up) ^ full), same & up
        if j <= m - below:  # along the lowest diagonal, then along the last row
            score += 1 - (same >> top)
        else:
            b = m - j + above
            score += (right >> b & 1) - (left >> b & 1)
        same >>= 1
        up, down = left | ((same | right) ^ full), same & right
    return score


def distance(a: str, b: str) -> int:
    """The least number of inserted, deleted and replaced code points that make one text of the other."""
    if len(a) < len(b):
        a, b = b, a
    begin = len(os.path.commonprefix((a, b)))
    a, b = a[begin:], b[begin:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    m, n = len(a), len(b)
    if not n:
        return m
    places, k = _places(a), max(BAND, 2 * (m - n))
    while k < m:
        bound = _banded(places, m, b, k)
        if bound <= k:
            return bound
        k = min(2 * k, bound)
    return _whole(places, m, b)


def similarity(a: str, b: str) -> float:
    """One minus the distance over the longer length; two empty texts are the same."""
    return 1.0 if a == b else 1 - distance(a, b) / max(len(a), len(b))


def edit_distance(a: Column, b: Column) -> Column:
    """The distance of two columns of texts of any length; null where one is null."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int64")

    return run(a.cast("string"), b.cast("string"))


def long_levenshtein_score(output: Column, expected: Column) -> Column:
    """``levenshtein_score`` for long texts."""
    longer = F.greatest(F.length(output.cast("string")), F.length(expected.cast("string")))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - edit_distance(output, expected) / longer)
