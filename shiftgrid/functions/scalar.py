"""Scalar functions as column expressions, and small driver-side helpers."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import count, product, takewhile

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Julian year in seconds.
YEAR_SECONDS = 31_557_600.0


def reflect101(i: Column, n: int) -> Column:
    """Index ``i`` reflected into 1..n without repeating the edge; closed form of repeated reflection."""
    if n == 1:
        return F.lit(1)
    period = 2 * (n - 1)
    m = F.pmod(i - 1, F.lit(period))
    return F.least(m, period - m) + 1


def reflect101_py(p: int, n: int) -> int:
    """0-based position ``p`` reflected into 0..n-1 without repeating the edge."""
    if n == 1:
        return 0
    m = p % (2 * (n - 1))
    return min(m, 2 * (n - 1) - m)


@lru_cache(maxsize=4096)
def next_fft_size(n: int) -> int:
    """The cheapest size m in [n, 1.5 n] with prime factors up to 7, by m^2 log m and its share of twos."""
    if n <= 1:
        return 1
    top = math.ceil(1.5 * n)
    powers = lambda p: takewhile(lambda x: x <= top, (p**k for k in count()))
    smooth = [(odd * two, k) for odd in (a * b * c for a, b, c in product(powers(3), powers(5), powers(7))) for k, two in enumerate(powers(2)) if n <= odd * two <= top]
    cost = lambda m, twos: m * m * (math.log2(m) - 0.35 * twos)
    return min(smooth, key=lambda s: (cost(*s), s[0]))[0]


def fft_size(n: Column, most: int) -> Column:
    """:func:`next_fft_size` of a column of sizes up to ``most``: the cheapest of the smooth numbers it may take, by one
    ordered array of them. Sizes beyond ``most`` are null."""
    smooth = [(2**a * 3**b * 5**c * 7**d, a) for a in range(32) for b in range(20) for c in range(14) for d in range(12) if 2**a * 3**b * 5**c * 7**d <= math.ceil(1.5 * most)]
    cost = lambda m, twos: m * m * (math.log2(m) - 0.35 * twos)
    ordered = F.array(*(F.lit(m) for m, _ in sorted(smooth, key=lambda s: (cost(*s), s[0]))))
    first = F.get(F.filter(ordered, lambda m: (m >= n) & (m <= F.ceil(1.5 * n))), F.lit(0))
    return F.when(n <= 1, F.lit(1)).when(n <= most, first)


def dt_years(start: Column, end: Column) -> Column:
    """Julian years between two timestamps."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(end) - micros(start)) / (YEAR_SECONDS * 1e6)


def cubic_weights(t: Column) -> list[Column]:
    """Catmull-Rom weights of the taps at -1, 0, 1, 2 for a fraction ``t``."""
    t2, t3 = t * t, t * t * t
    return [-0.5 * t3 + t2 - 0.5 * t, 1.5 * t3 - 2.5 * t2 + 1.0, -1.5 * t3 + 2.0 * t2 + 0.5 * t, 0.5 * t3 - 0.5 * t2]


def pyrup_matrix(n: int) -> np.ndarray:
    """One doubling of an axis of ``n`` samples, as a (2n x n) matrix.

    Even places take 1/8, 3/4, 1/8 of the samples around, odd ones half of each of two; places are
    reflected in the doubled axis, without repeating the edge.
    """
    out = np.zeros((2 * n, n))
    for p in range(2 * n):
        taps = ((p - 2, 1 / 8), (p, 3 / 4), (p + 2, 1 / 8)) if p % 2 == 0 else ((p - 1, 1 / 2), (p + 1, 1 / 2))
        for q, w in taps:
            out[p, reflect101_py(q, 2 * n) // 2] += w
    return out


def refinement_matrix(n: int, factor: int) -> np.ndarray:
    """All doublings up to ``factor`` at once: (factor n x n). Every row sums to 1."""
    out = np.eye(n)
    while len(out) < n * factor:
        out = pyrup_matrix(len(out)) @ out
    return out


def c_mul(a: Column, b: Column) -> Column:
    """Product of two complex structs."""
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def c_conj_mul(a: Column, b: Column) -> tuple[Column, Column]:
    """Real and imaginary part of conj(a) b."""
    return a["re"] * b["re"] + a["im"] * b["im"], a["re"] * b["im"] - a["im"] * b["re"]


def c_abs2(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]
