"""Ranks of order statistics."""

from __future__ import annotations

from math import comb


def median_ranks(n: int, confidence: float = 0.8) -> tuple[int, int]:
    """Ranks (from 1) of the values that bound the median of n values: the count of heads in n fair throws lies between them with ``confidence``."""

    def quantile(q: float) -> int:
        total, k = 0, -1
        while total < q * 2**n:
            k += 1
            total += comb(n, k)
        return k

    tail = (1 - confidence) / 2
    return min(quantile(tail) + 1, n), max(quantile(1 - tail), 1)
