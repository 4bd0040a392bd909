"""Recursions that clamp their own state, as prefix scans.

A step x -> min(max(a x + b, lo), hi) with a >= 0 is closed under composition: two steps in a row are one step of the same form. A series is
cut into about sqrt(n) blocks; the steps inside all blocks are composed side by side, one fold over the composed blocks gives the state at
every block's start, and the composed steps then give every state at once. Nothing walks row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def clamped_scan(a, b: np.ndarray, lo, hi, start: float) -> np.ndarray:
    """x[i] = min(max(a[i] * x[i - 1] + b[i], lo[i]), hi[i]) with x[-1] = ``start``; a, lo and hi may be single numbers.

    a must not be negative, lo not above hi; where bounds are infinite a must be positive. An empty series gives an empty result.
    """
    n = len(b)
    if n == 0:
        return np.empty(0)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)

    def grid(x, rest: float) -> np.ndarray:
        out = np.full(blocks * size, rest)  # what is added at the end changes nothing
        out[:n] = x
        return out.reshape(blocks, size)

    a, b, lo, hi = grid(a, 1.0), grid(b, 0.0), grid(lo, -np.inf), grid(hi, np.inf)
    for j in range(1, size):
        step, low, high = a[:, j], lo[:, j].copy(), hi[:, j].copy()
        lo[:, j] = np.minimum(np.maximum(step * lo[:, j - 1] + b[:, j], low), high)
        hi[:, j] = np.minimum(np.maximum(step * hi[:, j - 1] + b[:, j], low), high)
        b[:, j] = step * b[:, j - 1] + b[:, j]
        a[:, j] = step * a[:, j - 1]
    first = np.empty(blocks)
    x = float(start)
    for k, (s, t, low, high) in enumerate(zip(a[:, -1], b[:, -1], lo[:, -1], hi[:, -1])):
        first[k] = x
        x = min(max(s * x + t, low), high)
    return np.minimum(np.maximum(a * first[:, None] + b, lo), hi).ravel()[:n]


def between_resets(n: int, scan: Callable[[int, int], tuple[np.ndarray, Callable[[int], None]]], least: int = 64) -> None:
    """Drive a scan whose state jumps at some rows.

    ``scan(at, to)`` handles rows at..to-1 from the current state and returns where the state jumps and a function that accepts the rows
    up to and including a given offset. Stretches double while nothing jumps, so the work stays near the number of rows.
    """
    at, size = 0, least
    while at < n:
        to = min(n, at + size)
        jumps, accept = scan(at, to)
        k = int(np.argmax(jumps)) if jumps.any() else to - at - 1
        accept(k)
        size = least if jumps.any() else size * 2
        at += k + 1
