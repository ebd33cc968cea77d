"""Loops over one series, that the window and run expressions are held against."""

from __future__ import annotations

from statistics import median

import numpy as np


def rolling(values, window, f):
    n = len(values)
    return [f([values[j] for j in range(max(0, i - window // 2), min(n, i + (window - 1) - window // 2 + 1))]) for i in range(n)]


def robust_z(v, window):
    med = rolling(v, window, median)
    off = [abs(a - b) for a, b in zip(v, med, strict=True)]
    mad = rolling(off, window, median)
    return [1.4826 * (a - m) / d if d > 0 else 0.0 for a, m, d in zip(v, med, mad, strict=True)]


def warp(a, b):
    """Dynamic time warping by its table."""
    n, m = len(a), len(b)
    t = np.full((n + 1, m + 1), np.inf)
    t[0, 0] = 0
    for i in range(n):
        for j in range(m):
            t[i + 1, j + 1] = abs(a[i] - b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t[n, m]


def runs(flags):
    out = []
    for i, f in enumerate(flags):
        if f:
            if out and out[-1][1] == i - 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    return [tuple(x) for x in out]


def smooth(flags, min_len, gap, cooldown):
    """Row by row: a run that ends counts if it is long enough, joins the one before it over a short gap, and waits for the rest after a kept one."""
    joined, length = [], 0
    for i, flag in enumerate([*flags, False]):
        if flag:
            length += 1
            continue
        if length >= min_len:
            near = joined and i - length - joined[-1][1] <= gap + 1
            joined.append((joined.pop()[0] if near else i - length, i - 1))
        length = 0
    out, quiet = [], -1
    for s, e in joined:
        if e > quiet:
            out.append((max(s, quiet + 1), e))
            quiet = e + cooldown
    return out
