"""Medians of every beginning of a series, and counts of later values on one side, in n log n."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence


def ranks(values: Sequence[float]) -> tuple[list[float], list[int]]:
    """Values in order, and where each one stands there (equal ones in the order they come)."""
    order = sorted(range(len(values)), key=values.__getitem__)
    place = [0] * len(values)
    for r, i in enumerate(order):
        place[i] = r
    return [values[i] for i in order], place


def beginning_medians(values: Sequence[float]) -> list[float]:
    """Median of values[:m] at m, for m from 1; at 0 stands NaN.

    All values are sorted once and linked; then the last one is taken out again
    and again, and the lower middle moves by one link at most.
    """
    v, place = ranks(values)
    n = len(v)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    out, p = [float("nan")] * (n + 1), (n - 1) // 2
    for m in range(n, 0, -1):
        out[m] = (v[p] + (v[p] if m % 2 else v[after[p]])) / 2
        r = place[m - 1]
        if m % 2:
            if r >= p:
                p = before[p]
        elif r <= p:
            p = after[p]
        left, right = before[r], after[r]
        if left >= 0:
            after[left] = right
        if right < n:
            before[right] = left
    return out


def nearer_after(values: Sequence[float], firsts: Sequence[float], seconds: Sequence[float], strict: bool) -> list[int]:
    """For each place i how many of values[i:] are nearer to seconds[i] than to firsts[i]; ties count unless strict.

    Going along the sorted values the answer changes once, between the two; a tree of counts over
    ranks (Fenwick's) tells how many later values lie beyond that. (Values so large that
    the difference of the two vanishes beside them are told by their side alone.)
    """
    v, place = ranks(values)
    n, tree = len(v), [0] * (len(v) + 1)
    out = [0] * n
    for i in range(n - 1, -1, -1):
        at = place[i] + 1
        while at <= n:
            tree[at] += 1
            at += at & -at
        a, b = firsts[i], seconds[i]
        if a == b:
            out[i] = 0 if strict else n - i
            continue
        rising = b > a
        near = (lambda x: abs(x - b) < abs(x - a)) if strict else (lambda x: abs(x - b) <= abs(x - a))
        at = bisect_left(v, True, key=near if rising else (lambda x: not near(x)))
        below = 0
        while at:
            below += tree[at]
            at -= at & -at
        out[i] = n - i - below if rising else below
    return out
