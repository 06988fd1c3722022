"""Peaks of one whole coverage block, to test the work by bins against."""

from __future__ import annotations

import numpy as np


def _extrema(height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps that are local maxima, and minima; a plateau counts at its last step."""
    n = len(height)
    down = np.append(height[:-1] > height[1:], True)  # the next step is lower, or there is none
    up = np.append(height[:-1] < height[1:], False)
    from_below = np.concatenate([[True], height[1:] >= height[:-1]])
    from_above = np.concatenate([[True], height[1:] <= height[:-1]])
    maxima, minima = down & from_below, up & from_above
    minima[n - 1] = not maxima[n - 1]
    return maxima, minima


def _nearest_above(height, width, tops, backwards: bool) -> dict[int, int]:
    """For each maximum the nearest one before (or after) it that outranks it.

    Higher outranks; of equal heights the wider does, and looking forward also one of the
    same width.  A stack of candidates in falling rank makes it linear.
    """
    found, stack = {}, []
    for t in tops if backwards else tops[::-1]:
        rank = (height[t], width[t])
        while stack:
            top = (height[stack[-1]], width[stack[-1]])
            if top > rank or (not backwards and top == rank):
                found[t] = stack[-1]
                break
            stack.pop()
        stack.append(t)
    return found


def block_peaks(start: np.ndarray, end: np.ndarray, height: np.ndarray, depth: float = 0.9) -> list[dict]:
    """Peaks of one contiguous block of coverage steps, half-open coordinates.

    A maximum is a peak if, on each side, a minimum of at most ``1 - depth`` of its height
    lies before the nearest maximum that outranks it, or no such maximum exists.  Its
    bounds are the lowest steps towards its neighbours, its half-height extent the first
    steps at or below half.
    """
    n = len(height)
    if n == 1:
        bounds = dict(left=int(start[0]), right=int(end[0]), half_left=int(start[0]), half_right=int(end[0]))
        return [dict(start=int(start[0]), end=int(end[0]), height=float(height[0]), **bounds)]
    maxima, minima = _extrema(height)
    tops = np.flatnonzero(maxima).tolist()
    width = end - start
    before, after = _nearest_above(height, width, tops, True), _nearest_above(height, width, tops, False)
    floor = 1 - depth
    low = np.where(minima, height, np.inf)

    def valley(t: int, lo: int, hi: int) -> bool:
        return hi > lo and low[lo:hi].min() / height[t] <= floor

    chosen = [t for t in tops if (t not in before or valley(t, before[t] + 1, t)) and (t not in after or valley(t, t + 1, after[t]))]
    out = []
    for nth, t in enumerate(chosen):
        left = max(before[t] + 1 if t in before else 0, chosen[nth - 1] + 1 if nth else 0)
        right = min(after[t] - 1 if t in after else n - 1, chosen[nth + 1] - 1 if nth + 1 < len(chosen) else n - 1)
        sides = {}
        for side, steps in (("left", range(t - 1, left - 1, -1)), ("right", range(t + 1, right + 1))):
            lowest, half = t, None
            for s in steps:
                if half is None and height[s] / height[t] <= 0.5:
                    half = s
                if height[s] < height[lowest]:
                    lowest = s
            sides[side] = (lowest, lowest if half is None else half)
        edge = lambda s, t=t: int(end[s]) if s < t else int(start[s])  # noqa: E731  the far side of a step before the peak
        other = lambda s, t=t: int(start[s]) if s > t else int(end[s])
        out.append(
            dict(
                start=int(start[t]), end=int(end[t]), height=float(height[t]),
                left=edge(sides["left"][0]), right=other(sides["right"][0]), half_left=edge(sides["left"][1]), half_right=other(sides["right"][1]),
            )
        )
    return out
