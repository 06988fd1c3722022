"""Peaks of coverage that valleys set apart from higher ones, bin by bin.

Looking one way along a stretch, a maximum needs the nearest one that outranks it and the
least height between, and the steps that are lower than all nearer ones.  Two stacks hold
that for all places further on: maxima of falling rank, and steps of rising height.  A bin
reduces to the stacks that its end leaves, and stacks of neighbouring bins merge, so no bin
has to see another's steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class View:
    """What can be seen from a place, nearest last.

    ``tops``: ``[height, width, start, low]`` of maxima that outrank all nearer ones; ``low`` is
    the least height between it and the next of them.  ``lows``: ``(height, edge, start)`` of
    steps lower than all nearer ones.  ``least`` is the least height since the last maximum,
    ``lead`` that before the first of ``tops``.
    """

    tops: list[list] = field(default_factory=list)
    lows: list[tuple] = field(default_factory=list)
    least: float = np.inf
    lead: float = np.inf


def look(view: View, height: np.ndarray, width: np.ndarray, start: np.ndarray, edge: np.ndarray, maxima: np.ndarray, ties_outrank: bool) -> dict[int, tuple]:
    """Walk over steps, keeping the view; for each maximum ``(start of the one that outranks it,
    least height between, lower steps up to it, nearest first)``, the first None without any.

    Higher outranks; of equal heights the wider does, and with ``ties_outrank`` also one
    of the same width.
    """
    found, empty = {}, not view.tops
    for i, (h, w, s, e, top) in enumerate(zip(height.tolist(), width.tolist(), start.tolist(), edge.tolist(), maxima.tolist(), strict=True)):
        if top:
            least = view.least
            while view.tops:
                other = (view.tops[-1][0], view.tops[-1][1])
                if other > (h, w) or (ties_outrank and other == (h, w)):
                    view.tops[-1][3] = least = min(view.tops[-1][3], least)
                    break
                least = min(least, view.tops.pop()[3])
            limit = view.tops[-1][2] if view.tops else None
            far = [low for low in reversed(view.lows) if low[0] < h]
            if limit is not None:
                ascending = s > limit
                far = [low for low in far if (low[2] > limit) == ascending and low[2] != limit]
            found[i] = (limit, least, far)
            if not view.tops:
                view.lead = min(view.lead, least)
            view.tops.append([h, w, s, np.inf])
            view.least = np.inf
        else:
            view.least = min(view.least, h)
        while view.lows and view.lows[-1][0] >= h:
            view.lows.pop()
        view.lows.append((h, e, s))
    if not view.tops:
        view.lead = min(view.lead, view.least)
    return found


def merged(far: View, near: View, ties_outrank: bool) -> View:
    """The view from beyond ``near``, whose steps come after those of ``far``."""
    out = View([list(t) for t in far.tops], list(far.lows), far.least, far.lead)
    if near.tops:
        rank, least = (near.tops[0][0], near.tops[0][1]), min(far.least, near.lead)
        while out.tops:
            other = (out.tops[-1][0], out.tops[-1][1])
            if other > rank or (ties_outrank and other == rank):
                out.tops[-1][3] = min(out.tops[-1][3], least)
                break
            least = min(least, out.tops.pop()[3])
        if not out.tops:
            out.lead = min(out.lead, least)
        out.tops += [list(t) for t in near.tops]
        out.least = near.least
    else:
        out.least = min(far.least, near.least)
        out.lead = min(far.lead, near.least) if not far.tops else far.lead
    if near.lows:
        while out.lows and out.lows[-1][0] >= near.lows[0][0]:
            out.lows.pop()
        out.lows += near.lows
    return out
