"""Suffix sorting by linear grouping (no recursion, no renaming).

Phase one sorts the suffixes into groups by Lyndon prefix.  Groups are taken
from the greatest down; each suffix points to the nearest suffix before it that
lies in a smaller group (its previous smaller one), and the suffixes pointed to
are moved, by how often they are met and by their group, into new groups right
above their old ones.  Phase two emits each group's order: the sorted suffixes,
read from the least, place the chains of previous-smaller pointers before them
at the fronts of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (integers of any kind); a shorter one comes before those it begins."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    by_symbol = np.argsort(symbols, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(symbols[by_symbol]) != 0]))
    bounds = [*starts.tolist(), n]
    order = by_symbol.tolist()
    members = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for g, m in enumerate(members):
        for s in m:
            group[s] = g
    smaller = [-1] * n
    known = bytearray(n)

    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = members[g] = [s for s in own if group[s] == g]
        met: list[int] = []
        times: list[int] = []
        last = -1
        for s in own:  # ascending, so the pointers ascend too and equal ones are neighbours
            p = s - 1
            while p >= 0 and known[p]:
                p = smaller[p]
            smaller[s] = p
            known[s] = 1
            if p >= 0:
                if p == last:
                    times[-1] += 1
                else:
                    met.append(p)
                    times.append(1)
                    last = p
        if met:
            if len(met) == 1 or max(times) == 1:
                layers = [met]
            else:
                by_times: dict[int, list[int]] = {}
                for p, t in zip(met, times, strict=True):
                    by_times.setdefault(t, []).append(p)
                layers = [by_times[t] for t in sorted(by_times, reverse=True)]
            for layer in layers:
                parts: dict[int, list[int]] = {}
                for p in layer:
                    parts.setdefault(group[p], []).append(p)
                for old, part in parts.items():
                    if len(part) == size[old]:
                        continue
                    new = len(members)
                    members.append(part)
                    size.append(len(part))
                    size[old] -= len(part)
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    below[up] = new
                    for p in part:
                        group[p] = new
        g = below[g]

    g, front, at = 0, [0] * len(members), 1
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        front[g] = at
        at += size[g]
        g = above[g]
    result = [-1] * (n + 1)
    result[0] = n  # the empty suffix
    placed = bytearray(n)
    for i in range(n + 1):
        s = result[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            result[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = smaller[s]
    return np.array(result[1:], np.int64)
