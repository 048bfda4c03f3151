"""Suffix arrays by linear grouping: groups of suffixes by Lyndon prefix, in descending order, and one emitting pass.

Phase one starts with groups by first symbol and takes groups from the highest down. For each suffix of the group it finds
the pointer to the previous suffix of a smaller group. A suffix that l suffixes of the group point to has the group's
prefix appended l times, so those with the same l and the same group leave it together and become the group right above
what stays, larger l higher. Phase two emits: from left to right over the array, each entry's preceding suffix, and then
along its pointers, takes the next free place of its group. Nothing is renamed or sorted recursively. (The construction
published by U. Baier, 2016.)
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int] | np.ndarray) -> list[int]:
    """Start positions of the suffixes in ascending order. The last symbol must be the only smallest one."""
    s = np.asarray(symbols, np.int64)
    n = len(s)
    if n == 0:
        return []
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.flatnonzero(head)
    of = np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    sa = order.tolist()
    place, group = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order] = np.arange(n)
    group[order] = of
    place, group = place.tolist(), group.tolist()
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.concatenate([starts, [n]]))
    size = size.tolist()
    prev = [-1] * n  # previous suffix of a smaller group, fixed when a suffix's group is taken
    jump = list(range(-1, n - 1))  # where a search goes on from a suffix that isn't smaller: never back to the right
    top = n
    while top:
        g = group[sa[top - 1]]
        points: dict[int, int] = {}
        for i in sa[g:top] if top - g == 1 else sorted(sa[g:top]):
            j, seen = jump[i], None
            while j >= 0 and group[j] >= g:
                if seen is None:
                    seen = [j]
                else:
                    seen.append(j)
                j = jump[j]
            prev[i] = jump[i] = j
            if seen is not None:
                for k in seen:
                    jump[k] = j
            if j >= 0:
                points[j] = points.get(j, 0) + 1
        if points:
            if len(points) == 1:
                moves = [(group[next(iter(points))], list(points))]
            else:
                by: dict[tuple[int, int], list[int]] = {}
                for j, times in points.items():
                    by.setdefault((times, group[j]), []).append(j)
                moves = [(by_g, js) for (_, by_g), js in sorted(by.items(), key=lambda x: -x[0][0])]
            for old, js in moves:
                left = size[old] - len(js)
                if not left:
                    continue  # the whole group moves: it stays where it is
                size[old] = left
                new = at = old + left
                size[new] = len(js)
                moving = set(js) if len(js) > 1 else js
                free = [k for k in range(new, new + len(js)) if sa[k] not in moving] if len(js) > 1 else ([at] if sa[at] != js[0] else [])
                f = 0
                for j in js:
                    if place[j] < new:  # changes places with one that stays
                        k = free[f]
                        f += 1
                        other, was = sa[k], place[j]
                        sa[was], sa[k] = other, j
                        place[other], place[j] = was, k
                    group[j] = new
        top = g
    out = [-1] * n
    done = [False] * n
    nxt = list(range(n))  # next free place of the group that starts here
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            k = nxt[g]
            nxt[g] = k + 1
            out[k] = j
            done[j] = True
            j = prev[j]
    return out


def lcp_array(symbols: list[int], sa: list[int]) -> list[int]:
    """Symbols that each suffix shares with the one before it in the array."""
    n = len(sa)
    s = list(symbols)
    rank = [0] * n
    for k, i in enumerate(sa):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            m = n - max(i, j)
            while h < m and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out
