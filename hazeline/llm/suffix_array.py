"""Suffix arrays by linear grouping construction.

First phase: suffixes are grouped by their Lyndon prefixes. Groups start out
by first symbol and are taken in descending order; each member's pointer to the
previous suffix of a lower group is found by following known pointers, and the
suffixes pointed at move to new, higher groups by how often they are met.
Second phase: from the smallest suffix on, each group's order is emitted along
the pointers. Nothing is renamed and solved again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers >= 1 in lexicographic order (a shorter one first)."""
    n = len(symbols) + 1  # with a smallest sign at the end
    text = np.append(np.asarray(symbols, np.int64), 0)
    if n == 1:
        return np.zeros(0, np.int64)
    by_sign = np.argsort(text, kind="stable")
    sizes = np.unique(text, return_counts=True)[1]
    firsts = np.cumsum(sizes) - sizes
    group_of = np.empty(n, np.int64)
    group_of[by_sign] = np.repeat(firsts, sizes)
    member, group = by_sign.tolist(), group_of.tolist()  # members lie by group; a group is named by its first place
    place_of = np.empty(n, np.int64)
    place_of[by_sign] = np.arange(n)
    place = place_of.tolist()
    size = [0] * n
    for f, s in zip(firsts.tolist(), sizes.tolist(), strict=True):
        size[f] = s
    lower = [-1] * n

    end = n
    while end > 0:
        start = group[member[end - 1]]
        if end - start == 1:
            i = member[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = lower[p]
            lower[i] = p
            if p >= 0:
                g = group[p]
                s = size[g]
                if s > 1:  # p alone goes to a new group behind its own
                    last = g + s - 1
                    at, other = place[p], member[last]
                    member[at], member[last] = other, p
                    place[other], place[p] = at, last
                    size[g] = s - 1
                    size[last] = 1
                    group[p] = last
        else:
            met: dict[int, int] = {}
            for i in sorted(member[start:end]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = lower[p]
                lower[i] = p
                if p >= 0:
                    met[p] = met.get(p, 0) + 1
            by_times: dict[int, list[int]] = {}
            for p, times in met.items():
                by_times.setdefault(times, []).append(p)
            for times in sorted(by_times, reverse=True):
                by_group: dict[int, list[int]] = {}
                for p in by_times[times]:
                    by_group.setdefault(group[p], []).append(p)
                for g, moved in by_group.items():
                    s = size[g]
                    if len(moved) == s:
                        continue
                    last = g + s
                    for p in moved:
                        last -= 1
                        at, other = place[p], member[last]
                        member[at], member[last] = other, p
                        place[other], place[p] = at, last
                    size[g] = last - g
                    size[last] = len(moved)
                    for p in moved:
                        group[p] = last
        end = start

    order = [-1] * n
    free = list(range(n))  # next place of each group
    done = bytearray(n)
    order[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            k = free[g]
            order[k] = j
            free[g] = k + 1
            done[j] = 1
            j = lower[j]
    return np.array(order[1:], np.int64)
