"""Suffix arrays by Lyndon-prefix grouping, linear in the text, without recursive renaming.

First the suffixes are put into groups by their first symbol, and the groups are taken in descending
order. For each suffix of a group the last suffix before it that lies in a smaller group is found
along previous-smaller pointers; suffixes that such pointers name are followed by this group's
prefix, once or several times, so they move to new groups right above their own. What results is one
group for each longest Lyndon prefix, in order. Then the order inside the groups is emitted: along
the array, the suffix before each entry and those on its chain of pointers, as far as they are not
yet placed, take the next places of their groups.
"""

from __future__ import annotations

import numpy as np


def _groups(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """(start of each suffix's group, previous-smaller pointers)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(first, n))
    of, at, count = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    of[order], at[order], count[first] = np.repeat(first, sizes), np.arange(n), sizes
    group, place, size, array = of.tolist(), at.tolist(), count.tolist(), order.tolist()
    previous = [-1] * n
    end = n
    while end:
        start = group[array[end - 1]]
        if end - start == 1:
            i = array[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                own = group[j]
                left = size[own]
                if left > 1:
                    last = own + left - 1
                    other, here = array[last], place[j]
                    array[last], array[here] = j, other
                    place[j], place[other] = last, here
                    size[own], size[last] = left - 1, 1
                    group[j] = last
        else:
            named: dict[int, int] = {}
            for i in sorted(array[start:end]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    named[j] = named.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in named.items():
                moves.setdefault((times, group[j]), []).append(j)
            for key in sorted(moves, reverse=True):
                own, leaving = key[1], moves[key]
                left = size[own]
                if len(leaving) == left:
                    continue
                last = own + left
                for j in leaving:
                    last -= 1
                    other, here = array[last], place[j]
                    array[last], array[here] = j, other
                    place[j], place[other] = last, here
                size[own], size[last] = left - len(leaving), len(leaving)
                for j in leaving:
                    group[j] = last
        end = start
    return group, previous


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in ascending order, for integer symbols; a prefix comes before what extends it."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    _, ranks = np.unique(symbols, return_inverse=True)
    group, previous = _groups(np.append(ranks + 1, 0))  # an end symbol below all others
    array, free, done = [-1] * (n + 1), list(range(n + 1)), bytearray(n + 1)
    array[0], done[n] = n, 1
    for i in range(n + 1):
        s = array[i] - 1
        while s >= 0 and not done[s]:
            own = group[s]
            array[free[own]] = s
            free[own] += 1
            done[s] = 1
            s = previous[s]
    return np.array(array[1:], np.int64)
