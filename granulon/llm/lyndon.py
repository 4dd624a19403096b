"""Suffix arrays of many texts at once, by linear grouping over Lyndon prefixes.

Suffixes start in groups by their first symbol. Groups are taken in descending order: for each suffix of the group, the pointer to the nearest earlier suffix
of a smaller group is found along the pointers that are known already, and the suffixes pointed at move to new groups just above their own, ordered by
how many of the group point at them. In the end a group holds the suffixes with one longest Lyndon prefix, and groups are in order. Then suffixes are emitted in ascending order:
each one emitted settles those that it is the next smaller suffix of, along the same pointers, at the next free place of their groups. Nothing is renamed or sorted again.

The texts are independent, so each step takes one group of every text (first phase) or one suffix of every text (second phase) with array operations:
the number of steps is that of the longest text, which callers keep short.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts that lie one after another in ``symbols``, text t from ``base[t]`` on: global positions, each text's in its own range.

    Each text must end with its least symbol, which it has nowhere else.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.append(base[1:], n)
    text = np.repeat(np.arange(len(base)), ends - base)
    order, group, before = _grouped(symbols.astype(np.int64), text, base, ends)
    return _emitted(order, group, before, base, ends)


def _grouped(symbols: np.ndarray, text: np.ndarray, base: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phase one: positions by group (``order``), the first place of each position's group, and the pointers."""
    n = len(symbols)
    key = text * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    group, place, last = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    place[order] = np.arange(n)
    last[starts] = np.append(starts[1:], n) - 1
    before, is_first, moving = np.full(n, -1), np.zeros(n, bool), np.zeros(n, bool)
    is_first[base] = True
    cursor = ends - 1
    floor = base
    while len(cursor):
        start = group[order[cursor]]
        size = cursor - start + 1
        own = order[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        # pointers jump back over what is not smaller
        before[own] = np.where(is_first[own], -1, own - 1)
        todo = own
        while len(todo):
            p = before[todo]
            todo, p = todo[p >= 0], p[p >= 0]
            on = group[p] >= group[todo]
            todo = todo[on]
            before[todo] = before[p[on]]
        to = before[own]
        _move(np.sort(to[to >= 0]), order, group, place, last, moving)
        cursor = start - 1
        left = cursor >= floor
        cursor, floor = cursor[left], floor[left]
    return order, group, before


def _move(to: np.ndarray, order: np.ndarray, group: np.ndarray, place: np.ndarray, last: np.ndarray, moving: np.ndarray) -> None:
    """Positions that are pointed at (sorted, once for each pointer) go to new groups at the upper end of their own, by the number of pointers."""
    if not len(to):
        return
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    to, count = to[first], np.diff(np.append(first, len(to)))
    by = np.lexsort((count, group[to]))
    to, count, old = to[by], count[by], group[to][by]
    run = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
    many = np.diff(np.append(run, len(old)))
    end = last[old[run]]
    at = np.repeat(end - many + 1, many) + np.arange(len(old)) - np.repeat(run, many)
    # whoever holds those places and stays changes with those that come from below
    moving[to] = True
    held = order[at]
    held = held[~moving[held]]
    moving[to] = False
    below = place[to]
    below = below[below < np.repeat(end - many + 1, many)]
    order[below], place[held] = held, below
    order[at], place[to] = to, at
    last[old[run]] = end - many
    new = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (count[1:] != count[:-1])))
    size = np.diff(np.append(new, len(old)))
    group[to] = np.repeat(at[new], size)
    last[at[new]] = at[new] + size - 1


def _emitted(order: np.ndarray, group: np.ndarray, before: np.ndarray, base: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Phase two: the suffixes of every text in ascending order."""
    n = len(order)
    out, done = np.full(n, -1), np.zeros(n + 1, bool)
    free = np.arange(n)  # the next free place of the group that starts at a place
    out[base] = order[base]  # the end symbol is the least suffix
    done[order[base]] = True
    done[n] = True  # what -1 points at
    long = np.argsort(base - ends, kind="stable")
    at, stop = base[long], ends[long]
    first = np.zeros(n + 1, bool)
    first[base] = True
    while len(at):
        q = out[at]
        s = np.where(first[q], -1, q - 1)
        s = s[~done[s]]
        while len(s):
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = before[s]
            s = s[~done[s]]
        at = at + 1
        left = int((at < stop).sum())  # the longest texts come first
        at, stop = at[:left], stop[:left]
    return out
