"""Simple-8b word-aligned coding of unsigned integers, vectorised over independent blocks.

A 64-bit word is a 4-bit selector and a 60-bit payload. Selectors 1 to 14 say how many values of which width the payload
holds, low bits first; selector 0 is an escape, whose payload is the place of a value of over 60 bits in a side list.
Defined results: no values give no words; any unsigned 64-bit value is coded, those of over 60 bits as escapes; nulls have no code.
Every block of ``BLOCK`` values starts a new word and its first word's place is kept, so blocks decode independently.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the format: values in a word, and bits of each, by selector.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped values)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK + 64, np.uint64)
    padded[:n] = values
    grid = padded[: blocks * BLOCK].reshape(blocks, BLOCK)
    big = grid >= np.uint64(1 << 60)
    # bits of each value: from its high half, where there is one (both halves are exact as floats)
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.int8)
    wide_ones = grid >= np.uint64(1 << 32)
    if wide_ones.any():
        bits[wide_ones] = np.frexp((grid[wide_ones] >> np.uint64(32)).astype(np.float64))[1] + 32
    place = np.arange(BLOCK, dtype=np.int16)
    left = (BLOCK - place)[None, :]
    choice = np.zeros((blocks, BLOCK), np.int8)
    open_ = ~big
    for s in range(1, len(COUNT)):
        # only blocks with a run of narrow values, of half a word at least or up to the block's end, can use this selector
        narrow = bits <= WIDTH[s]
        run, k = narrow, 1
        while 2 * k <= COUNT[s]:
            run, k = run[:, :-k] & run[:, k:], 2 * k
        some = np.flatnonzero(run.any(axis=1) | narrow[:, -1])
        if not len(some):
            continue
        # distance to the next value that is too wide; past the block's end nothing is
        wide = np.where(narrow[some], np.int16(BLOCK), place[None, :])
        free = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1] - place[None, :]
        fits = open_[some] & (free >= np.minimum(left, COUNT[s]))
        choice[some] = np.where(fits, np.int8(s), choice[some])
        open_[some] &= ~fits
        if not open_.any():
            break
    at, steps, row = np.zeros(blocks, np.int64), [], np.arange(blocks)
    while True:
        live = at < BLOCK
        if not live.any():
            break
        s = choice[row, np.minimum(at, BLOCK - 1)]
        steps.append((np.where(live, s, -1), at.copy()))
        at += COUNT[s] * live
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    sel = np.array([x for x, _ in steps]).T
    begin = np.array([x for _, x in steps]).T + row[:, None] * BLOCK
    used = sel >= 0
    # words that begin past the last value are padding
    used &= begin < n
    per_block = used.sum(axis=1)
    sel, begin = sel[used], begin[used]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNT)):
        mine = np.flatnonzero(sel == s)
        at, filled = begin[mine], np.zeros(len(mine), np.uint64)
        room = BLOCK - at % BLOCK
        short = bool(len(mine)) and room.min() < COUNT[s]
        for k in range(COUNT[s] if len(mine) else 0):
            value = padded[at + k]
            if short:  # the next block's values are not this word's
                value[room <= k] = 0
            filled |= value << np.uint64(k * WIDTH[s])
        words[mine] |= filled
    escaped = np.flatnonzero(sel == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, (np.cumsum(per_block) - per_block).astype(np.uint32), padded[begin[escaped]]


def decode(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values, as uint64."""
    out = np.zeros(-(-n // BLOCK) * BLOCK + 64, np.uint64)
    if not len(words):
        return out[:n]
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[sel]
    block = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts.astype(np.int64), len(words))))
    total = np.cumsum(count) - count
    begin = total - total[firsts.astype(np.int64)][block] + block * BLOCK
    for s in range(len(COUNT)):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        if s == 0:
            out[begin[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        for k in range(COUNT[s]):
            to = begin[mine] + k
            inside = to < (block[mine] + 1) * BLOCK
            out[to[inside]] = (words[mine[inside]] >> np.uint64(k * WIDTH[s])) & mask
    return out[:n]
