"""Repeated byte strings across documents, by suffix arrays of the passages that can match.

Every string of ``LENGTH`` bytes (a window) has an anchor: the ``GRAM`` bytes in it with the least hash, the leftmost of equals. Consecutive windows with
one anchor make a segment, and equal windows lie at the same place about equal anchors. So the work goes in three shuffles. First the anchors' hashes are dealt out, to find those that two
documents have; their places go back to the documents. There the segments about them are cut out and dealt by anchor. In a task, the segments of each anchor make one text, whose suffix array
(``lyndon``: linear grouping, all anchors of the task at once) brings equal windows together; neighbours are compared byte by byte, and a window
of which a smaller doc_id has an equal is late. Late windows go back as spans, which merge to maximal runs by document. Hashes only deal out the work; no hash decides.

Scale: an anchor is sent for about 14 bytes of text, and a slice of documents sends an anchor that several of its documents have for its least and greatest doc_id only, and equal segments
for their smallest doc_id only (the others of the slice are late where it is not). An anchor with one distinct segment needs no sorting: its windows differ. One with over ``MOST`` is cut into halves by the place
of the anchor in the window, which have more bytes in common, and dealt again by those, so texts stay short. A block of over ``BLOCK_LIMIT`` bytes
is not held: its segments pass on as single windows, dealt by all their bytes, to a second round.

Defined results: a null text is an empty one; a null doc_id is neither a reference nor searched, its text stays whole; rows that share a doc_id are each searched by themselves, none against
another, and equal rows get equal results; columns of any name survive in ``remove``. What is left of a text may not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.llm import substring_dedup as lz
from granulon.llm.common import materialise, sized
from granulon.llm.lyndon import suffix_arrays

LENGTH, GRAM, MOST = 50, 24, 64
BLOCK_BYTES, SLICE_BYTES, BLOCK_LIMIT = 4 << 20, 4 << 20, 64 << 20
#: Texts are sorted in batches of about so many bytes.
SORT_BYTES = 1 << 20
_BASE = 0x2545F4914F6CDD1D
_ZSTD = pa.Codec("zstd", compression_level=1)  # segments overlap, so they compress well before they are shuffled
_PARTS = ("values", "shifts", "counts", "text", "docs", "copies", "places")
SEGMENTS = "block int, again boolean, size int, " + ", ".join(f"{c} binary" for c in _PARTS)
_SEGMENTS = pa.schema([("block", pa.int32()), ("again", pa.bool_()), ("size", pa.int32()), *((c, pa.binary()) for c in _PARTS)])
SPANS = "doc_id long, copy long, spans array<struct<start:int,n:int>>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _minima(data: np.ndarray) -> np.ndarray:
    """For each window the least hash of its grams, with the gram's distance in the low five bits: by doubling, so the leftmost of equals wins."""
    power, size = {1: _BYTES[data]}, 1
    while 2 * size <= GRAM:
        x = power[size] if size & GRAM else power.pop(size)
        power[2 * size] = x[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + x[size:]
        size *= 2
    h, done = None, 0
    for size in sorted(power, reverse=True):
        n, x = len(data) - done - size + 1, power.pop(size)
        h = x if h is None else h[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + x[done : done + n]
        done += size
    m, size, wide = _mixed(h) & ~np.uint64(31), 1, LENGTH - GRAM + 1
    while size < wide:
        step = min(size, wide - size)
        m = np.minimum(m[:-step], m[step:] + np.uint64(step))
        size += step
    return m


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents that lie one after another (document i up to ``ends[i + 1]``): each segment's anchor hash, document, first window, distance from there to the anchor, and windows."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
    own = np.maximum(np.diff(ends) - LENGTH + 1, 0)
    at = np.arange(own.sum()) + np.repeat(ends[:-1] - np.cumsum(own) + own, own)
    least = _minima(data)[at]
    anchor = at + (least & np.uint64(31)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(at) else np.zeros(0, np.int64)
    unit = np.repeat(np.arange(len(own)), own)[first]
    return least[first] >> np.uint64(5), unit, at[first], anchor[first] - at[first], np.diff(np.append(first, len(at)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _binaries(data: np.ndarray, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> pa.Array:
    """The bytes of each range after a byte ``mark``."""
    ends = np.append(0, np.cumsum(size + 1))
    out = np.empty(ends[-1], np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends[:-1]] = False
    out[ends[:-1]], out[inside] = mark, data[_ranges(start, size)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out)])


def _slices(batches, columns: int, size: int):
    """Units of at most about ``size`` bytes from rows (doc, copy, text, ...): doc, copy, bytes, ends and the rows, in order of (doc, copy), equal ones once."""
    for batch in batches:
        doc, copy, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        bytes_to = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < len(doc):
            last = max(first + 1, int(np.searchsorted(bytes_to, (bytes_to[first - 1] if first else 0) + size)))
            order = np.lexsort((copy[first:last], doc[first:last]))
            order = first + order[lz._first(doc[first:last][order], copy[first:last][order])]
            mine = texts.take(pa.array(order))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine.cast(pa.binary())), b"")
            ends = np.append(0, np.cumsum(pc.binary_length(mine).to_numpy())).astype(np.int64)
            yield doc[order], copy[order], np.frombuffer(joined[0].as_py(), np.uint8), ends, batch.take(pa.array(order)) if columns > 3 else None
            first = last


def anchors(rows: DataFrame, blocks: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Packed rows by document: the numbers of the segments whose anchor's hash two documents have."""

    def ask(batches):
        for doc, copy, data, ends, _ in _slices(batches, 3, slice_bytes):
            value, unit, _, _, _ = segments(data, ends)
            number = np.arange(len(unit)) - np.searchsorted(unit, unit)
            own, own_copy = doc[unit], copy[unit]
            by = np.lexsort((own, value))
            new = lz._first(value[by])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(by))[np.cumsum(new) - 1] - 1 if len(by) else first
            lead = first[np.cumsum(new) - 1] if len(by) else first
            several = own[by[lead]] != own[by[last]]
            at = np.arange(len(by))
            send = np.sort(by[~several | (at == lead) | (at == last)])
            known = np.sort(by[several])
            out = lz._split((value[send] % np.uint64(blocks)).astype(np.int64), value[send], own[send], own_copy[send], number[send])
            out += lz._split(lz._of_document(own[known], own_copy[known], blocks), value[:0], own[known], own_copy[known], number[known], base=blocks)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=lz._SCHEMA)

    def answer(group: pa.Table) -> pa.Table:
        if group["block"][0].as_py() >= blocks:  # known ones pass
            return group.set_column(0, "block", pc.cast(pc.subtract(group["block"], blocks), pa.int32()))
        value, doc, copy, number = lz._unpack(group)[:4]
        by = np.lexsort((doc, value))
        value, doc, copy, number = value[by], doc[by], copy[by], number[by]
        first = np.flatnonzero(lz._first(value))
        size = np.diff(np.append(first, len(value)))
        several = np.repeat(doc[first] != doc[first + size - 1], size) if len(first) else np.zeros(0, bool)
        columns = lz._in_order(doc[several], copy[several], number[several])
        return pa.Table.from_pylist(lz._split(lz._of_document(*columns[:2], blocks), value[:0], *columns), schema=lz._SCHEMA)

    def gather(group: pa.Table) -> pa.Table:
        doc, copy, number = lz._in_order(*lz._unpack(group)[1:4])
        first = np.flatnonzero(lz._first(doc, copy))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(number.astype(np.int32)))
        return pa.table({"doc_id": pa.array(doc[first]), "copy": pa.array(copy[first]), "numbers": lists})

    found = rows.mapInArrow(ask, lz.ROWS).groupBy("block").applyInArrow(answer, lz.ROWS)
    return found.groupBy("block").applyInArrow(gather, "doc_id long, copy long, numbers array<int>")


def _deal(block: np.ndarray, again: bool, value, shift, count, data, start, doc, copy, place) -> list[dict]:
    """Rows of segments by block."""
    by = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(lz._first(block[by]))
    out = []
    for one in np.split(by, cuts[1:]) if len(by) else []:
        size = count[one] + LENGTH - 1
        row = {"block": int(block[one[0]]), "again": again, "values": value[one].tobytes(), "shifts": shift[one].astype(np.uint8).tobytes(), "counts": count[one].astype(np.uint8).tobytes(), "text": _ZSTD.compress(data[_ranges(start[one], size)].tobytes(), asbytes=True), "size": int(size.sum())}
        out.append(row | {"docs": lz._planes(np.diff(doc[one], prepend=0)), "copies": lz._planes(copy[one]) if copy[one].any() else b"", "places": lz._planes(place[one].astype(np.int32))})
    return out


def _taken(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """value, shift, count, text, start there, doc, copy and place of the segments of some rows."""
    kinds = ((np.uint64, "values"), (np.uint8, "shifts"), (np.uint8, "counts"))
    value, shift, count = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for k, c in kinds)
    text = np.concatenate([np.frombuffer(_ZSTD.decompress(r["text"], r["size"]), np.uint8) for r in rows])
    doc = np.concatenate([np.cumsum(lz._whole(r["docs"], np.int64)) for r in rows])
    copy = np.concatenate([lz._whole(r["copies"], np.int64) if r["copies"] else np.zeros(len(r["counts"]), np.int64) for r in rows])
    place = np.concatenate([lz._whole(r["places"], np.int32) for r in rows]).astype(np.int64)
    count = count.astype(np.int64)
    start = np.cumsum(count + LENGTH - 1) - count - LENGTH + 1
    return value, shift.astype(np.int64), count, text, start, doc, copy, place


def _spans_out(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, size: np.ndarray, blocks: int, base: int = 0) -> list[dict]:
    """Spans as packed rows by document."""
    by = np.lexsort((start, copy, doc))
    doc, copy, start, size = doc[by], copy[by], start[by], size[by]
    none = np.zeros(len(doc), np.int64)
    return lz._split(lz._of_document(doc, copy, blocks), np.zeros(0, np.uint64), doc, copy, start, size, none, none, base=base)


class _Hash:
    """Hashes of ranges of a text, each by two look-ups."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, _BASE, np.uint64)))
        self.inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(_BYTES[data] * self.power[:-1]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def _cut(data: np.ndarray, start: np.ndarray, shift: np.ndarray, count: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Segments of groups (by ``key``) cut until no group has over ``most`` distinct pieces: piece's segment, first and last window in it, and group.

    The windows of a group have their anchor at distances u to v, so they share the bytes from u before it on; each half of the distances shares more. At one distance all is shared.
    """
    ranged, mix = _Hash(data), np.uint64(0x9E3779B97F4A7C15)
    piece, low, high = np.arange(len(start)), np.zeros(len(start), np.int64), count - 1
    u, v = np.zeros(len(start), np.int64), np.full(len(start), LENGTH - GRAM)
    done: list[tuple] = []
    while len(piece):
        whole = ranged.of(start[piece] + low, start[piece] + high + LENGTH) + (shift[piece] - low).astype(np.uint64)
        by = np.lexsort((whole, key))
        group = np.cumsum(lz._first(key[by])) - 1
        large = np.empty(len(piece), bool)
        large[by] = np.bincount(group, weights=lz._first(key[by], whole[by]))[group] > most
        large &= u < v
        done.append((piece[~large], low[~large], high[~large], key[~large]))
        piece, low, high, key, u, v = (x[large] for x in (piece, low, high, key, u, v))
        middle, a, parts = (u + v) // 2, shift[piece], []
        for one, two in ((u, middle), (middle + 1, v)):
            lo, hi = np.maximum(low, a - two), np.minimum(high, a - one)
            ok = lo <= hi
            shared = ranged.of((start[piece] + a - one)[ok], (start[piece] + a + LENGTH - two)[ok])
            parts.append((piece[ok], lo[ok], hi[ok], _mixed(key[ok] * mix + shared + one[ok].astype(np.uint64)), one[ok], two[ok]))
        piece, low, high, key, u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (piece, low, high, key)


def _distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each range's distinct bytes (with ``mark``), and one range for each number."""
    codes = _binaries(data, start, size, mark).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes, np.unique(codes, return_index=True)[1]


def earliest(data: np.ndarray, start: np.ndarray, count: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of distinct pieces (``count[i]`` windows from ``start[i]`` on), the least ``doc`` of the pieces of its group that have an equal window."""
    by = np.argsort(group, kind="stable")
    start, count, group, doc = start[by], count[by], group[by], doc[by]
    new = lz._first(group)
    of = np.cumsum(new) - 1
    least = np.repeat(doc, count)
    window_at = np.cumsum(count) - count
    several = np.flatnonzero(np.bincount(of)[of] > 1) if len(of) else of
    # whole groups, in batches
    ends = np.cumsum((count + LENGTH)[several])
    done = 0
    while done < len(several):
        to = min(len(several), max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SORT_BYTES))))
        while to < len(several) and of[several[to]] == of[several[to - 1]]:
            to += 1
        one = several[done:to]
        place, lowest = _sorted(data, start[one], count[one], of[one], doc[one])
        least[_ranges(window_at[one], count[one])[place]] = lowest
        done = to
    # back in the order of the arguments
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return least[_ranges(window_at[back], count[back])]


def _sorted(data: np.ndarray, start: np.ndarray, count: np.ndarray, of: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of pieces (numbered through all of them) in the order of their groups' suffix arrays, and the least ``doc`` among their equals."""
    size = count + LENGTH - 1
    ends = np.cumsum(size + 1)
    symbols = np.ones(ends[-1], np.uint16)  # 1 ends a piece, 0 a text
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = data[_ranges(start, size)].astype(np.uint16) + 2
    last = np.append(of[1:] != of[:-1], True)
    symbols[ends[last] - 1] = 0
    order = suffix_arrays(symbols, np.append(0, ends[last][:-1]))
    piece = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(symbols)) - (ends - size - 1)[piece]
    order = order[place[order] < count[piece[order]]]  # windows that end inside their piece
    equal = np.append(False, np.ones(len(order) - 1, bool))
    at = np.arange(1, len(order))
    for k in range(LENGTH):  # neighbours, as long as they agree
        same = symbols[order[at] + k] == symbols[order[at - 1] + k]
        equal[at[~same]] = False
        at = at[same]
    first = np.flatnonzero(~equal)
    lowest = np.minimum.reduceat(doc[piece[order]], first)
    return (np.cumsum(count) - count)[piece[order]] + place[order], np.repeat(lowest, np.diff(np.append(first, len(order))))


def late(rows: list[dict], most: int = MOST) -> tuple[np.ndarray, ...]:
    """doc, copy, start and size of the runs of bytes of some segments that are covered by windows of which a smaller doc has an equal."""
    value, shift, count, text, start, doc, copy, place = _taken(rows)
    code, one = _distinct(text, start, count + LENGTH - 1, shift)
    lowest = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(lowest, code, doc)
    s, n, a, key = start[one], count[one], shift[one], value[one]
    group = np.unique(key, return_inverse=True)[1]
    large = np.bincount(group)[group] > most
    piece, low, high, part = _cut(text, s[large], a[large], n[large], key[large], most)
    piece = np.flatnonzero(large)[piece]
    small = np.flatnonzero(~large)
    # pieces: whole segments of the groups that are small, and what the large ones were cut into, each distinct one once
    piece, low, high, part = np.append(small, piece), np.append(np.zeros(len(small), np.int64), low), np.append(n[small] - 1, high), np.append(key[small], part)
    at, size = s[piece] + low, high - low + LENGTH
    code2, one2 = _distinct(text, at, size, a[piece] - low)
    lowest2 = np.full(len(one2), np.iinfo(np.int64).max)
    np.minimum.at(lowest2, code2, lowest[piece])
    windows = size[one2] - LENGTH + 1
    least = earliest(text, at[one2], windows, part[one2], lowest2)
    # windows of pieces back to those of segments
    offset = np.cumsum(n) - n
    mine = np.empty(n.sum(), np.int64)
    mine[_ranges(offset[piece] + low, high - low + 1)] = least[_ranges((np.cumsum(windows) - windows)[code2], high - low + 1)]
    # and of segments to those of their occurrences
    is_late = np.repeat(doc, count) > mine[_ranges(offset[code], count)]
    whose = np.repeat(np.arange(len(doc)), count)
    where = np.flatnonzero(is_late)
    new = np.append(True, (where[1:] != where[:-1] + 1) | (whose[where[1:]] != whose[where[:-1]])) if len(where) else np.zeros(0, bool)
    first = where[new]
    length = np.diff(np.append(np.flatnonzero(new), len(where)))
    owner = whose[first]
    begins = place[owner] + first - (np.cumsum(count) - count)[owner]
    return doc[owner], copy[owner], begins, length + LENGTH - 1


def spans(rows: DataFrame, most: int = MOST, limit: int = BLOCK_LIMIT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """From (_id, _copy, _t) to doc_id, copy and spans: the maximal runs of bytes covered by strings of ``LENGTH`` bytes that also start in a document with a smaller doc_id."""
    rows = rows.select("_id", "_copy", "_t").where("_id is not null and _t is not null")
    size = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    blocks = max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    found = anchors(rows, blocks, slice_bytes).select("doc_id", "copy", "numbers")
    with_numbers = rows.join(found.hint("shuffle_hash"), (F.col("_id") == F.col("doc_id")) & (F.col("_copy") == F.col("copy"))).select("_id", "_copy", "_t", "numbers")

    def cut(batches):
        for doc, copy, data, ends, batch in _slices(batches, 4, slice_bytes):
            value, unit, at, shift, count = segments(data, ends)
            first = np.searchsorted(unit, np.arange(len(doc)))
            lists = batch.column(3)
            take = lists.flatten().to_numpy() + np.repeat(first, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            value, unit, at, shift, count = (x[take] for x in (value, unit, at, shift, count))
            if not len(value):
                continue
            own, own_copy, place = doc[unit], copy[unit], at - ends[unit]
            # equal segments of the slice: those of its smallest doc_id go on, the others are late
            code, one = _distinct(data, at, count + LENGTH - 1, shift)
            lowest = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(lowest, code, own)
            go = own == lowest[code]
            out = _deal((value[go] % np.uint64(blocks)).astype(np.int64), False, value[go], shift[go], count[go], data, at[go], own[go], own_copy[go], place[go])
            yield pa.RecordBatch.from_pylist(out + _known(own[~go], own_copy[~go], place[~go], count[~go] + LENGTH - 1), schema=_SEGMENTS)

    def _known(doc, copy, start, size):
        """Spans as rows beside those of segments: block is negative."""
        found = _spans_out(doc, copy, start, size, blocks)
        return [{"block": -1 - r["block"], "again": False, "values": r["ref_docs"], "shifts": b"", "counts": r["counts"], "text": b"", "size": 0, "docs": r["docs"], "copies": r["copies"], "places": r["places"]} for r in found]

    def match(batches):
        """Blocks one after another; one that grows over the limit passes on window by window."""
        held, bytes_held, over = [], 0, False

        def close():
            nonlocal held, bytes_held, over
            out, held, bytes_held, over = (_known(*late(held, most)) if held else []), [], 0, False
            return out

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] < 0:
                    out.append(row)
                    continue
                if held and held[0]["block"] != row["block"] or over is not False and over != row["block"]:
                    out += close()
                if over is False:
                    held.append(row)
                    bytes_held += row["size"]
                    if bytes_held > limit and not row["again"]:
                        over = row["block"]
                        out += [x for r in held for x in _windows(r)]
                        held = []
                else:
                    out += _windows(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SEGMENTS)
        out = close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SEGMENTS)

    def _windows(row):
        """A row's segments as single windows, by all their bytes."""
        value, shift, count, text, start, doc, copy, place = _taken([row])
        k = _ranges(np.zeros(len(count), np.int64), count)
        at, each = np.repeat(start, count) + k, [np.repeat(x, count) for x in (value, shift, doc, copy, place)]
        whole = _Hash(text).of(at, at + LENGTH)
        value = _mixed(each[0] + whole)
        return _deal((value % np.uint64(blocks)).astype(np.int64), True, value, each[1] - k, np.ones(len(k), np.int64), text, at, each[2], each[3], each[4] + k)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        whole = pa.Table.from_pylist([{"block": 0, "hashes": b"", "ref_docs": r["values"], "ref_copies": b"", "ref_places": b"", **{c: r[c] for c in ("docs", "copies", "counts", "places")}} for r in rows], schema=lz._SCHEMA)
        _, doc, copy, start, size, _, _ = lz._unpack(whole)
        by = np.lexsort((start, copy, doc))
        doc, copy, start, end = doc[by], copy[by], start[by], start[by] + size[by]
        unit = lz._first(doc, copy)
        number = np.cumsum(unit) - 1
        wide = int(end.max()) + 1
        reach = np.maximum.accumulate(end + number * wide) - number * wide
        new = unit.copy()
        new[1:] |= start[1:] > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        runs = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array((reach[last] - start[first]).astype(np.int32))], names=["start", "n"])
        units = np.flatnonzero(unit[first])
        return pa.table({"doc_id": pa.array(doc[first[units]]), "copy": pa.array(copy[first[units]]), "spans": pa.ListArray.from_arrays(pa.array(np.append(units, len(first)).astype(np.int32)), runs)})

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition("block").sortWithinPartitions("block").mapInArrow(match, SEGMENTS)

    matched = materialise(by_block(with_numbers.mapInArrow(cut, SEGMENTS)), "matched")
    known = matched.where("block < 0")
    again = matched.where("block >= 0")
    if not again.isEmpty():
        known = known.unionAll(by_block(again))
    return known.groupBy("block").applyInArrow(merge, SPANS)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """``_row`` (the input's columns), n_bytes, n_removed, n_spans, and kept: the bytes outside the spans. ``sizes`` are those of ``spans``."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"))
    rows = lz.with_copy(rows, lz.repeated_ids(docs, key))
    found = materialise(spans(rows, **sizes).select(F.col("doc_id").alias("_key"), F.col("copy").alias("_key_copy"), F.col("spans").alias("_s")), "spans")
    rows = rows.join(_side(found), (F.col("_id") == F.col("_key")) & (F.col("_copy") == F.col("_key_copy")), "left")
    whole = F.coalesce(F.col("_t"), F.lit("")).cast("binary")
    removed = F.coalesce(F.aggregate("_s", F.lit(0), lambda s, x: s + x.n), F.lit(0)).cast("long")
    rows = rows.select("_row", whole.alias("_b"), "_s", removed.alias("n_removed"), F.coalesce(F.size("_s"), F.lit(0)).cast("long").alias("n_spans"))
    kept = F.when(F.col("_s").isNull(), F.col("_b")).otherwise(F.unhex(_outside("_b", "_s")))
    return rows.select("_row", F.octet_length("_b").cast("long").alias("n_bytes"), "n_removed", "n_spans", kept.alias("kept"))


def _side(found: DataFrame) -> DataFrame:
    """Spans as the small side of a join: broadcast while they are few rows and few spans, else hashed after a shuffle."""
    n = found.agg(F.sum(F.size("_s"))).first()[0] or 0
    return sized(found) if n <= 1_000_000 else found.hint("shuffle_hash")


def _outside(b: str, gone: str) -> Column:
    """In hexadecimal, the bytes between one span's end and the next one's start."""
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s.start + s.n))
    starts = F.concat(F.transform(gone, lambda s: s.start), F.array(F.octet_length(b)))
    return F.array_join(F.zip_with(ends, starts, lambda x, y: F.hex(F.substring(F.col(b), x + 1, y - x))), "")
