"""Harmonic packing of token documents into sequences of one capacity.

A document of over a capacity gives whole sequences first; what is left has a class by its length: class k is the lengths in
(capacity / (k + 1), capacity / k], of which a bin takes exactly k (all up to capacity / ``CLASSES`` are the last class). What k documents leave
of their bin is filled by cutting one of the largest documents that wait, whose rest is classed anew. So there is about one cut for each bin
and no padding. Each Spark partition fills the bins of every class by itself, in one pass without a shuffle, and holds at most k - 1 documents
of class k, under ``CLASSES`` capacities in all. What is left at its end fills sequences in turn, the last ones of power-of-two lengths, which need no padding either.

Defined results: a null or empty text is a document of just the end id; a row's pieces share its doc_id, and repeated rows are
packed like any others; an empty table has no pieces; other columns are ignored. The partition's number is the upper
part of its sequence ids. The capacity is a power of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import give_back
from granulon.llm.tokens import encode_with_end

CLASSES = 32
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: its document, place and ids (little-endian unsigned 32-bit), and its place in a sequence."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        """The first n ids of a piece (key, start, size, doc_tokens, ids), and the rest."""
        key, start, size, whole, ids = piece
        return (key, start, n, whole, ids[: 4 * n]), (key, start + n, size - n, whole, ids[4 * n :])

    def pieces(batches):
        sequence = TaskContext.get().partitionId() << 40
        held: list[list[tuple]] = [[] for _ in range(CLASSES + 1)]
        short: list[tuple] = []  # a bin that waits for ids to fill it
        out: list[tuple] = []

        def close(taken: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for p in taken:
                out.append((*p[:4], sequence, at, p[4]))
                at += p[2]
            sequence += 1

        def place(piece: tuple) -> None:
            """Class a piece of under a capacity; a class that has its count closes a bin."""
            nonlocal short
            waiting = [piece]
            while waiting:
                p = waiting.pop()
                taken = short
                if taken:
                    short, more = [], [p]
                else:
                    k = min(CLASSES, capacity // p[2])
                    held[k].append(p)
                    if len(held[k]) < k:
                        continue
                    taken, held[k], more = held[k], [], []
                gap = capacity - sum(x[2] for x in taken)
                while gap:
                    if not more:
                        largest = next((c for c in held if c), None)
                        if largest is None:
                            short = taken
                            break
                        more = [largest.pop()]
                    p = more.pop()
                    if p[2] > gap:
                        p, rest = cut(p, gap)
                        waiting.append(rest)
                    taken.append(p)
                    gap -= p[2]
                else:
                    close(taken)

        def table() -> pa.RecordBatch:
            nonlocal out
            kinds = [pa.int64()] * 6 + [pa.binary()]
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, begin in encode_with_end(tokenizer, batch.column(1), end_id, most_bytes=1 << 23):
                raw, begin = memoryview(ids.astype("<u4")).cast("B"), begin.tolist()
                for k in range(len(begin) - 1):
                    n = begin[k + 1] - begin[k]
                    rest = (keys[first + k], 0, n, n, bytes(raw[4 * begin[k] : 4 * begin[k + 1]]))
                    while rest[2] >= capacity:
                        whole, rest = cut(rest, capacity)
                        close([whole])
                    if rest[2]:
                        place(rest)
                    if len(out) >= 5_000:
                        yield table()
                if out:
                    yield table()
            give_back()
        left = short + [p for c in held for p in c]
        total = sum(p[2] for p in left)
        sizes = [capacity] * (total // capacity) + [1 << j for j in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> j & 1]
        for size in sizes:
            taken = []
            while size:
                p = left.pop()
                if p[2] > size:
                    p, rest = cut(p, size)
                    left.append(rest)
                taken.append(p)
                size -= p[2]
            close(taken)
        if out:
            yield table()

    assert capacity & (capacity - 1) == 0, "the capacity is a power of two"
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(pieces, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length and ids (each is one bin, so a group is bounded by the capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("x"))))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", F.unhex(F.array_join(F.transform("p", lambda s: s.x), "")).alias("ids"))
