"""Substring dedup: relative Lempel-Ziv parsing against indexed reference blocks; long factors become duplicate spans.

The index of the reference is dealt by hash over blocks: a block is one group of a shuffle and holds about ``BLOCK_BYTES`` of text's phrases, ``LENGTH``
consecutive words each. There each phrase meets the earliest document that has it, and goes back to its own document with that reference (document, place).
The parse goes through a document's found phrases in order and extends a factor as long as its reference goes on too, word by word; where that ends the
next factor begins, at the phrase that crosses the boundary, since every phrase has been looked up. A factor is thus (start, length,
reference document, place there). The words it copies are cut out of the reference and compared with its own; only equal ones count, so no hash decides alone.
Factors have at least ``LENGTH`` words, and their union is exactly the words covered by a repeated phrase.

Scale: words become 64-bit hashes once, phrases a rolling sum of them, so a phrase costs about ten shuffled bytes. Before the
shuffle each slice of documents sends a phrase once, for its smallest doc_id; its other documents that have it are
known repeats and travel by document, so a phrase in a third of all documents loads no block. A phrase whose 64-bit hash is an earlier,
different phrase's would not be found (expected below one in 4e9 phrases); none is removed wrongly.

The unit that is packed, parsed and joined back is (doc_id, copy); copy is zero where the doc_id has one row and the text's 64-bit
hash elsewhere, so only repeated ids pay for it. The doc_id alone decides which of two documents is the earlier one.

Defined results: a null or empty text has no words; a null doc_id is neither a reference nor parsed; rows that share a doc_id are each
parsed by themselves, none of them against another, and equal rows get equal results; other columns survive in ``remove`` and are
ignored in ``factors``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import give_back, materialise, sized, words

LENGTH, BLOCK_BYTES, SLICE_BYTES, TOGETHER = 13, 8 << 20, 4 << 20, 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PARTS = ("hashes", "docs", "copies", "counts", "places", "ref_docs", "ref_copies", "ref_places")
ROWS = "block int, " + ", ".join(f"{c} binary" for c in _PARTS)
_SCHEMA = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in _PARTS)])
FACTORS = "doc_id long, copy long, factors array<struct<start:int,n:int,ref:long,ref_copy:long,at:int>>"


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers by significance, so that the shuffle's compression finds the zeros of small ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _whole(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _first(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _pack(block: int, hashes: np.ndarray, doc: np.ndarray, copy: np.ndarray, place: np.ndarray, *ref: np.ndarray) -> dict:
    """A row of phrases in order of (doc, copy, place): each unit once, and differences of neighbours; ``ref`` is where each is found (doc, copy, place)."""
    first = np.flatnonzero(_first(doc, copy))
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    row = {"block": block, "hashes": hashes.tobytes(), "docs": _planes(np.diff(doc[first], prepend=0)), "copies": _planes(copy[first]) if copy.any() else b"", "counts": _planes(np.diff(np.append(first, len(doc))).astype(np.uint32)), "places": _planes(step.astype(np.uint32))}
    if not ref:
        return row | {"ref_docs": b"", "ref_copies": b"", "ref_places": b""}
    to, to_copy, at = ref
    return row | {"ref_docs": _planes(np.diff(to, prepend=0)), "ref_copies": _planes(to_copy) if to_copy.any() else b"", "ref_places": _planes(np.diff(at, prepend=0).astype(np.int32))}


def _unpack(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """hash, doc, copy, place, and where they are found: ref doc, copy and place (zeros where rows hold none)."""
    out: list[tuple] = []
    for r in rows.to_pylist():
        count = _whole(r["counts"], np.uint32).astype(np.int64)
        doc, step = np.cumsum(_whole(r["docs"], np.int64)), _whole(r["places"], np.uint32).astype(np.int64)
        run = np.cumsum(step)
        first = np.cumsum(count) - count
        base = run[first] - step[first]
        none = np.zeros(len(run), np.int64)
        copy = np.repeat(_whole(r["copies"], np.int64), count) if r["copies"] else none
        to = np.cumsum(_whole(r["ref_docs"], np.int64)) if r["ref_docs"] else none
        at = np.cumsum(_whole(r["ref_places"], np.int32).astype(np.int64)) if r["ref_places"] else none
        out.append((np.frombuffer(r["hashes"], np.uint64), np.repeat(doc, count), copy, run - np.repeat(base, count), to, _whole(r["ref_copies"], np.int64) if r["ref_copies"] else none, at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 7


def _of_document(doc: np.ndarray, copy: np.ndarray, n: int) -> np.ndarray:
    h = (doc ^ copy).view(np.uint64) * _ODD
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _in_order(doc: np.ndarray, copy: np.ndarray, place: np.ndarray, *ref: np.ndarray) -> list[np.ndarray]:
    """Phrases in order of (doc, copy, place), each once: with the first of its references."""
    order = np.lexsort((*ref[::-1], place, copy, doc))
    columns = [x[order] for x in (doc, copy, place, *ref)]
    new = _first(*columns[:3])
    return [x[new] for x in columns]


def _split(block: np.ndarray, hashes: np.ndarray, doc: np.ndarray, copy: np.ndarray, place: np.ndarray, *ref: np.ndarray, base: int = 0) -> list[dict]:
    """Rows by block; phrases keep their order inside one."""
    order = np.argsort(block, kind="stable")
    block, hashes = block[order], hashes[order] if len(hashes) else hashes
    doc, copy, place, *ref = (x[order] for x in (doc, copy, place, *ref))
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    ends = zip(np.append(0, cuts), np.append(cuts, len(block)), strict=True) if len(block) else []
    return [_pack(base + int(block[a]), hashes[a:b], doc[a:b], copy[a:b], place[a:b], *(x[a:b] for x in ref)) for a, b in ends]


def phrases(doc_id: np.ndarray, texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, place) of every phrase of some documents, in order of (doc, place)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    ends = np.append(0, np.cumsum(full))[offsets - offsets[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if len(coded) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]
    n = len(w) - length + 1
    h, power = np.zeros(n, np.uint64), np.uint64(1)
    for k in range(length):
        h += w[k : k + n] * power
        power *= _ODD
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    own = np.maximum(np.diff(ends) - length + 1, 0)
    place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    return h[place + np.repeat(ends[:-1], own)], np.repeat(doc_id, own), place


def repeated_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame | None:
    """``_id``: the doc_ids of more than one row; None if there are none."""
    found = docs.select(F.col(key).cast("long").alias("_id")).where("_id is not null").groupBy("_id").count().where("count > 1")
    found = materialise(found.select("_id"), "repeated")
    return None if found.isEmpty() else found


def with_copy(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Rows of (_id, _t, ...) and ``_copy``: with _id the unit that factors belong to."""
    if repeated is None:
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    found = rows.join(repeated.withColumn("_many", F.lit(True)), "_id", "left")
    return found.withColumn("_copy", F.when(F.col("_many"), F.xxhash64(F.coalesce("_t", F.lit("")))).otherwise(F.lit(0).cast("long"))).drop("_many")


def factors(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """From (_id, _copy, _t) to doc_id, copy and factors: array of (start, n), the runs of words that repeat phrases of documents with a smaller doc_id."""
    rows = rows.select("_id", "_copy", "_t").where("_id is not null and _t is not null")
    size = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    blocks = max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))

    def ask(batches):
        for batch in batches:
            doc_id, copies, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            first = 0
            while first < len(doc_id):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES)))
                order = np.lexsort((copies[first:last], doc_id[first:last]))
                # equal rows are one unit
                order = order[_first(doc_id[first:last][order], copies[first:last][order])]
                h, unit, place = phrases(np.arange(len(order)), texts[first:last].take(pa.array(order)), length)
                doc, copy = doc_id[first:last][order][unit], copies[first:last][order][unit]
                first = last
                # stable, so of equal phrases the one of the smallest doc_id comes first
                by_hash = np.argsort(h, kind="stable")
                same = np.append(False, h[by_hash][1:] == h[by_hash][:-1]) if len(h) else np.zeros(0, bool)
                lead = by_hash[np.flatnonzero(~same)][np.cumsum(~same) - 1] if len(h) else by_hash
                repeat = np.zeros(len(h), bool)
                repeat[by_hash] = doc[by_hash] > doc[lead]
                ask_for = np.zeros(len(h), bool)
                ask_for[by_hash] = doc[by_hash] == doc[lead]
                # repeats within a doc_id are asked for each: all of them repeat if an earlier document has the phrase
                out = _split((h[ask_for] % np.uint64(blocks)).astype(np.int64), h[ask_for], doc[ask_for], copy[ask_for], place[ask_for])
                found = np.zeros(len(h), np.int64)
                found[by_hash] = lead
                found = found[repeat]
                out += _split(_of_document(doc[repeat], copy[repeat], blocks), h[:0], doc[repeat], copy[repeat], place[repeat], doc[found], copy[found], place[found], base=blocks)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
            give_back()

    def answer(group: pa.Table) -> pa.Table:
        """Of one block: the phrases that start in an earlier document, by document."""
        if group["block"][0].as_py() >= blocks:  # known repeats pass
            return group.set_column(0, "block", pc.cast(pc.subtract(group["block"], blocks), pa.int32()))
        h, doc, copy, place = _unpack(group)[:4]
        order = np.lexsort((place, copy, doc, h))
        h, doc, copy, place = h[order], doc[order], copy[order], place[order]
        new = _first(h)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = doc > doc[lead]
        columns = [doc[late], copy[late], place[late], *(x[lead[late]] for x in (doc, copy, place))]
        columns = _in_order(*columns)
        return pa.Table.from_pylist(_split(_of_document(*columns[:2], blocks), h[:0], *columns), schema=_SCHEMA)

    def parse(group: pa.Table) -> pa.Table:
        """Of the documents of one group: their factors, each as long as its reference goes on."""
        doc, copy, place, to, to_copy, at = _in_order(*_unpack(group)[1:])
        new_unit = _first(doc, copy)
        new = new_unit.copy()
        new[1:] |= (np.diff(place) != 1) | (np.diff(at) != 1) | (np.diff(to) != 0) | (np.diff(to_copy) != 0)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(doc)) - 1
        ints = lambda x: pa.array(x.astype(np.int32))
        parts = [ints(place[start]), ints(place[end] + length - place[start]), pa.array(to[start]), pa.array(to_copy[start]), ints(at[start])]
        spans = pa.StructArray.from_arrays(parts, names=["start", "n", "ref", "ref_copy", "at"])
        firsts = np.flatnonzero(new_unit[start])
        return pa.table({"doc_id": pa.array(doc[start[firsts]]), "copy": pa.array(copy[start[firsts]]), "factors": pa.ListArray.from_arrays(pa.array(np.append(firsts, len(start)).astype(np.int32)), spans)})

    asked = rows.mapInArrow(ask, ROWS)
    answered = asked.groupBy("block").applyInArrow(answer, ROWS)
    return answered.groupBy("block").applyInArrow(parse, FACTORS)


def with_references(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each factor with ``x``, the words of its reference that it copies: from (_id, _copy, _t) and ``factors`` to doc_id, copy and factors (start, n, x).

    Only texts that are referred to meet the factors, and a text is split into words once for up to about ``TOGETHER`` of its factors that come as one row:
    a text that a third of all documents copy from is split once for each of those rows, which go to different tasks.
    """
    found = materialise(found, "factors")
    each = found.select("doc_id", "copy", F.explode("factors").alias("f")).select("doc_id", "copy", "f.*")
    needed = materialise(each.groupBy("ref", "ref_copy").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_rows")), "references")
    same = (F.col("_id") == F.col("ref")) & (F.col("_copy") == F.col("ref_copy"))
    few = needed.where("_rows > 1")
    dealt = each.join(sized(few), ["ref", "ref_copy"], "left").withColumn("_row", F.pmod(F.xxhash64("doc_id", "copy", "start"), F.coalesce("_rows", F.lit(1))).cast("int"))
    dealt = dealt.groupBy("ref", "ref_copy", "_row").agg(F.collect_list(F.struct("doc_id", "copy", "start", "n", "at")).alias("_all"))
    rows = rows.where("_t is not null").select("_id", "_copy", "_t").join(sized(needed), same)
    texts = rows.select("_id", "_copy", "_t", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_row"))
    # the words are made below the explode, so once for a row
    met = dealt.join(texts.hint("shuffle_hash"), [F.col("_id") == F.col("ref"), F.col("_copy") == F.col("ref_copy"), dealt["_row"] == texts["_row"]])
    met = met.select(words(F.col("_t")).alias("_w"), "_all").select("_w", F.explode("_all").alias("_x")).select("_w", "_x.*")
    cut = met.select("doc_id", "copy", F.struct("start", "n", F.array_join(F.slice("_w", F.col("at") + 1, F.col("n")), " ").alias("x")).alias("f"))
    return cut.groupBy("doc_id", "copy").agg(F.collect_set("f").alias("factors"))


def spans(w: str, factors: str) -> Column:
    """Disjoint spans (start, n) in order, of the factors whose words are those of their references."""
    right = F.filter(factors, lambda f: F.array_join(F.slice(w, f.start + 1, f.n), " ") == f.x)
    one = lambda start, n: F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"))

    def joined(done: Column, f: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        end = last.start + last.n
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one(last.start, F.greatest(end, f.start + f.n) - last.start)))
        return F.when((F.size(done) > 0) & (f.start <= end), longer).otherwise(F.concat(done, F.array(one(f.start, f.n))))

    return F.aggregate(F.array_sort(F.transform(right, lambda f: one(f.start, f.n))), F.expr("cast(array() as array<struct<start:int,n:int>>)"), joined)


def kept_words(w: str, gone: str) -> Column:
    """The words outside the spans, joined by one space: slices between one span's end and the next one's start."""
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s.start + s.n))
    starts = F.concat(F.transform(gone, lambda s: s.start), F.array(F.size(w)))
    gaps = F.zip_with(ends, starts, lambda a, b: F.slice(w, a + 1, F.greatest(b - a, F.lit(0))))
    return F.array_join(F.when(F.col(gone).isNull(), F.col(w)).otherwise(F.flatten(gaps)), " ")


def parsed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, columns: list[str] | None = None) -> DataFrame:
    """``_row`` (the input's columns, or some), n_words, n_removed, and kept: the words outside the factors joined by one space."""
    rows = docs.select(F.struct(*(columns or ["*"])).alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"))
    rows = with_copy(rows, repeated_ids(docs, key))
    found = with_references(rows, factors(rows, length)).select(F.col("doc_id").alias("_key"), F.col("copy").alias("_key_copy"), F.col("factors").alias("_f"))
    # the text goes through one shuffle and no sort: the factors are the side that is hashed
    rows = rows.join(found.hint("shuffle_hash"), (F.col("_id") == F.col("_key")) & (F.col("_copy") == F.col("_key_copy")), "left").select("_row", "_f", words(F.col("_t")).alias("_w"))
    rows = rows.select("_row", "_w", F.when(F.col("_f").isNotNull(), spans("_w", "_f")).alias("_s"))
    removed = F.coalesce(F.aggregate("_s", F.lit(0), lambda s, x: s + x.n), F.lit(0)).cast("long")
    return rows.select("_row", F.size("_w").cast("long").alias("n_words"), removed.alias("n_removed"), kept_words("_w", "_s").alias("kept"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with the input's columns; a text that has duplicate spans becomes its other words, joined by one space."""
    found = parsed(docs, key, text, length)
    return found.select(*(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"_row.`{c}`")).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
