"""SimHash near-duplicates: every fingerprint pair of at most three differing bits, by deletion variants of two segments.

A fingerprint is cut into two segments of 32 bits. If two fingerprints differ by at most three bits, one segment differs by
at most one, so both have a variant of it in common in which one bit is left out. The 64 variants of each *distinct*
fingerprint are shuffled, and the members of each variant's group verify against each other inside the task, where only
a spanning forest of the links is kept, never all pairs. A group of over ``GROUP`` members is not held: it is named, and its
members are indexed again by variants of their other segment's halves, then of the remaining half's halves, after
which a group has at most 2^11 members. No link is lost and no group is unbounded.

``near_components`` and ``keep`` find near copies in the usual sense: five-word shingles, Jaccard similarity of 0.8 or more. There a bit
differs with probability 0.15, so fingerprints are longer (at least 240 bits) and cut into segments so that, with probability 0.99 at
0.8 and more above it, one segment at least differs by at most one bit; its one-wildcard variants are the keys as before. Members of a group within 33 of 128 bits
are joined into families, by links to a first member; that only gathers what is to be compared. In a group of over ``GROUP`` each member looks for those of ``LEADERS`` of its members that are near;
members near leaders that are joined need no more, and all others meet the whole group in blocks, so no link within a group is lost, whatever its size. Inside a family all texts are compared exactly on their sets of shingles, whatever its size: a family of at most
``FAMILY`` in one task; in a larger one the texts near its middle take the others first (a star of copies about one text needs no more), and what they do not reach meets all of the family in blocks.
Segments widen with log2 of the number of documents, so random groups stay small (at the price of more variants: 240 a document up to 2 million, 408 at 12 million).

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like any other; copies share
a fingerprint and so are one node; repeated rows each get their component; a null doc_id never names a component unless
all its members are null (then the component is null).
"""

from __future__ import annotations

import math
import string
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.llm.common import give_back, materialise, scratch, sized, words
from granulon.llm.components import connected_components

SHINGLE, DISTANCE, GROUP = 3, 3, 2048
#: Near copies: shingles of so many words, their Jaccard similarity, the share of pairs at it that meet, and the bits of 128 that candidates may differ by.
WIDE_SHINGLE, SIMILARITY, RECALL, WIDE_DISTANCE = 5, 0.8, 0.992, 33
#: Members of a large group that the others look for; texts of a family that one task holds; rounds of texts near a larger family's middle.
LEADERS, FAMILY, PIVOTS = 64, 512, 3
NODE = ["fp", "more", "mix"]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (bigint): the bits set in over half of the shingles' hashes."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    shingles = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("w", i + k) for k in range(SHINGLE)))))
    hashes = docs.select(F.col(key).cast("long").alias("doc_id"), words(low).alias("w"))
    hashes = hashes.select("doc_id", F.when(F.size("w") >= SHINGLE, shingles).when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.expr("cast(array() as array<bigint>)")).alias("h"))

    def sketch(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            h, ends = lists.flatten().to_numpy().view(np.uint64), ends - ends[0]
            fp = np.zeros(len(lists), np.uint64)
            first = 0
            while first < len(lists):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + 500_000)) - 1)
                n = np.diff(ends[first : last + 1])
                full = np.flatnonzero(n)
                if len(full):
                    bits = np.unpackbits(h[ends[first] : ends[last]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, ends[first + full] - ends[first], axis=0, dtype=np.int32)
                    fp[first + full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
                first = last
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return hashes.mapInArrow(sketch, "doc_id long, fp long")


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """(k, s, fp), one row for each variant; from (fp) at level 0, from (k, s, fp) of the groups that were too large at 1 and 2."""
    if level == 0:
        v = rows.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        return v.selectExpr("shiftleft(cast(i as bigint), 32) | ((case when i < 32 then fp else shiftrightunsigned(fp, 32) end) & 4294967295L & ~shiftleft(1L, i % 32)) as k", "0L as s", "fp")
    # the segment that k does not index: the upper one if k's is the lower
    other = "(case when shiftright(k, 32) < 32 then shiftrightunsigned(fp, 32) else fp & 4294967295L end)"
    if level == 1:
        v = rows.select("k", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
        return v.selectExpr("k", f"shiftleft(cast(i as bigint), 16) | ((case when i < 16 then {other} else shiftright({other}, 16) end) & 65535L & ~shiftleft(1L, i % 16)) as s", "fp")
    half = f"(case when shiftright(s, 16) < 16 then shiftright({other}, 16) else {other} & 65535L end)"
    v = rows.select("k", "s", "fp", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    return v.selectExpr("k", f"shiftleft(s, 12) | shiftleft(cast(i as bigint), 8) | ((case when i < 8 then {half} else shiftright({half}, 8) end) & 255L & ~shiftleft(1L, i % 8)) as s", "fp")


def _forest(members: np.ndarray) -> tuple[list, list]:
    """Links that span the components of one group: breadth-first over those not yet reached."""
    a, b, rest = [], [], members
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= DISTANCE
            hit = rest[near]
            if len(hit):
                a.append(np.full(len(hit), root))
                b.append(hit)
                queue.extend(hit)
                rest = rest[~near]
    return a, b


def _stars(fp: np.ndarray, more: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member to the first one of its component, where members within ``distance`` are joined. Members come in order of fp, so a component has the same first member in whatever groups it meets, and the same links."""
    a, b, rest = [], [], np.arange(len(fp))
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) + np.bitwise_count(more[rest] ^ more[at]) <= distance
            if near.any():
                a.append(np.full(near.sum(), fp[root]))
                b.append(fp[rest[near]])
                queue.extend(rest[near])
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(variants: DataFrame, group: int, distance: int = DISTANCE, few: int = 8) -> DataFrame:
    """(a, b) links, and (k, s) with null a of groups that are too large; groups pass through in order of (k, s).

    With a column ``more`` the distance counts its bits too; groups of over ``few`` members then give the links of each member to its component's first,
    those of at most ``few`` all links.
    """
    wide = "more" in variants.columns

    def link(batches):
        held, large = None, False  # rows of the group that the last batch ended in; whether it was named as too large

        def table(a, b, k, s):
            a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
            pad = [None] * len(k)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), pa.array(pad, pa.int64())]) for x in (a, b)] + [pa.array([None] * len(a) + x, pa.int64()) for x in (k, s)], names=["a", "b", "k", "s"])

        def work(rows, last):
            nonlocal held, large
            k, s = rows[:2]
            new = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1
            start, end = np.concatenate([[0], new]), np.concatenate([new, [len(k)]])
            a, b, big_k, big_s = [], [], [], []
            if large:  # the first group goes on from one already named
                start, end = start[1:], end[1:]
            cut = len(k)
            if not last:
                # the last group may go on
                cut = int(start[-1]) if len(start) else len(k)
                if not len(start):
                    held = tuple(x[-1:] for x in rows)
                    return table(a, b, big_k, big_s)
                start, end = start[:-1], end[:-1]
                large = len(k) - cut > group
                if large:
                    big_k.append(int(k[-1]))
                    big_s.append(int(s[-1]))
                    cut = len(k) - 1
                held = tuple(x[cut:] for x in rows)
            size = end - start
            over = size > group
            big_k += k[start[over]].tolist()
            big_s += s[start[over]].tolist()
            # members of small groups against the next few; larger groups one by one
            small = (size > 1) & (size <= few)
            owner = np.repeat(np.where(small, np.arange(len(size)), -1), size)
            sketch = [x[start[0] : end[-1]] if len(start) else x[:0] for x in rows[2:]]
            i = np.flatnonzero(owner >= 0)
            for step in range(1, few):
                i = i[i < len(owner) - step]
                i = i[owner[i] == owner[i + step]]
                if not len(i):
                    break
                near = i[sum(np.bitwise_count(x[i] ^ x[i + step]) for x in sketch) <= distance]
                a.append(sketch[0][near])
                b.append(sketch[0][near + step])
            for g in np.flatnonzero((size > few) & ~over):
                own = [x[start[g] : end[g]] for x in rows[2:]]
                more = [[x] for x in _stars(*own, distance)] if wide else _forest(own[0])
                a += more[0]
                b += more[1]
            return table(a, b, big_k, big_s)

        for batch in batches:
            rows = tuple(batch.column(i).to_numpy() for i in range(4 if wide else 3))
            rows = rows[:2] + tuple(x.view(np.uint64) for x in rows[2:])
            if not len(rows[0]):
                continue
            if held is not None:
                if large and (held[0][0], held[1][0]) != (rows[0][0], rows[1][0]):
                    large = False
                elif not large:
                    rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            yield work(rows, False)
        if held is not None and not large:
            yield work(held, True)

    ordered = variants.repartition("k", "s").sortWithinPartitions("k", "s", "fp")
    return ordered.mapInArrow(link, "a long, b long, k long, s long")


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """From distinct fingerprints (fp) to links (a, b) with the same components as all links."""
    rows, found = distinct.select("fp"), None
    for level in range(3):
        variants = _variants(rows, level)
        got = materialise(_links(variants, group if level < 2 else 1 << 12), "links")
        new = got.where("a is not null").select("a", "b").distinct()
        found = new if found is None else found.unionAll(new)
        large = got.where("a is null").select("k", "s").distinct()
        if level == 2 or large.isEmpty():
            return found
        rows = variants.join(large, ["k", "s"])
    return found


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links reach."""
    each = materialise(fingerprints(docs, key, text), "fingerprints")
    distinct = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return _named(each, distinct, links(distinct))


def width(n: int) -> tuple[int, int]:
    """(bits in a segment, segments) for n documents: random groups keep about 64 members at any n, and a pair at ``SIMILARITY`` shares a variant with probability ``RECALL``."""
    bits = max(16, math.ceil(math.log2(max(n, 1))) - 5)
    apart = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi  # the chance that a bit differs
    shared = (1 - apart) ** bits + bits * apart * (1 - apart) ** (bits - 1)
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - shared))


def shingled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, x: the distinct hashes of the text's shingles of ``WIDE_SHINGLE`` words, and mix, 64 bits of that set."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - WIDE_SHINGLE), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("w", i + k) for k in range(WIDE_SHINGLE))))))
    found = docs.select(F.col(key).cast("long").alias("doc_id"), words(low).alias("w"))
    found = found.select("doc_id", F.when(F.size("w") >= WIDE_SHINGLE, shingles).when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.expr("cast(array() as array<bigint>)")).alias("x"))
    return found.withColumn("mix", F.aggregate("x", F.size("x").cast("long"), lambda s, h: s.bitwiseXOR(h)))


def sketches(docs: DataFrame, bits: int, segments: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mix, fp and more (128 bits of the fingerprint) and its segments."""
    planes = -(-max(128, bits * segments) // 64)

    def sketch(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            h, ends = lists.flatten().to_numpy().view(np.uint64), ends - ends[0]
            found = np.zeros((len(lists), 64 * planes), np.uint8)
            first = 0
            while first < len(lists):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + 300_000)) - 1)
                n = np.diff(ends[first : last + 1])
                full = np.flatnonzero(n)
                part = h[ends[first] : ends[last]]
                for p in range(planes if len(full) else 0):
                    mixed = part if p == 0 else (part ^ (part >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1E * p) % 2**64 | 1)
                    mixed = mixed ^ (mixed >> np.uint64(29)) if p else mixed
                    ones = np.add.reduceat(np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), ends[first + full] - ends[first], axis=0, dtype=np.int32)
                    found[first + full, 64 * p : 64 * p + 64] = 2 * ones > n[full][:, None]
                first = last
            whole = np.packbits(found[:, :128], axis=1, bitorder="little").view(np.int64)
            weight = np.int64(1) << np.arange(bits, dtype=np.int64)
            cut = np.stack([found[:, r * bits : (r + 1) * bits] @ weight for r in range(segments)], axis=1)
            cut = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * segments), pa.array(cut.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), cut], names=["doc_id", "mix", "fp", "more", "segments"])
            give_back()

    return shingled(docs, key, text).mapInArrow(sketch, "doc_id long, mix long, fp long, more long, segments array<long>")


def _wide_variants(rows: DataFrame, bits: int) -> DataFrame:
    """(k, s, fp, more) from (fp, more, segments): each segment with each bit left out."""
    v = rows.select("fp", "more", F.posexplode("segments").alias("r", "x")).select("fp", "more", "r", "x", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("i"))
    return v.selectExpr("shiftleft(cast(r as bigint), 52) | shiftleft(cast(i as bigint), 46) | (x & ~shiftleft(1L, i)) as k", "0L as s", "fp", "more")


def _core(meets: list[int | None], counts: list[int]) -> int:
    """The leaders (bits) that a chain of members joins to the one with most members near; ``meets`` has for each leader all that its members are near."""
    core = todo = 1 << max(range(len(counts)), key=lambda i: counts[i])
    while todo:
        i = (todo & -todo).bit_length() - 1
        new = ((meets[i] or 0) & (1 << 64) - 1) & ~core
        core, todo = core | new, todo & (todo - 1) | new
    return core - (core >> 63 << 64)


def _near(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) that have the components of all links between the members of two tables."""
    x, y = ([t[c].to_numpy().view(np.uint64) for c in ("fp", "more")] for t in (left, right))
    near = np.zeros((len(left), len(right)), bool)
    for k in range(0, len(left), 256):
        part = slice(k, k + 256)
        near[part] = sum(np.bitwise_count(p[part, None] ^ q[None, :]) for p, q in zip(x, y, strict=True)) <= WIDE_DISTANCE
        near[part] &= x[0][part, None] != y[0][None, :]
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    n = len(rows)
    square = np.zeros((n + len(columns),) * 2, bool)
    square[:n, n:] = near[np.ix_(rows, columns)]
    square[n:, :n] = square[:n, n:].T
    fp = np.concatenate([x[0][rows], y[0][columns]]).view(np.int64)
    pairs = np.array(_spanning(square), np.int64).reshape(-1, 2)
    return pa.table({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})


def _large_groups(members: DataFrame, group: int) -> DataFrame:
    """From (k, s, fp, more) of groups that are too large to links (a, b) with the components of all their links.

    Each member is compared with ``LEADERS`` of its group. Leaders that a chain of members joins are the core, and members near one of them are in its
    component, so no pair of them is looked at again. All other members meet the whole group, in blocks of at most about ``group`` on both sides.
    """
    key = ["k", "s"]
    order = W.partitionBy(*key).orderBy(F.xxhash64("fp", "more"), "fp", "more")
    few = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LEADERS)
    few = materialise(few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "fp", "more"))).alias("leaders")), "leaders")
    apart = lambda l: F.bit_count(F.col("fp").bitwiseXOR(l.fp)) + F.bit_count(F.col("more").bitwiseXOR(l.more))
    bit = lambda l: F.call_function("shiftleft", F.lit(1).cast("long"), l.n - 1)
    near = F.aggregate("leaders", F.lit(0).cast("long"), lambda found, l: found.bitwiseOR(F.when(apart(l) <= WIDE_DISTANCE, bit(l)).otherwise(F.lit(0).cast("long"))))
    seen = materialise(members.join(sized(few), key).select(*key, "fp", "more", near.alias("near")), "led")
    has = [F.bit_get("near", F.lit(i)) == 1 for i in range(LEADERS)]
    meets, counts = F.array(*(F.bit_or(F.when(h, F.col("near"))) for h in has)), F.array(*(F.count_if(h) for h in has))
    cores = seen.groupBy(*key).agg(meets.alias("meets"), counts.alias("counts")).select(*key, F.udf(_core, "long")("meets", "counts").alias("core"))
    cores = materialise(cores.join(sized(few), key), "cores")
    of = lambda bits: F.transform(F.filter("leaders", lambda l: bits.bitwiseAND(bit(l)) != 0), lambda l: l.fp)
    inside = F.col("near").bitwiseAND(F.col("core"))
    met = seen.join(sized(cores), key).select(*key, "fp", "more", F.get(of(inside), F.lit(0)).alias("leader"))
    met = materialise(met, "met")
    middle = cores.select(of(F.col("core")).alias("all")).select(F.get("all", F.lit(0)).alias("a"), F.explode("all").alias("b"))
    found = met.where("leader is not null").select(F.col("fp").alias("a"), F.col("leader").alias("b")).unionAll(middle)
    left = met.where("leader is null").drop("leader")
    if left.isEmpty():
        return found
    size = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / group).cast("int").alias(name))
    cuts = sized(materialise(size(left, "lb").join(size(met, "mb"), key), "cuts"))
    deal = lambda n: F.pmod(F.xxhash64("fp", "more"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(cuts, key).select(*key, "fp", "more", deal("lb").alias("i"), every("mb").alias("j"))
    b = met.join(cuts, key).select(*key, "fp", "more", every("lb").alias("i"), deal("mb").alias("j"))
    b = b.toDF(*b.columns)  # columns of their own
    blocks = [*key, "i", "j"]
    return found.unionAll(a.groupBy(*blocks).cogroup(b.groupBy(*blocks)).applyInArrow(_near, "a long, b long"))


def candidates(rows: DataFrame, bits: int, group: int = GROUP) -> DataFrame:
    """From (fp, more, segments) to links (a, b) of fp whose components hold together what is within ``WIDE_DISTANCE`` of 128 bits and shares a one-wildcard variant of a segment."""
    variants = _wide_variants(rows, bits)
    got = materialise(_links(variants, group, WIDE_DISTANCE), "candidates")
    found = got.where("a is not null").select("a", "b")
    large = got.where("a is null").select("k", "s").distinct()
    if not large.isEmpty():
        members = materialise(variants.join(sized(materialise(large, "large")), ["k", "s"]).distinct(), "members-of-large")
        found = found.unionAll(_large_groups(members, group))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of two lists of sets have a Jaccard similarity of ``SIMILARITY`` or more: exact, by products of incidence matrices, some columns at a time."""
    size = [np.array([len(x) for x in side]) for side in (left, right)]
    codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    code = codes[: size[0].sum()], codes[size[0].sum() :]
    both = np.flatnonzero(np.isin(np.arange(codes.max(initial=-1) + 1), code[0]) & np.isin(np.arange(codes.max(initial=-1) + 1), code[1]))
    column = np.full(codes.max(initial=-1) + 1, -1)
    column[both] = np.arange(len(both))
    owner = [np.repeat(np.arange(len(n)), n) for n in size]
    shared = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(both), 4096):
        part = []
        for c, o, n in zip(code, owner, size, strict=True):
            at = column[c] - a
            ok = (at >= 0) & (at < 4096) & (column[c] >= 0)
            m = np.zeros((len(n), min(4096, len(both) - a)), np.float32)
            m[o[ok], at[ok]] = 1
            part.append(m)
        shared += part[0] @ part[1].T
    return shared >= SIMILARITY * (size[0][:, None] + size[1][None, :] - shared) - 1e-9


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Links of a square matrix that have its components."""
    out, left = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if left[root]:
            left[root], queue = False, [root]
            while queue:
                at = queue.pop()
                new = np.flatnonzero(links[at] & left)
                left[new] = False
                out += [(at, int(x)) for x in new]
                queue += new.tolist()
    return out


_PAIR = ", ".join(f"{c}{k} long" for k in (1, 2) for c in NODE)


def _pairs_table(nodes: np.ndarray, others: np.ndarray, pairs: list) -> pa.RecordBatch:
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*nodes[:, i], *others[:, j])], names=[c.split()[0] for c in _PAIR.split(", ")])


def _sets(column) -> list[np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1]) if len(lists) else []


def _keys(table) -> np.ndarray:
    return np.stack([np.asarray(table.column(c)) for c in NODE])


def _small_families(members: DataFrame) -> DataFrame:
    """From (family, fp, more, mix, x) to pairs of nodes that span each family's links; families pass one after another."""

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            family = table["family"].to_numpy()
            cuts = np.append(np.flatnonzero(family[1:] != family[:-1]) + 1, len(family))
            yield from whole(table, cuts[:-1])
            held = table.slice(cuts[-2] if len(cuts) > 1 else 0)
            held = held.take(pa.array(range(len(held))))  # a copy, so the batch can go
        if held is not None:
            yield from whole(held, [len(held)])

    def whole(table, cuts):
        start = 0
        for end in cuts:
            one = table.slice(start, end - start)
            start = end
            if len(one) > 1:
                sets, nodes = _sets(one["x"]), _keys(one)
                pairs = _spanning(_alike(sets, sets))
                if pairs:
                    yield _pairs_table(nodes, nodes, pairs)

    return members.repartition("family").sortWithinPartitions("family").mapInArrow(compare, _PAIR)


def _jaccard(x: str, y: str) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared >= SIMILARITY * (F.size(x) + F.size(y) - shared) - 1e-9


def _large_families(members: DataFrame, family: int) -> DataFrame:
    """The same for families of any size. A text near the middle of what is left is compared with all of the family; those it links leave what is left
    if it also links one that had left before (all of them, the first time). Every pair of texts in the end is linked through such ones, or one of the two is left: those meet the whole family in blocks."""
    key = ["family", *NODE]
    left, found = members.select(key), None
    for turn in range(PIVOTS):
        ones = [F.sum(F.shiftright(c, i).bitwiseAND(F.lit(1))).alias(f"{c}{i}") for c in ("fp", "more") for i in range(64)]
        bits = left.groupBy("family").agg(F.count("*").alias("n"), *ones)
        most = lambda c: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft((2 * F.col(f"{c}{i}") > F.col("n")).cast("long"), i) for i in range(64)])
        middle = materialise(bits.select("family", most("fp").alias("mf"), most("more").alias("mm")), "middle")
        apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("mf"))) + F.bit_count(F.col("more").bitwiseXOR(F.col("mm")))
        chosen = left.join(sized(middle), "family").groupBy("family").agg(F.min(F.struct(apart.alias("d"), *NODE)).alias("p")).select("family", "p.fp", "p.more", "p.mix")
        pivot = materialise(members.join(sized(materialise(chosen, "chosen")), key, "left_semi"), "pivots")
        pivot = pivot.select("family", *(F.col(c).alias(f"{c}1") for c in NODE), F.col("x").alias("px"))
        star = materialise(members.join(sized(pivot, FAMILY), "family").where(_jaccard("x", "px")).select("family", *(f"{c}1" for c in NODE), *(F.col(c).alias(f"{c}2") for c in NODE)), "star")
        found = star if found is None else found.unionAll(star)
        hit = star.select("family", *(F.col(f"{c}2").alias(c) for c in NODE))
        if turn:
            gone_before = hit.join(left, key, "left_anti").select("family").distinct()
            hit = hit.join(gone_before, "family", "left_semi")
        pivots = star.select("family", *(F.col(f"{c}1").alias(c) for c in NODE)).distinct()
        left = materialise(left.join(hit.unionAll(pivots), key, "left_anti"), "left")
        if left.isEmpty():
            break
    found = found.drop("family")
    if left.isEmpty():
        return found
    n_blocks = members.groupBy("family").agg(F.ceil(F.count("*") / family).cast("int").alias("mb"))
    n_left = left.groupBy("family").agg(F.ceil(F.count("*") / family).cast("int").alias("lb"))
    cuts = sized(materialise(n_left.join(n_blocks, "family"), "cuts"))
    deal = lambda n: F.pmod(F.xxhash64(*NODE), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = members.join(left, key, "left_semi").join(cuts, "family").select(*key, "x", deal("lb").alias("i"), every("mb").alias("j"))
    b = members.join(cuts, "family").select(*key, "x", every("lb").alias("i"), deal("mb").alias("j"))
    b = b.toDF(*b.columns)  # columns of their own

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([_pairs_table(np.zeros((3, 0), np.int64), np.zeros((3, 0), np.int64), [])])
        links = _alike(_sets(left["x"]), _sets(right["x"]))
        n, m = links.shape
        square = np.zeros((n + m, n + m), bool)
        square[:n, n:], square[n:, :n] = links, links.T
        nodes = np.concatenate([_keys(left), _keys(right)], axis=1)
        return pa.Table.from_batches([_pairs_table(nodes, nodes, _spanning(square))])

    keys = ["family", "i", "j"]
    return found.unionAll(a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(meet, _PAIR))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP, family: int = FAMILY) -> DataFrame:
    """doc_id and component_id of near copies: links are pairs whose sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

    A node is a set of shingles, known by 128 bits of its fingerprint and 64 of its hashes; copies share one. Rows without doc_id take no part.
    """
    docs = docs.where(F.col(key).cast("long").isNotNull())
    bits, segments = width(docs.count())
    each = materialise(sketches(docs, bits, segments, key, text), "sketches")
    nodes = materialise(each.groupBy(*NODE).agg(F.min("doc_id").alias("first"), F.first("segments").alias("segments")), "distinct")
    joined = connected_components(materialise(candidates(nodes, bits, group), "pairs"))
    named = materialise(nodes.select(*NODE, "first").join(joined.withColumnsRenamed({"node": "fp", "component": "family"}), "fp", "left").withColumn("family", F.coalesce("family", "fp")), "families")
    sizes = materialise(named.groupBy("family").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    named = materialise(named.join(sized(sizes), "family"), "members")
    # one text for each node (copies have the same shingles), whose shingles are made again: few documents are in families
    ids = materialise(named.select("first").distinct(), "ids")
    sets = shingled(docs.join(sized(ids), F.col(key).cast("long") == F.col("first"), "left_semi"), key, text)
    sets = materialise(sets, "shingles").withColumnRenamed("doc_id", "first")  # written: a join on mix would push its filters into the shingles
    sets = materialise(sets.join(sized(named), ["first", "mix"]).groupBy("family", "n", *NODE).agg(F.first("x").alias("x")), "sets")
    links = _small_families(sets.where(F.col("n") <= family).drop("n"))
    large = sets.where(F.col("n") > family).drop("n")
    if not large.isEmpty():
        links = links.unionAll(_large_families(large, family))
    links = materialise(links, "links").select(*(F.struct(*(F.col(f"{c}{k}").alias(c) for c in NODE)).alias(k2) for k, k2 in ((1, "a"), (2, "b"))))
    found = connected_components(links).select("node.*", "component").join(nodes.select(*NODE, "first"), NODE)
    lowest = found.groupBy("component").agg(F.min("first").alias("component_id"))
    of = materialise(found.join(lowest, "component").select(*NODE, "component_id"), "components")
    rest = each.select("doc_id", *NODE).join(sized(of), NODE, "left").join(nodes.select(*NODE, "first").hint("shuffle_hash"), NODE)
    return rest.select("doc_id", F.coalesce("component_id", "first").alias("component_id"))


def _named(each: DataFrame, distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that the links between fingerprints reach."""
    found = connected_components(linked)
    linked = found.join(distinct, found.node == distinct.fp)
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    named = linked.select("component", "fp").join(lowest, "component").select("fp", "lowest")
    whole = materialise(distinct.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")), "components")
    return each.join(whole, "fp").select("doc_id", "fp", "component_id")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id, with the input's columns; rows without doc_id stay.

    Few ids leave, so they are what the documents are joined with, once; rows that share a doc_id (of which one stays) are looked at only where there are any.
    """
    spark = docs.sparkSession
    with scratch(spark):
        found = near_components(docs, key, text, group).where("doc_id is not null")
        of = found.groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("_n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("_first"))
        of = materialise(of.where("_n > 1 or _first = 0"), "leaving", lasting=True)
    gone, repeated = of.where("_first = 0").select("_key"), of.where("_n > 1 and _first = 1").select("_key")
    k = F.col(key).cast("long")
    if repeated.isEmpty():
        return docs.join(sized(gone), k == F.col("_key"), "left_anti")
    once = docs.join(sized(of.select("_key")), k == F.col("_key"), "left_anti")
    return once.unionAll(docs.join(sized(repeated), k == F.col("_key"), "left_semi").dropDuplicates([key]))
