"""Exact top-k by inner product, with a pivot-distance index.

Vectors get one more component that gives all of them the same norm, so the largest inner product is the smallest distance. Each
is keyed by its nearest pivot and by the ring of its distance to it; such an annulus knows its least and greatest distance. By the triangle
inequality no member is closer to a query than the query's distance to the pivot less the greatest, or the least less it, which
bounds the score from above. A query first expands its best annuli until they hold k vectors, which gives a score to beat; it then
expands those others, and only those, whose bound reaches that score, and stops. The result is exact.

Scale: pivots are a sample that grows with the root of the rows (to ``PIVOTS``), and rings are quantiles, so annuli hold about as many vectors each and their
statistics are a small table. Annuli are cut into blocks of about ``BLOCK`` vectors and the queries that expand one into blocks of as many, so a vector is
sent once for each ``BLOCK`` queries that ask for it; a pair of blocks is a matrix product in chunks, so a vector that repeats in a third of all rows makes more blocks, not a larger one. In a block only scores that can
still win are returned.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without id; rows that repeat id and
vector count once; rows that share an id but not the vector are each a candidate, and each a query with its own ranks under the one id; vectors of different lengths are never compared; ties go to the smaller id; a query with fewer partners returns all of them. Scores
are exact while they and the squared norms stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.llm.common import materialise

PIVOTS, RINGS, BLOCK, CHUNK = 4096, 8, 8192, 512
HITS = "query_id long, query_no long, vec_id long, score long"


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", component=lambda e: e.cast("double")) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows. ``component`` maps a component to the integer value it counts as."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), is_query.alias("q"), F.transform(vector, component).alias("v")).distinct()
    rows = materialise(rows.withColumn("dim", F.size("v")), "vectors")
    found = None
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("norm2")).orderBy("dim").collect():
        one = _same_length(rows.where(F.col("dim") == r["dim"]).drop("dim"), k, r["n"], r["norm2"])
        found = one if found is None else found.unionAll(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _same_length(rows: DataFrame, k: int, n: int, norm2: float) -> DataFrame:
    """The hits (query_id, query_no, vec_id, score) among which each query's k best are."""
    spark = rows.sparkSession
    most = int(min(PIVOTS, max(4, round(n**0.5 / 16))))  # grows with the rows; PIVOTS bounds what every task holds
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").collect()

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0))[:, None]])

    pivots = lifted(np.array([r["v"] for r in sample], np.float64))
    def place(batches):
        for b in batches:
            d = _distances(lifted(_matrix(b.column(1))), pivots)
            cell = d.argmin(1)
            d = d[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d)], names=["vec_id", "v", "cell", "d"])

    placed = materialise(rows.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, cell int, d double"), "placed")
    # rings hold as many vectors each: cut at quantiles of the distances about each pivot, a row for each
    rings = placed.groupBy("cell").agg(F.percentile_approx("d", [(i + 1) / RINGS for i in range(RINGS - 1)], 1000).alias("_at"))
    ring = F.aggregate("_at", F.lit(0), lambda s, x: s + (F.col("d") > x).cast("int"))
    index = placed.join(F.broadcast(rings), "cell").select("vec_id", "v", (F.col("cell") * RINGS + ring).alias("annulus"), "d")
    index = materialise(index, "index")
    annuli = index.groupBy("annulus").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).orderBy("annulus").collect()
    number, size = np.array([a["annulus"] for a in annuli]), np.array([a["n"] for a in annuli])
    low, high = np.array([a["low"] for a in annuli]), np.array([a["high"] for a in annuli])
    slack = 1e-9 * (1 + 4 * norm2)

    def bounds(q: np.ndarray) -> np.ndarray:
        """The best score that each annulus can hold for each query (a query's own last component is zero)."""
        flat = np.hstack([q, np.zeros((len(q), 1))])
        d = _distances(flat, pivots)[:, number // RINGS]
        gap = np.maximum(np.maximum(d - high, low - d) - 1e-7 * (1 + d), 0)
        return ((q**2).sum(1)[:, None] + norm2 - gap**2) / 2 + slack

    def seed(batches):
        for b in batches:
            u = bounds(_matrix(b.column(2)))
            order = np.argsort(-u, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1) - size[order]
            yield expand(b, u, [o[h <= k] for o, h in zip(order, held, strict=True)], np.full(len(u), -np.inf))

    def rest(batches):
        for b in batches:
            q, beat = _matrix(b.column(2)), b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            u = bounds(q)
            order = np.argsort(-u, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1) - size[order]
            beat = np.where(np.isnan(beat), -np.inf, beat)
            yield expand(b, u, [o[(h > k) & (x[o] >= t)] for o, h, x, t in zip(order, held, u, beat, strict=True)], beat)

    def expand(b, u, chosen, beat):
        count = [len(x) for x in chosen]
        take = pa.array(np.repeat(np.arange(len(u)), count))
        at = np.concatenate(chosen).astype(np.int64) if chosen else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(np.repeat(beat, count)), pa.array(number[at].astype(np.int32))], names=["query_id", "query_no", "v", "beat", "annulus"])

    def product(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The best k of one block of vectors for each of one block of queries, if they reach the score to beat."""
        names = ["query_id", "query_no", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        ids = left["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # argmax takes the first of equals
        ids = ids[order]
        vectors, asking = _matrix(left["v"])[order].T, _matrix(right["v"])
        whose, number, floor = (right[c].to_numpy() for c in ("query_id", "query_no", "beat"))
        out = []
        for first in range(0, len(whose), CHUNK):
            mine, beat = whose[first : first + CHUNK], floor[first : first + CHUNK]
            scores = asking[first : first + CHUNK] @ vectors
            scores[mine[:, None] == ids[None, :]] = -np.inf
            line = np.arange(len(mine))
            for _ in range(min(k, len(ids))):
                best = scores.argmax(1)
                s = scores[line, best]
                ok = (s > -np.inf) & (s >= beat)
                out.append((mine[ok], number[first : first + CHUNK][ok], ids[best[ok]], s[ok].astype(np.int64)))
                scores[line, best] = -np.inf
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    blocks = spark.createDataFrame([(int(a), int(-(-c // BLOCK))) for a, c in zip(number, size, strict=True)], "annulus int, n_blocks int")

    def score(assigned: DataFrame) -> DataFrame:
        assigned = materialise(assigned, "assigned")
        asked = assigned.groupBy("annulus").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))  # a row for each annulus
        cuts = F.broadcast(blocks.join(F.broadcast(asked), "annulus"))
        deal = lambda of, c: F.pmod(F.xxhash64(F.lit(7), *of), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = index.join(cuts, "annulus").select("vec_id", "v", "annulus", deal(["vec_id", "v"], "n_blocks").alias("vb"), every("q_blocks").alias("qb"))
        right = assigned.join(cuts, "annulus").select("query_id", "query_no", "v", "beat", "annulus", every("n_blocks").alias("vb"), deal(["query_id", "query_no"], "q_blocks").alias("qb"))
        keys = ["annulus", "vb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, HITS)

    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_no"), "v")
    expanded = "query_id long, query_no long, v array<double>, beat double, annulus int"
    first = materialise(score(queries.mapInArrow(seed, expanded)), "seeds")
    order = W.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    beat = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", "query_no", F.col("score").cast("double").alias("beat"))
    more = score(queries.join(beat, ["query_id", "query_no"], "left").select("query_id", "query_no", "v", "beat").mapInArrow(rest, expanded))
    return first.unionAll(more)
