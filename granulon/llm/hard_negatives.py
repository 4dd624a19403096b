"""Hard negatives by norm-bucketed search: exact, for a stated set of anchors.

Rows are sorted into buckets by norm. By Cauchy-Schwarz no member of a bucket scores more than the anchor's norm times the bucket's greatest. Buckets are
searched in descending order of norm, in waves that double: after each wave every window (the score range of an anchor and one of its positives) has a running
k-th score, and an anchor goes on to a bucket only if its bound reaches, for one of its windows, both the window's lower limit and that score.
An anchor's positives are found by the same search over the buckets of its own label, with one window without limits.

Scale: at most ``BUCKETS`` buckets (quantiles of the norm), so a wave is one job and there are about log2 of them. A bucket is cut into blocks of about ``BLOCK`` rows
and the anchors that ask for it into blocks of as many: a pair of blocks is a matrix product in chunks, which returns at most k rows a window. So a vector or a label that a third of
all rows share makes more blocks, not larger ones.

Defined results: rows with a null id or label, a null or empty vector, or any null or non-finite component take no part; fully repeated rows count once; rows
that share an id but not the vector or label are different rows, and each other's candidates; vectors of different lengths are never compared;
ties go to the smaller id; fewer partners than asked give all of them; a negative positive score gives an empty window; an empty table gives an empty table.
Other columns are ignored. Scores are exact below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.llm.common import materialise, sized

BUCKETS, BUCKET, BLOCK, CHUNK = 4096, 4096, 8192, 512
HITS = "q long, no long, w int, vec_id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _columns(lists: list, gap: float) -> list[np.ndarray]:
    """Lists of different lengths by place; what is missing or null is ``gap``."""
    return [np.array([x[i] if i < len(x) and x[i] is not None else gap for x in lists], np.float64) for i in range(max(map(len, lists), default=0))]


def index(vectors: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", component=lambda e: F.floor(256 * e.cast("double"))) -> DataFrame:
    """(vec_id, no, label, v, dim, norm, bucket), written; ``no`` tells rows of one id apart, bucket 0 has the greatest norms."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.withColumn("_label", label.cast("long")).where(F.col(key).isNotNull() & F.col("_label").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col("_label").alias("label"), F.transform(vector, lambda e: component(e).cast("double")).alias("v")).distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    rows = materialise(rows.select("vec_id", F.xxhash64("label", "v").alias("no"), "label", "v", F.size("v").alias("dim"), norm.alias("norm")), "norms")
    n = min(BUCKETS, -(-rows.count() // BUCKET))
    if n < 2:
        return rows.withColumn("bucket", F.lit(0))
    edges = np.unique(rows.agg(F.percentile_approx("norm", [(i + 1) / n for i in range(n - 1)], 10 * n)).first()[0])

    def place(batches):
        for b in batches:
            at = len(edges) - np.searchsorted(edges, b.column(5).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "bucket"])

    return materialise(rows.mapInArrow(place, "vec_id long, no long, label long, v array<double>, dim int, norm double, bucket int"), "norm-index")


def search(rows: DataFrame, queries: DataFrame, k: int, same: bool, low: int = 0, high: int = 0, of: int = 1) -> DataFrame:
    """(q, no, w, vec_id, score): the k best rows for each window of each query, written.

    Queries are (q, no, label, v, dim, norm, windows). With ``same`` rows of the query's label are candidates but for its own, and there is one window without limits;
    else those of other labels, and window w takes scores s with low * p <= of * s <= high * p for p = windows[w].
    """
    cell = ["dim", "label", "bucket"] if same else ["dim", "bucket"]
    cuts = materialise(rows.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"), F.max("norm").alias("most")), "cuts")
    last = cuts.agg(F.max("bucket")).first()[0]

    def product(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of one block of rows for each window of one block of queries, if they reach the window's running score."""
        out: list[list] = [[], [], [], [], []]
        if len(left) and len(right):
            left = left.sort_by("vec_id")  # argmax takes the first of equals
            ids, own, labels, vectors = left["vec_id"].to_numpy(), left["no"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"]).T
            q, no, label, asking = right["q"].to_numpy(), right["no"].to_numpy(), right["label"].to_numpy(), _matrix(right["v"])
            windows, beats = _columns(right["windows"].to_pylist(), np.nan), _columns(right["beat"].to_pylist(), -np.inf)
            beats += [np.full(len(q), -np.inf)] * (len(windows) - len(beats))
            for a in range(0, len(q), CHUNK):
                part = slice(a, a + CHUNK)
                scores = asking[part] @ vectors
                alike = label[part, None] == labels[None, :]
                scores[~alike | ((q[part, None] == ids[None, :]) & (no[part, None] == own[None, :])) if same else alike] = -np.inf
                line = np.arange(len(scores))
                for w, (p, beat) in enumerate(zip(windows, beats, strict=True)):
                    some = scores.copy() if same else np.where((of * scores >= low * p[part, None]) & (of * scores <= high * p[part, None]), scores, -np.inf)
                    for _ in range(min(k, len(ids))):
                        best = some.argmax(1)
                        s = some[line, best]
                        ok = (s > -np.inf) & (s >= beat[part])
                        if not ok.any():
                            break
                        for x, y in zip(out, (q[part][ok], no[part][ok], np.full(ok.sum(), w, np.int32), ids[best[ok]], s[ok].astype(np.int64)), strict=True):
                            x.append(y)
                        some[line, best] = -np.inf
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds, strict=True)], names=["q", "no", "w", "vec_id", "score"])

    # what the least demanding window of a query asks for; a window whose limits are crossed asks for nothing
    asks = "greatest({}, coalesce(get(beat, i), double('-inf')))"
    limit = "double('-inf')" if same else f"{low}D * p / {of} - 1e-6"
    least = F.expr(f"array_min(transform(windows, (p, i) -> {asks.format(limit)}))")
    open_ = queries.withColumn("beat", F.expr("cast(array() as array<double>)"))
    found, at, width = None, 0, 1
    keys = [*cell, "vb", "qb"]
    order = W.partitionBy("q", "no", "w").orderBy(F.desc("score"), "vec_id")
    while at <= last:
        wave = cuts.where(F.col("bucket").between(at, at + width - 1))
        asked = open_.withColumn("least", least)
        if not same:
            asked = asked.where(F.exists("windows", lambda p: low * p <= high * p))
        reach = F.col("norm") * F.col("most") * (1 + 1e-9) + 1e-6 >= F.col("least")
        asked = asked.join(sized(wave), [c for c in cell if c != "bucket"]).where(reach).select("q", "no", asked["label"], "v", "windows", "beat", *(c for c in cell if c != "label"), "n_blocks")
        asked = materialise(asked, "asked")
        blocks = asked.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))
        cut = wave.join(blocks, cell).select(*cell, "n_blocks", "q_blocks")
        deal = lambda of_, c: F.pmod(F.xxhash64(F.lit(7), *of_), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = rows.join(sized(materialise(cut, "cut")), cell).select("vec_id", "no", "label", "v", *(c for c in cell if c != "label"), deal(["vec_id", "no"], "n_blocks").alias("vb"), every("q_blocks").alias("qb"))
        right = asked.join(sized(materialise(blocks, "blocks")), cell).select("q", "no", "label", "v", "windows", "beat", *(c for c in cell if c != "label"), every("n_blocks").alias("vb"), deal(["q", "no"], "q_blocks").alias("qb"))
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, HITS)
        hits = hits if found is None else found.unionAll(hits)
        found = materialise(hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"), "hits")
        at, width = at + width, 2 * width
        if at <= last:  # windows that are full carry their k-th score on
            full = found.groupBy("q", "no", "w").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") == k)
            by_window = full.groupBy("q", "no").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("_kth"))
            open_ = queries.join(by_window, ["q", "no"], "left").withColumn("beat", F.expr("transform(windows, (p, i) -> try_element_at(_kth, i))")).drop("_kth")
    return found


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, of: int = 100, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best ``positives`` rows of the same label,
    the k best rows of other labels whose score is between ``low`` and ``high`` ``of``-ths of the positive's. ``is_anchor`` is a condition on vec_id."""
    rows = index(vectors, label, **options)
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("q"), "no", "label", "v", "dim", "norm")
    anchors = materialise(anchors, "anchors")
    if anchors.isEmpty():
        return vectors.sparkSession.createDataFrame([], OUT)
    own = search(rows, anchors.withColumn("windows", F.array(F.lit(0).cast("long"))), positives, same=True)
    order = W.partitionBy("q", "no").orderBy(F.desc("score"), "vec_id")
    own = materialise(own.select("q", "no", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.row_number().over(order) - 1).alias("w")), "positives")
    windows = own.groupBy("q", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda s: s.positive_score).alias("windows"))
    found = search(rows, anchors.join(windows, ["q", "no"]), k, same=False, low=low, high=high, of=of)
    rank = F.row_number().over(W.partitionBy("q", "no", "w").orderBy(F.desc("score"), "vec_id"))
    found = found.join(own, ["q", "no", "w"]).withColumn("rank", rank)
    return found.select(F.col("q").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
