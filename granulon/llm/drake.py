"""Centroid clustering of integer vectors by Lloyd rounds with Drake's adaptive bounds.

Each vector keeps an upper bound of the distance to its centroid, a lower bound for each of the next nearest centroids in order, and one lower bound
for all the rest. When centroids move, the bounds move with them. Where the upper bound stays under all lower ones the assignment is certified without
a distance; else the own distance is computed; else, if the rest is still certified, the listed centroids; else all are scanned. The number of
listed bounds shrinks to what the rounds turn out to need. Verdicts compare exact integers, bounds only ever save them, so the result is Lloyd's.

Scale: vectors never shuffle. A round reads the table of the round before (vectors and their bounds), writes the next, and the one before is deleted. What moved
between centroids is summed within tasks, so a round adds ``k`` rows a task; the sums of the centroids are kept by these differences. The centroids
(k x dimension integers, both parameters) are all that the driver and the tasks hold.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part; rows without id are clustered but never
start a centroid; rows that repeat an id are each clustered, and where ids repeat among the first centroids the smaller vector comes first;
fewer vectors than ``k`` give fewer centroids; ties go to the smaller number; an empty table gives an empty table. Distances are exact below 2^53.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.llm.common import delete, shared_path

STATE = "vec_id long, v array<long>, near array<int>, lower array<double>, upper double, was int, used int, distance long"


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid, exact integers below 2^53."""
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)


def scan(x: np.ndarray, centroids: np.ndarray, listed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From all distances: the nearest and the next ``listed`` centroids, their lower bounds and that of the rest (infinite if there is none), the nearest's distance."""
    d = squared(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
    far = np.sqrt(np.take_along_axis(d, order, 1))
    rest = far[:, listed + 1 : listed + 2] if d.shape[1] > listed + 1 else np.full((len(x), 1), np.inf)
    return order[:, : listed + 1].astype(np.int32), np.hstack([far[:, 1 : listed + 1], rest]), far[:, 0]


def reassign(x: np.ndarray, near: np.ndarray, lower: np.ndarray, upper: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Bounds and assignment after the centroids moved by ``drift``, in place; how many lower bounds each row needed (all of them and one for a full scan)."""
    listed = near.shape[1] - 1
    upper += drift[near[:, 0]]
    lower[:, :listed] -= drift[near[:, 1:]]
    lower[:, listed] -= drift.max()
    used = np.zeros(len(x), np.int32)
    reach = lambda rows: upper[rows] * (1 + 1e-9) + 1e-6
    at = np.arange(len(x))
    at = at[reach(at) >= lower.min(1)]
    own = centroids[near[at, 0]]
    upper[at] = np.sqrt(((x[at] - own) ** 2).sum(1))
    at = at[reach(at) >= lower[at].min(1)]
    sure = reach(at) < lower[at, listed]
    some, whole = at[sure], at[~sure]
    used[some], used[whole] = (lower[some, :listed] <= reach(some)[:, None]).sum(1), listed + 1
    if len(some):
        d = ((x[some][:, None, :] - centroids[near[some]]) ** 2).sum(2)
        order = np.lexsort((near[some], d), axis=1)
        near[some] = np.take_along_axis(near[some], order, 1)
        far = np.sqrt(np.take_along_axis(d, order, 1))
        upper[some], lower[some, :listed] = far[:, 0], far[:, 1:]
    if len(whole):
        near[whole], lower[whole], upper[whole] = scan(x[whole], centroids, listed)
    return used


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, salt: str = "3:", key: str = "vec_id", vector: str = "embedding", component=lambda e: F.floor(1024 * e.cast("double"))) -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, centroid_sha256, after ``rounds`` rounds and one more assignment.

    The first centroids are the k vectors with the smallest sha256 of ``salt`` and their id.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dimension)).where(finite)
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda e: component(e).cast("long")).alias("v"))
    first = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.float64).reshape(-1, dimension)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k, least = len(centroids), -(-len(centroids) // 8)
    listed = max(1, min(-(-k // 4), k - 1)) if k > 1 else 0
    sums, counts = np.zeros((k, dimension), object), np.zeros(k, object)
    state, path, drift = rows, None, None
    for turn in range(rounds + 1):
        step = _first(centroids, listed) if path is None else _next(centroids, drift, listed)
        last, path = path, shared_path(spark, "clusters")
        state.mapInArrow(step, STATE).write.parquet(path)
        if last:
            delete(spark, last)
        state = spark.read.schema(STATE).parquet(path)
        if turn == rounds:
            break
        for c, n, total in _moved(state, k):
            counts[c] += n
            sums[c] += np.array(total, object)
        after = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids, strict=True)], np.float64)
        drift = np.sqrt(((after - centroids) ** 2).sum(1)) * (1 + 1e-9)
        centroids = after
        if turn:
            most = state.agg(F.max("used")).first()[0] or 0
            listed = min(listed, max(least, most))
    found = state.select("vec_id", F.get("near", 0).alias("cluster"), "distance")
    of = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    print_of = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, d, sum(of.values()), print_of[c]) for c, d in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _table(vec_id, v, near, lower, upper, was, used, x, centroids) -> pa.RecordBatch:
    exact = ((x - centroids[near[:, 0]]) ** 2).sum(1).astype(np.int64)
    return pa.RecordBatch.from_arrays([vec_id, v, _lists(near), _lists(lower), pa.array(upper), pa.array(was, pa.int32(), from_pandas=False), pa.array(used), pa.array(exact)], names=[c.split()[0] for c in STATE.split(", ")])


def _first(centroids: np.ndarray, listed: int):
    def step(batches):
        for b in batches:
            if len(b):
                x = _matrix(b.column(1), np.float64)
                near, lower, upper = scan(x, centroids, listed)
                yield _table(b.column(0), b.column(1), near, lower, upper, np.full(len(x), -1, np.int32), np.zeros(len(x), np.int32), x, centroids)

    return step


def _next(centroids: np.ndarray, drift: np.ndarray, listed: int):
    def step(batches):
        for b in batches:
            if len(b):
                x, near, lower = _matrix(b.column(1), np.float64), _matrix(b.column(2), np.int32), _matrix(b.column(3), np.float64)
                if near.shape[1] > listed + 1:  # bounds that are listed no more join that of the rest
                    lower = np.hstack([lower[:, :listed], lower[:, listed:].min(1, keepdims=True)])
                    near = near[:, : listed + 1]
                near, lower, upper = near.copy(), lower.copy(), b.column(4).to_numpy().copy()
                was = near[:, 0].copy()
                used = reassign(x, near, lower, upper, centroids, drift)
                yield _table(b.column(0), b.column(1), near, lower, upper, was, used, x, centroids)

    return step


def _moved(state: DataFrame, k: int) -> list:
    """(centroid, rows, sums) by which the centroids' sums change: the rows that came less those that left, summed within tasks first."""

    def total(batches):
        n, sums = np.zeros(k, np.int64), None
        for b in batches:
            if len(b):
                x, to, was = _matrix(b.column(0), np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()
                sums = np.zeros((k, x.shape[1]), np.int64) if sums is None else sums
                for c in range(k):
                    sums[c] += x[to == c].sum(0) - x[was == c].sum(0)
                    n[c] += (to == c).sum() - (was == c).sum()
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), _lists(sums)], names=["c", "n", "sums"])

    moved = state.where(F.get("near", 0) != F.col("was")).select("v", F.get("near", 0), "was")
    parts = moved.mapInArrow(total, "c int, n long, sums array<long>").select("c", "n", F.posexplode("sums").alias("i", "s"))
    found = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # k x dimension rows
    out: dict = {}
    for r in sorted(found, key=lambda r: (r["c"], r["i"])):
        out.setdefault(r["c"], (r["n"], []))[1].append(r["s"])
    return [(c, n, s) for c, (n, s) in out.items()]
