"""Quality classifier learned from trusted positives and unlabelled documents (non-negative PU risk).

A document's statistics are cut into quantile bins, and the score is a sum of one weight for each statistic's bin. With the squared
loss the PU risk, prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), depends on the data only through the mean and second moments of the
bin indicators among the positives and the unlabelled. Those are sums over *all* rows, merged in a tree, of a size that is fixed
by the number of bins; so the risk of the whole corpus is minimised exactly, on the driver, without a sample. Texts are read once.

The class prior is estimated from the same two sets, halved: on one half a first classifier of positives against unlabelled orders
the documents; on the other, the prior is the least ratio, over the upper tails of that order that hold nine tenths of the positives,
of the unlabelled share to the positive share (never below the true prior but for chance, of which three standard errors are added).

Labels of 0 are never read. Rows whose fold is held out (crc32 of the key's text, modulo 3, is 1) take no part in learning.
Defined results: a null or empty text has all statistics zero and is scored like any other; a null key is in no fold and unlabelled; repeated rows
each count and are scored; positives with contradicting labels are not trusted; without positives every score is 0.5 (accepted).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import materialise, scratch, which, without
from granulon.llm.quality_rules import one_label, statistics

FEATURES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "exclaim_rate": ("n_exclaim", "n_words"), "distinct_share": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines"),
}
BINS, TREE = 8, 16
#: Ridge for n positives.
RIDGE = lambda n: 1e-4 + 20 / n


def held_out(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` and the statistics as doubles; a ratio to nothing is 0."""
    ratio = lambda a, b: F.col(a).cast("double") if b is None else F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return statistics(docs, text).select("_row", *(ratio(a, b).alias(f) for f, (a, b) in FEATURES.items()))


def _bin(f: str, edges: list[float]) -> Column:
    return sum(((F.col(f) > x).cast("int") for x in edges), F.lit(0))


class PuModel:
    """Weights by statistic and bin; ``margin`` is over 0 for documents more likely positive."""

    def __init__(self, edges: dict[str, list[float]], weights: dict[str, list[float]], bias: float, prior: float | None):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def margin(self) -> Column:
        return sum((F.element_at(F.array(*map(F.lit, self.weights[f])), _bin(f, x) + 1) for f, x in self.edges.items()), F.lit(self.bias))

    def score(self) -> Column:
        return F.lit(0.5) if self.prior is None else 1 / (1 + F.exp(-4 * self.margin()))


def _moments(binned: DataFrame, sizes: list[int]) -> np.ndarray:
    """Sum of x x' of the indicators x (a constant first) for each kind (0 to 3), over all rows of (kind, bins...)."""
    width = 1 + sum(sizes)
    starts = np.cumsum([1, *sizes[:-1]])

    def sums(batches):
        total = np.zeros((4, width, width))
        for b in batches:
            kind = b.column(0).to_numpy()
            at = np.stack([b.column(i + 1).to_numpy() + starts[i] for i in range(len(sizes))], axis=1)
            for k in range(4):
                x = np.zeros((int((kind == k).sum()), width))
                x[:, 0] = 1
                np.put_along_axis(x, at[kind == k], 1, axis=1)
                total[k] += x.T @ x
        # a task that runs again sends its sums to the same branch
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["branch", "total"])

    def merge(to: tuple, group: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x, np.float64) for x in group["total"].to_pylist())
        return pa.table({"branch": pa.array([to[0].as_py()], pa.int32()), "total": pa.array([whole.tobytes()])})

    kind = "branch int, total binary"
    parts = materialise(binned.mapInArrow(sums, kind), "moments")
    left = (parts.agg(F.max("branch")).first()[0] or 0) + 1
    while left > TREE:  # TREE sums at a time, in as many levels as there are tasks for
        parts = materialise(parts.groupBy(F.floor(F.col("branch") / TREE).cast("int").alias("to")).applyInArrow(merge, kind), "moments")
        left = -(-left // TREE)
    total = np.zeros((4, width, width))
    for r in parts.orderBy("branch").collect():  # TREE rows at most
        total += np.frombuffer(r["total"], np.float64).reshape(total.shape)
    return total


def _times(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A small product on the driver, without the threads of a linear-algebra library."""
    return np.einsum("ij,j->i", m, w)


def solve(m: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """m x = b for a positive definite m, by conjugate gradients scaled by m's diagonal."""
    x, r, scale = np.zeros(len(b)), b.copy(), 1 / np.diag(m)
    z = d = scale * r
    for _ in range(steps):
        if np.abs(r).max() < 1e-10:
            break
        md = _times(m, d)
        step = (r * z).sum() / (d * md).sum()
        x, new = x + step * d, r - step * md
        new_z = scale * new
        d = new_z + (new * new_z).sum() / (r * z).sum() * d
        r, z = new, new_z
    return x


def minimise(p: np.ndarray, u: np.ndarray, prior: float, penalty: float, steps: int = 300) -> np.ndarray:
    """Weights of least non-negative risk, from the second-moment matrices (their first row is the mean)."""
    # without the bound at zero the risk is quadratic: its minimum is where the descent starts
    w = best = solve(u + penalty * np.eye(len(u)), 2 * prior * p[0] - u[0])
    loss = lambda w, s, m: (1 + 2 * s * (w * m[0]).sum() + (w * _times(m, w)).sum()) / 4
    negative = lambda w: loss(w, 1, u) - prior * loss(w, 1, p)
    risk = lambda w: prior * loss(w, -1, p) + max(0.0, negative(w)) + penalty * (w * w).sum() / 4
    if negative(w) >= 0:
        return w
    scale = 1 / (np.diag(u) + prior * np.diag(p) + penalty)
    for k in range(steps):
        part = (u[0] + _times(u, w) - prior * (p[0] + _times(p, w))) / 2
        # below zero the part can only be over-fitted: step back from it alone
        grad = -part if negative(w) < 0 else prior * (_times(p, w) - p[0]) / 2 + part + penalty * w / 2
        w = w - scale * grad / (1 + k / 30) / len(w) ** 0.5
        best = w if risk(w) < risk(best) else best
    return best


def learn(rows: DataFrame) -> PuModel:
    """From the statistics, ``half`` (for the prior) and ``positive`` (trusted) of the rows to learn from, all of which are the unlabelled set."""
    names = list(FEATURES)
    at = [(k + 1) / BINS for k in range(BINS - 1)]
    cuts = rows.groupBy("positive").agg(*(F.percentile_approx(f, at, 1000).alias(f) for f in names)).collect()
    if not any(r["positive"] for r in cuts):
        return PuModel({}, {}, 0.0, None)
    edges = {f: sorted({x for r in cuts for x in r[f]}) for f in names}
    sizes = [len(edges[f]) + 1 for f in names]
    kinds = _moments(rows.select((2 * F.col("half").cast("int") + F.col("positive").cast("int")).alias("kind"), *(_bin(f, edges[f]).alias(f) for f in names)), sizes)
    mean = lambda m: m / max(m[0, 0], 1)
    half_p, half_u = mean(kinds[3]), mean(kinds[2] + kinds[3])
    p, u, n_p, n_u = mean(kinds[1] + kinds[3]), mean(kinds.sum(0)), kinds[1, 0, 0] + kinds[3, 0, 0], kinds.sum(0)[0, 0]
    penalty = RIDGE(n_p)

    def model(w: np.ndarray, prior: float) -> PuModel:
        ends = np.cumsum([1, *sizes])
        return PuModel(edges, {f: w[a:b].tolist() for f, a, b in zip(names, ends, ends[1:], strict=False)}, float(w[0]), prior)

    # positives against unlabelled, in equal weight, orders the documents of the other half for the prior
    first = model(solve(half_p + half_u + 4 * penalty * np.eye(len(p)), half_p[0] - half_u[0]), 0.5)
    tails = rows.where("not half").groupBy(F.round(200 * first.margin()).cast("int").alias("b")).agg(F.count("*").alias("u"), F.count(F.when(F.col("positive"), 1)).alias("p")).orderBy(F.desc("b")).collect()  # as many rows as steps of 1/200
    prior, up, pp = 1.0, 0, 0
    other_u, other_p = max(1, sum(r["u"] for r in tails)), max(1, sum(r["p"] for r in tails))
    for r in tails:
        up, pp = up + r["u"], pp + r["p"]
        if pp >= 0.9 * other_p > 0:
            ratio = (up / other_u) / (pp / other_p)
            prior = min(prior, ratio * (1 + 3 * ((1 - pp / other_p) / pp) ** 0.5))
    found = model(minimise(p, u, prior, penalty), prior)
    # the weights order the documents; where to cut is the least PU risk of the 0/1 loss
    steps = rows.groupBy(F.floor(200 * found.margin()).cast("int").alias("b")).agg(F.count("*").alias("u"), F.count(F.when(F.col("positive"), 1)).alias("p")).orderBy("b").collect()
    risks, below_u, below_p = [], 0, 0
    for r in steps:
        risks.append((prior * below_p / n_p + max(0.0, (1 - below_u / n_u) - prior * (1 - below_p / n_p)), r["b"] / 200))
        below_u, below_p = below_u + r["u"], below_p + r["p"]
    least = [t for x, t in risks if x <= min(risks)[0] + 1 / n_u]
    found.bias -= (least[0] + least[-1]) / 2
    return found


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``_row`` (the key), ``_t`` (two hashes that say which text), held_out, score and predicted."""
    stats = features(docs.select(key, text), text).select(F.struct(F.col(f"_row.{key}")).alias("_row"), which(f"_row.{key}", f"_row.{text}").alias("_t"), *FEATURES)
    stats = materialise(stats, "features").withColumn("held_out", held_out(f"_row.{key}"))
    trusted = one_label(labels, key, label).where("_label = 1").select("_key")
    half = F.coalesce(F.pmod(F.crc32(F.col(f"_row.{key}").cast("string")), F.lit(3)) == 0, F.lit(False))
    rows = stats.where("not held_out").select(F.col(f"_row.{key}").alias("_id"), half.alias("half"), *FEATURES)
    rows = rows.join(trusted, F.col("_id") == F.col("_key"), "left").select(F.col("_key").isNotNull().alias("positive"), "half", *FEATURES)
    return stats.withColumn("score", learn(materialise(rows, "learn")).score()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The accepted documents, with the input's columns: few leave, so those are what the documents are joined with."""
    with scratch(docs.sparkSession):
        gone = materialise(judge(docs, labels, key, text).where("predicted = 0").select("_t.*").distinct(), "rejected", lasting=True)
    return without(docs, gone, key, text)
