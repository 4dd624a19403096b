"""Least-squares planes and lines, robust slopes, and what is read off them."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from granulon.functions.tensor import eigenvalues
from granulon.operators.lineage import checkpointed


def plane_fit(rows: DataFrame, by: list[str]) -> DataFrame:
    """z = a x + b y + c by group, with residual (sum of squares), rank, singular values s (descending) and n; one aggregate."""
    cov = lambda u, v: (F.covar_pop(u, v)).alias(f"s{u}{v}")
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), *(cov(u, v) for u, v in ("xx", "xy", "yy", "xz", "yz", "zz")))
    m = m.withColumn("det", F.expr("sxx * syy - sxy * sxy"))
    m = m.withColumn("ok", F.expr("det > 1e-12 * greatest(sxx * syy, 1e-300)"))
    m = m.withColumns({"a": F.expr("if(ok, (sxz * syy - syz * sxy) / det, null)"), "b": F.expr("if(ok, (syz * sxx - sxz * sxy) / det, null)")})
    m = m.withColumn("c", F.expr("mz - a * mx - b * my"))
    gram = {"xx": "n * (sxx + mx * mx)", "xy": "n * (sxy + mx * my)", "xz": "n * mx", "yy": "n * (syy + my * my)", "yz": "n * my", "zz": "cast(n as double)"}
    s = F.transform(eigenvalues(*(F.expr(gram[k]) for k in ("xx", "xy", "xz", "yy", "yz", "zz"))), lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))
    return m.select(*by, "a", "b", "c", F.expr("greatest(n * (szz - a * sxz - b * syz), 0)").alias("residual"), F.expr("if(ok, 3, 2)").alias("rank"), s.alias("s"), "n")


def top_surface(rows: DataFrame, by: list[str], width: float) -> DataFrame:
    """A plane through the highest z of each square, at the square's centre."""
    cells = rows.groupBy(*by, F.floor(F.col("x") / width).alias("i"), F.floor(F.col("y") / width).alias("j")).agg(F.max("z").alias("z"))
    return plane_fit(cells.select(*by, ((F.col("i") + 0.5) * width).alias("x"), ((F.col("j") + 0.5) * width).alias("y"), "z"), by)


def plane_distance(rows: DataFrame, planes: DataFrame, by: list[str]) -> DataFrame:
    """Signed height over the plane of the row's group (planes are a small dimension, one row for each group)."""
    return rows.join(planes.select(*by, "a", "b", "c"), by).withColumn("dist", F.expr("z - (a * x + b * y + c)")).drop("a", "b", "c")


def below_highest(rows: DataFrame, by: list[str]) -> DataFrame:
    """``dist`` less the group's greatest."""
    most = rows.groupBy(*by).agg(F.max("dist").alias("_m"))
    return rows.join(most, by).withColumn("dist", F.col("dist") - F.col("_m")).drop("_m")


def gap(upper: DataFrame, lower: DataFrame, size: float, by: list[str]) -> DataFrame:
    """Between two planes: least, greatest and centre distance over the corners and centre of a square field."""
    p = upper.select(*by, *(F.col(k).alias(f"u{k}") for k in "abc")).join(lower.select(*by, *(F.col(k).alias(f"l{k}") for k in "abc")), by)
    at = lambda x, y: F.expr(f"(ua - la) * {x} + (ub - lb) * {y} + (uc - lc)")
    five = [at(0, 0), at(size, 0), at(0, size), at(size, size), at(size / 2, size / 2)]
    return p.select(*by, F.least(*five).alias("gap_min"), F.greatest(*five).alias("gap_max"), five[4].alias("gap_center"))


@lru_cache(maxsize=1000)
def t_quantile(df: int, p: float = 0.975) -> float:
    """Student's t quantile for whole degrees of freedom: the finite cosine series of its distribution, bisected (driver-side, a few values)."""

    def below(t: float) -> float:
        angle = math.atan(t / math.sqrt(df))
        c2, odd = math.cos(angle) ** 2, df % 2
        term = total = math.cos(angle) if odd else 1.0
        for k in range(2 + odd, df, 2):
            term *= c2 * (k - 1) / k
            total += term
        if odd:
            return 0.5 + (angle + (math.sin(angle) * total if df > 1 else 0.0)) / math.pi
        return 0.5 + math.sin(angle) * total / 2

    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def t_column(df: Column, p: float = 0.975, exact: int = 100) -> Column:
    """The quantile for a column of degrees of freedom: a table to ``exact``, beyond it the expansion about the normal quantile (error under 1e-10); null under 1."""
    z = NormalDist().inv_cdf(p)
    polynomials = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    far = sum((F.lit(x) / F.pow(df.cast("double"), F.lit(k)) for k, x in enumerate(polynomials, 1)), F.lit(z))
    return F.when(df > exact, far).when(df >= 1, F.element_at(F.array(*(F.lit(t_quantile(k, p)) for k in range(1, exact + 1))), F.least(F.greatest(df, F.lit(1)), F.lit(exact)).cast("int")))


def line_fit(rows: DataFrame, x: str, y: str, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Ordinary least squares by group: slope m, intercept b, their standard errors, and confidence bounds by Student's t of n - 2 degrees of freedom."""
    f = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("m"), F.regr_intercept(y, x).alias("b"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_avgx(y, x).alias("mx"), F.regr_count(y, x).alias("n"))
    f = f.withColumn("s2", F.expr("if(n > 2, greatest(syy - m * sxy, 0) / (n - 2), null)")).withColumn("t", t_column(F.col("n") - 2, (1 + confidence) / 2))
    f = f.withColumns({"se_m": F.expr("sqrt(s2 / sxx)"), "se_b": F.expr("sqrt(s2 * (1.0 / n + mx * mx / sxx))")})
    bounds = {"ci_lo": "m - t * se_m", "ci_hi": "m + t * se_m", "b_lo": "b - t * se_b", "b_hi": "b + t * se_b"}
    return f.select(*by, "m", "b", "se_m", "se_b", *(F.expr(e).alias(c) for c, e in bounds.items()), "n")


def theil_sen(rows: DataFrame, x: str, y: str, key: str, by: list[str], z: float = 1.959963984540054) -> DataFrame:
    """Median of pair slopes by group and median(y) - m median(x), with order-statistic bounds of the slope.

    The bounds are the slopes at (N -+ z sigma) / 2 of their N. A row without x or y is in no pair; ``key`` names the rows. No slope leaves the
    task that makes it: see ``_slopes_at``.
    """
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.median(x).alias("mx"), F.median(y).alias("my"))
    seen = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(key).alias("w"))
    blocks = _slope_blocks(seen, by)
    half = F.expr(f"{z} * sqrt(n * (n - 1) * (2 * n + 5) / 18.0)")
    place = lambda sign: F.least(F.greatest(F.round((F.col("pairs") + sign * half) / 2), F.lit(1.0)), F.col("pairs").cast("double")).cast("long")
    middle = [F.floor((F.col("pairs") + k) / 2).alias(f"rank{k}") for k in (1, 2)]

    def ranks(pairs: DataFrame) -> DataFrame:
        found = pairs.join(n.select(*by, "n"), by).select(*by, *middle, place(-1).alias("lo"), place(1).alias("hi"))
        return found.select(*by, F.expr("stack(4, 0, rank1, 1, rank2, 2, lo, 3, hi) as (which, rank)"))

    at = lambda k: F.max(F.when(F.col("which") == k, F.col("slope")))
    found = _slopes_at(blocks, by, ranks).groupBy(*by).agg(at(0).alias("_m0"), at(1).alias("_m1"), at(2).alias("ci_lo"), at(3).alias("ci_hi"))
    found = found.withColumn("m", F.col("_m0") * 0.5 + F.col("_m1") * 0.5)
    return found.join(n, by).select(*by, "m", (F.col("my") - F.col("m") * F.col("mx")).alias("b"), "ci_lo", "ci_hi", "n")


def _slope_blocks(points: DataFrame, by: list[str], size: int = 2_000) -> DataFrame:
    """Weighted points (by..., x, y, w) dealt so that each two of a group's slices meet in one block: (by..., _a, _b, x, y, w, _s)."""
    many = points.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("_k"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    dealt = points.join(many.withColumnsRenamed({c: f"_{c}" for c in by}), same) if by else points.crossJoin(many)
    dealt = dealt.withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.col("_k")).cast("int"))
    pair = "inline(transform(sequence(0, _k - 1), k -> named_struct('_a', least(k, _s), '_b', greatest(k, _s))))"
    return checkpointed(dealt.select(*by, "x", "y", "w", "_s", F.expr(pair)))


def _sorted_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of doubles: minus and plus zero are one, NaN is the greatest."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _slopes_at(blocks: DataFrame, by: list[str], ranks, bits: int = 16) -> DataFrame:
    """(by..., which, slope): exact order statistics of the weighted slopes between each two points with different x.

    Slopes are counted by the first ``bits`` of their order, then by the next ones of those that begin like a rank sought, and so on: four
    passes over the pairs, in which a task holds the slopes of one part of two slices and returns counts. ``ranks`` makes (by..., which, rank) of (by..., pairs).
    """
    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds + ', ' if by else ''}head long, part int, n long"
    low = np.uint64((1 << bits) - 1)

    def count(level: int):
        shift = np.uint64(64 - bits * (level + 1))

        def counts(group: pd.DataFrame) -> pd.DataFrame:
            heads = None if level == 0 else np.sort(np.asarray(group["_heads"].iloc[0], np.int64).view(np.uint64))
            a, b = group["_a"].iloc[0], group["_b"].iloc[0]
            p, q = group[group["_s"] == a], group[group["_s"] == b]
            px, py, pw, qx, qy, qw = (g[c].to_numpy() for g in (p, q) for c in ("x", "y", "w"))
            tally = np.zeros((1 if heads is None else len(heads), int(low) + 1), np.int64)
            step = max(1, 250_000 // max(1, len(qx)))
            for k in range(0, len(px), step):
                part = slice(k, k + step)
                with np.errstate(all="ignore"):
                    slope = (qy[None, :] - py[part, None]) / (qx[None, :] - px[part, None])
                use = (qx[None, :] != px[part, None]) & ~(np.isnan(qx)[None, :] & np.isnan(px[part, None]))
                if a == b:
                    use &= np.arange(len(qx))[None, :] > np.arange(len(px))[part, None]
                i, j = np.nonzero(use)
                order, w = _sorted_bits(slope[use]), pw[part][i] * qw[j]
                row = np.zeros(len(order), np.int64)
                if heads is not None:
                    head = order >> (shift + np.uint64(bits))
                    row = np.searchsorted(heads, head)
                    hit = (row < len(heads)) & (heads[np.minimum(row, len(heads) - 1)] == head)
                    order, w, row = order[hit], w[hit], row[hit]
                np.add.at(tally, (row, ((order >> shift) & low).astype(np.int64)), w)
            row, part = np.nonzero(tally)
            found = pd.DataFrame({"head": np.zeros(len(row), np.int64) if heads is None else heads.view(np.int64)[row], "part": part.astype("int32"), "n": tally[row, part]})
            for k, c in enumerate(by):
                found.insert(k, c, group[c].iloc[0])
            return found

        return counts

    same = lambda other: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in other]
    apart = lambda df: df.withColumnsRenamed({c: f"_{c}" for c in by})
    sought = None
    for level in range(64 // bits):
        rows = blocks
        if level:
            heads = apart(sought.groupBy(*by).agg(F.collect_set("head").alias("_heads")))
            rows = rows.join(heads, same(by)).select(*blocks.columns, "_heads")
        n = rows.groupBy(*by, "_a", "_b").applyInPandas(count(level), schema).groupBy(*by, "head", "part").agg(F.sum("n").alias("n"))
        n = checkpointed(n)
        if sought is None:
            sought = ranks(n.groupBy(*by).agg(F.sum("n").alias("pairs"))).withColumn("head", F.lit(0).cast("long"))
        upto = apart(n.withColumn("upto", F.sum("n").over(W.partitionBy(*by, "head").orderBy("part"))).withColumnRenamed("head", "_head"))
        # the rank is counted on among the slopes that begin alike
        hit = (F.col("head") == F.col("_head")) & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
        found = sought.join(upto, [*same(by), hit])
        sought = checkpointed(found.select(*by, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.expr(f"shiftleft(head, {bits}) | part").alias("head")))
    # back from the order to the double
    value = F.when(F.col("head") < 0, F.expr("head & 9223372036854775807L")).otherwise(F.expr("~head"))
    return sought.select(*by, "which", _as_double(value).alias("slope"))


@F.pandas_udf(DoubleType())
def _as_double(bits: pd.Series) -> pd.Series:
    return pd.Series(bits.to_numpy(dtype="int64").view("float64"))


def binned_median_fit(binned: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """A line through the medians of bins."""
    cells = binned.groupBy(*by, "bin", "bin_mid").agg(F.median(y).alias("_y"))
    return cells.groupBy(*by).agg(F.regr_slope("_y", "bin_mid").alias("m"), F.regr_intercept("_y", "bin_mid").alias("b"), F.count("*").alias("n"))
