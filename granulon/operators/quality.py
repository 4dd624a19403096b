"""Quality control of counts and columns: fences, clips, distributions, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fences(rows: DataFrame, column: str, k: float = 1.5, by: list[str] | None = None) -> DataFrame:
    """The quartiles' fence of a column: low - k * IQR and high + k * IQR, a row for each group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    found = rows.groupBy(*(by or [])).agg(q.alias("q"))
    iqr = F.get("q", 1) - F.get("q", 0)
    return found.select(*(by or []), (F.get("q", 0) - k * iqr).alias("fence_low"), (F.get("q", 1) + k * iqr).alias("fence_high"))


def tukey_outliers(rows: DataFrame, column: str, by: list[str], k: float = 1.5) -> DataFrame:
    return rows.join(fences(rows, column, k, by), by).where((F.col(column) < F.col("fence_low")) | (F.col(column) > F.col("fence_high")))


def tukey_filter(rows: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Rows inside the fence of each column in turn; each fence is that of the rows left by the ones before."""
    for c in columns:
        rows = rows.crossJoin(F.broadcast(fences(rows, c, k))).where(F.col(c).between(F.col("fence_low"), F.col("fence_high"))).drop("fence_low", "fence_high")
    return rows


def sigma_clip(rows: DataFrame, column: str, sigmas: float = 4) -> DataFrame:
    """Rows with abs(x) <= mean + sigmas * std."""
    most = rows.agg((F.avg(column) + sigmas * F.stddev_samp(column)).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).where(F.abs(column) <= F.col("_most")).drop("_most")


def below_thresholds(rows: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """The share of rows below each threshold, in one aggregate over the rows."""
    shares = rows.agg(*(F.avg((F.col(column) < t).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)))
    return shares.select(F.expr(f"stack({len(thresholds)}, " + ", ".join(f"cast({t} as double), t{i}" for i, t in enumerate(thresholds)) + ") as (threshold, share)"))


def cumulative_histogram(rows: DataFrame, column: str, width: float) -> DataFrame:
    """Rows by bin, and the share of rows up to it; only bins enter the running sum."""
    bins = rows.groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count(F.col(column)).alias("_all"))
    return bins.crossJoin(F.broadcast(total)).select("bin", "n", (F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.col("_all")).alias("share"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*(F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs))
    return one.select(F.expr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs) + ") as (a, b, r)"))


def moments_by(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """count, min, max, mean, var, skewness and excess kurtosis by group."""
    return rows.groupBy(*by).agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), F.var_samp(column).alias("var"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurt"))


def count_change(counts: DataFrame, by: str = "particle", order: str = "frame", n: str = "n") -> DataFrame:
    """Change of a count from the row before, and relative to the count; null in a first row."""
    rows = counts.withColumn("delta", F.col(n) - F.lag(n).over(W.partitionBy(by).orderBy(order)))
    return rows.withColumn("relative", F.try_divide(F.col("delta"), F.col(n)))


def group_tiles(tiles: DataFrame) -> DataFrame:
    """The tiles of each place over time, in order."""
    return tiles.groupBy("x", "y", "z").agg(F.array_sort(F.collect_list("hv")).alias("hvs"))


def fill_high(rows: DataFrame, column: str, quantile: float = 0.999, factor: float = 1.1) -> DataFrame:
    """Null and NaN become factor times a high quantile."""
    value = F.nanvl(F.col(column), F.lit(None).cast("double"))
    high = rows.agg((factor * F.percentile(value, quantile)).alias("_fill"))
    return rows.crossJoin(F.broadcast(high)).withColumn(column, F.coalesce(value, F.col("_fill"))).drop("_fill")


def column_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, n (rows), nulls and distinct values of each listed column, in one pass; NaN counts as null."""
    missing = lambda c: F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False)) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c).isNull()
    one = rows.agg(F.count("*").alias("n"), *(F.count_if(missing(c)).alias(f"nulls_{i}") for i, c in enumerate(columns)), *(F.count_distinct(F.when(~missing(c), F.col(c))).alias(f"distinct_{i}") for i, c in enumerate(columns)))
    return one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"nulls_{i}").alias("nulls"), F.col(f"distinct_{i}").alias("distinct_values")) for i, c in enumerate(columns)))).alias("c")).select("c.name", "n", "c.nulls", "c.distinct_values")


def summary_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
