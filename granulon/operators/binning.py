"""Intervals and statistics by interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_width(rows: DataFrame, column: str, n: int, by: list[str] | None = None) -> DataFrame:
    """``bin`` (1 to n) and ``bin_mid`` of n equal right-closed intervals over the range (of each group); one range row for each group."""
    ends = rows.groupBy(*(by or [])).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))
    w = (F.col("_hi") - F.col("_lo")) / n
    b = F.least(F.greatest(F.ceil(F.try_divide(F.col(column) - F.col("_lo"), w)), F.lit(1)), F.lit(n)).cast("long")
    return joined.withColumn("bin", F.coalesce(b, F.lit(1))).withColumn("bin_mid", F.col("_lo") + (F.col("bin") - 0.5) * w).drop("_lo", "_hi")


def fixed(column: Column, width: float, low: float, high: float) -> Column:
    """1, 2, ... of right-closed intervals over (low, high]; null outside."""
    return F.when((column > low) & (column <= high), F.ceil((column - low) / width).cast("long"))


def listed(column: Column, intervals: list[tuple[float, float]]) -> Column:
    """The number of the first listed interval (left, right] that holds a value; null if none does."""
    out = F.lit(None).cast("long")
    for k, (a, b) in reversed(list(enumerate(intervals))):
        out = F.when((column > a) & (column <= b), F.lit(k).cast("long")).otherwise(out)
    return out


def interface_intervals(edges: list[float]) -> list[tuple[float, float]]:
    """Five wide intervals below and above an interface, and one of width one about it."""
    return [(-x - 5.5, -x - 0.5) for x in edges] + [(-0.5, 0.5)] + [(x + 0.5, x + 5.5) for x in edges]


def describe(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max by group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"), q.alias("q"), F.max(column).alias("high"))
    return found.select(*by, "n", "mean", "std", "low", *(F.get("q", k).alias(f"q{25 * (k + 1)}") for k in range(3)), "high")


def heat_map(moved: DataFrame, width: float, size: float, values: list[str], by: list[str]) -> DataFrame:
    """Mean values and counts by group and square of x and y."""
    rows = moved.withColumns({"x_bin": fixed(F.col("x"), width, 0, size), "y_bin": fixed(F.col("y"), width, 0, size)}).where("x_bin is not null and y_bin is not null")
    return rows.groupBy(*by, "x_bin", "y_bin").agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))


def material_residual(cells: DataFrame, value: str) -> DataFrame:
    """Of two materials' maps: sediment less gel where both have the square."""
    side = lambda m: cells.where(F.col("material") == m).select("frame", "x_bin", "y_bin", F.col(value).alias(m))
    return side("sed").join(side("gel"), ["frame", "x_bin", "y_bin"]).withColumn("residual", F.col("sed") - F.col("gel"))
