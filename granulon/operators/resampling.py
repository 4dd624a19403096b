"""Noisy replicates whose noise is a function of the row, not of where it is computed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noise(seed: int, key: list[str], axis: str, replicate: str = "replicate") -> Column:
    """A standard normal number for (seed, key, replicate, axis): two uniform numbers from the md5 of their text, by Box and Muller. Null keys count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key), F.col(replicate).cast("string"), F.lit(axis))
    part = lambda i: F.conv(F.substring(F.md5(text), i, 8), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((part(1) + 1) / 2.0**32)) * F.cos(2 * math.pi * part(9) / 2.0**32)


def resample(points: DataFrame, n: int, sigma: dict[str, float], seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """n noisy replicates of each row and the original as replicate 0; rows that share a key share their noise."""
    reps = points.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return reps.withColumns({c: F.when(F.col("replicate") == 0, F.col(c)).otherwise(F.col(c) + s * noise(seed, key or ["frame", "id"], c)) for c, s in sigma.items()})
