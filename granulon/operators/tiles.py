"""Tiles of an image volume over time: generated, looked up, overlapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def axis_count(size: int, tile: int, overlap: int) -> int:
    """Tiles along an axis so that neighbours overlap by at least so much."""
    return max(1, -(-(size - overlap) // (tile - overlap)))


def tiles(spark: SparkSession, size: dict[str, int], tile: dict[str, int], overlap: int, n_frames: int, z_gel: int) -> DataFrame:
    """hv (t slowest, then z, y, x), indices, material ('gel' for the first z_gel layers) and bounds, evenly spaced to cover the volume."""
    n = {c: axis_count(size[c], tile[c], overlap) for c in "xyz"}
    per = n["x"] * n["y"] * n["z"]
    index = {"x": f"hv % {n['x']}", "y": f"hv div {n['x']} % {n['y']}", "z": f"hv div {n['x'] * n['y']} % {n['z']}", "t": f"hv div {per}"}
    rows = spark.range(per * n_frames).select(F.col("id").alias("hv"), *(F.expr(f"cast({e} as int)").alias(c) for c, e in index.items()))
    start = lambda c: F.expr(f"cast(round({c} * {size[c] - tile[c]}D / {max(n[c] - 1, 1)}) as int)")
    rows = rows.withColumn("material", F.when(F.col("z") < z_gel, "gel").otherwise("sed"))
    return rows.withColumns({f"{c}0": start(c) for c in "xyz"}).withColumns({f"{c}1": F.col(f"{c}0") + tile[c] for c in "xyz"})


def of_time(rows: DataFrame, t: int, material: str) -> DataFrame:
    return rows.where((F.col("t") == t) & (F.col("material") == material)).select("hv")


def interface(rows: DataFrame, z_gel: int, cushion: int = 0) -> DataFrame:
    """Whether a tile touches the layers about the interface."""
    return rows.withColumn("interface", F.col("z").between(z_gel - 1 - cushion, z_gel + cushion))


def neighbours(rows: DataFrame) -> DataFrame:
    """The 26-neighbourhood of each tile within its time and material, as an equality join on shifted indices."""
    around = lambda c: F.explode(F.expr(f"sequence({c} - 1, {c} + 1)")).alias(c)
    a = rows.select(F.col("hv").alias("a"), "t", "material", "x", "y", "z")
    for c in "xyz":
        a = a.select("a", "t", "material", *(k for k in "xyz" if k != c), around(c))
    return a.join(rows.select(F.col("hv").alias("b"), "t", "material", "x", "y", "z"), ["t", "material", "x", "y", "z"]).where("a <> b").select("a", "b")


def overlaps(rows: DataFrame) -> DataFrame:
    """The common box of neighbouring tiles; boxes that touch count."""
    box = lambda k: rows.select(F.col("hv").alias(k), *(F.col(f"{c}{e}").alias(f"{k}{c}{e}") for c in "xyz" for e in "01"))
    both = neighbours(rows).where("a < b").join(box("a"), "a").join(box("b"), "b")
    both = both.select("a", "b", *(F.greatest(f"a{c}0", f"b{c}0").alias(f"{c}0") for c in "xyz"), *(F.least(f"a{c}1", f"b{c}1").alias(f"{c}1") for c in "xyz"))
    return both.where(" and ".join(f"{c}0 <= {c}1" for c in "xyz"))


def missing(submitted: DataFrame, done: DataFrame) -> DataFrame:
    return submitted.select("hv").join(done.select("hv"), "hv", "left_anti")


def leaf_array(rows: DataFrame, size: int = 10_000) -> DataFrame:
    return rows.withColumns({"leaf": F.expr(f"hv div {size}"), "array_id": F.col("hv") % size})


def lookup(rows: DataFrame, hv: int) -> DataFrame:
    """A tile's indices and bounds by its number."""
    return rows.where(F.col("hv") == hv)


def lookup_index(rows: DataFrame, x: int, y: int, z: int, t: int) -> DataFrame:
    """The number of the tile at an index."""
    return rows.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z) & (F.col("t") == t)).select("hv")


def training(rows: DataFrame, z_gel: int) -> DataFrame:
    """Tiles at the corners and the centre of the first and last frame, in the layers about the interface, with ``interface``."""
    ends = rows.agg(*(F.max(c).alias(f"_{c}") for c in "xyt"), F.min("t").alias("_first"))
    corner = lambda c: (F.col(c) == 0) | (F.col(c) == F.col(f"_{c}"))
    centre = lambda c: 2 * F.col(c) == F.col(f"_{c}")
    found = rows.crossJoin(F.broadcast(ends)).where((corner("x") & corner("y") | centre("x") & centre("y")) & F.col("t").isin(F.col("_first"), F.col("_t")))
    return interface(found, z_gel).where("interface").drop("_x", "_y", "_t", "_first")


def pixel_axis(spark: SparkSession, low: float, high: float, step: float) -> DataFrame:
    """Places low, low + step, ... below high."""
    n = max(0, -int(-(high - low) / step // 1))
    return spark.range(n).select((F.lit(float(low)) + F.col("id") * step).alias("place"))
