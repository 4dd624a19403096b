"""Which rows: channel predicates, partition labels, key sets, and the tables that XYZ files of an experiment are written from.

The tables here go to ``sources.tables.write_xyz``, which writes one folder for each frame.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.operators.frames import complete_ids, of_ids

#: Microns in a pixel by axis, of the pixel-to-micron converter.
MICRONS = {"x": 0.115, "y": 0.115, "z": 0.15}


def is_tracer(background: str = "background", tracer: str = "tracer", chunk: str | None = None) -> Column:
    """A location of a gel tracer: its channel (with that of chunks, if given) is over the background's."""
    signal = F.col(tracer) if chunk is None else F.col(tracer) + F.col(chunk)
    return signal > F.col(background)


def is_sediment(core: str = "colloid_core", chunk: str = "chunk_core") -> Column:
    return F.col(core) > F.col(chunk)


def not_colloid(chunk: str = "chunk", tracer: str = "tracer", colloid: str = "colloid") -> Column:
    """Either of two channels is over the colloids'; the complement is ``~`` of it, null where a channel is."""
    return (F.col(chunk) > F.col(colloid)) | (F.col(tracer) > F.col(colloid))


def clip(rows: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows whose columns lie strictly inside fixed ranges; an end of None is open, a null value is outside."""
    for c, (low, high) in ranges.items():
        rows = rows if low is None else rows.where(F.col(c) > low)
        rows = rows if high is None else rows.where(F.col(c) < high)
    return rows


def columns_like(rows: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    """The keys, and the columns whose names a regular expression finds."""
    return rows.select(*keys, *(c for c in rows.columns if c not in keys and re.search(pattern, c)))


def step_kind(step: Column) -> Column:
    """'imageStack' or 'refStack', from a step's name such as a_imageStack_f1."""
    return F.when(F.get(F.split(step, "_"), 1) == "imageStack", "imageStack").otherwise("refStack")


def common_ids(*sets: DataFrame) -> DataFrame:
    """Particles that all of the sets have."""
    out = sets[0].select("particle")
    for s in sets[1:]:
        out = out.intersect(s.select("particle"))
    return out.distinct()


def partitions(rows: DataFrame, upper: DataFrame, lower: DataFrame, highest: float, dist: str = "dist") -> DataFrame:
    """``partition``: upper or lower of the sediment's boundary sets (upper wins), triangle for its other rows further than ``highest``, else bulk."""
    flag = lambda s, name: s.select("particle").distinct().withColumn(name, F.lit(True))
    found = rows.join(flag(upper, "_u"), "particle", "left").join(flag(lower, "_l"), "particle", "left")
    sed = F.col("material") == "sed"
    label = F.when(sed & F.col("_u"), "upper").when(sed & F.col("_l"), "lower").when(sed & (F.col(dist) > highest), "triangle").otherwise("bulk")
    return found.withColumn("partition", label).drop("_u", "_l")


def single_frame(rows: DataFrame, frame: int) -> DataFrame:
    """A file of one frame as rows with its number."""
    return rows.withColumn("frame", F.lit(frame).cast("long"))


def in_microns(rows: DataFrame, scale: dict[str, float] | None = None) -> DataFrame:
    return rows.withColumns({c: F.col(c) * k for c, k in (scale or MICRONS).items()})


def displacement_series(tracks: DataFrame, ref: int = 0) -> DataFrame:
    """Positions, displacements from the reference frame, and their angle ratio dy / dx, by frame; only particles that the reference has."""
    first = tracks.where(F.col("frame") == ref).select("particle", *(F.col(c).alias(f"{c}0") for c in "xyz"))
    rows = tracks.join(first, "particle").select("frame", "particle", "x", "y", "z", *((F.col(c) - F.col(f"{c}0")).alias(f"d{c}") for c in "xyz"))
    return rows.withColumn("theta", F.try_divide("dy", "dx"))


def cleaned_series(tracks: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Positions of the (frame, particle) keys of a cleaned set."""
    return tracks.join(keys.select("frame", "particle").distinct(), ["frame", "particle"], "left_semi").select("frame", "particle", *columns)


def complete_series(tracks: DataFrame, only: list[int] | None = None) -> DataFrame:
    """Trajectories seen in every frame; at some frames only (such as the first and last) or at all."""
    n = tracks.agg(F.count_distinct("frame")).first()[0]
    rows = of_ids(tracks, complete_ids(tracks, n))
    return rows if only is None else rows.where(F.col("frame").isin(only))


def complete_or_dropped(tracks: DataFrame, ref: int, cur: int) -> DataFrame:
    """The reference frame's rows with ``flag``: complete if the current frame has the particle too, else incomplete."""
    later = tracks.where(F.col("frame") == cur).select("particle", F.lit(True).alias("_in")).distinct()
    rows = tracks.where(F.col("frame") == ref).join(later, "particle", "left")
    return rows.withColumn("flag", F.when(F.col("_in"), "complete").otherwise("incomplete")).drop("_in")


def constant(rows: DataFrame, name: str = "volume", value: float | None = None, diameter: float = 2.043) -> DataFrame:
    """The same value in every row: by default the volume of a sphere of the particles' diameter."""
    return rows.withColumn(name, F.lit(3.141592653589793 * diameter**3 / 6 if value is None else value))
