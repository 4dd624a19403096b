"""Trajectories as rows of (frame, particle, ...): alignment, id sets, displacement, reshaping, frame indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def frame_scan(tracks: DataFrame, frames: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of some frames; on a table partitioned by frame the predicate prunes folders."""
    rows = tracks if frames is None else tracks.where(F.col("frame").isin(frames))
    return rows if columns is None else rows.select(*columns)


def kept(tracks: DataFrame, types: dict[str, str], flag: str = "keep") -> DataFrame:
    """The flagged rows, with the columns that ``types`` and the table share cast."""
    return tracks.where(F.col(flag)).select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in tracks.columns))


def at_steps(tracks: DataFrame, step_frames: DataFrame) -> DataFrame:
    """Rows of (step, frame_local) keys by way of the step table (step, frame, frame_local), a small dimension."""
    return tracks.join(step_frames, "frame")


def complete_pairs(tracks: DataFrame, ref: int, cur: int) -> DataFrame:
    """Particles in both frames, with the positions in each."""
    side = lambda k, s: tracks.where(F.col("frame") == k).select("particle", *(F.col(c).alias(f"{c}_{s}") for c in XYZ))
    return side(ref, "ref").join(side(cur, "cur"), "particle")


def dropped_ids(tracks: DataFrame, ref: int, cur: int) -> DataFrame:
    """Particles of the reference frame that the current one lacks."""
    ids = lambda k: tracks.where(F.col("frame") == k).select("particle")
    return ids(ref).join(ids(cur), "particle", "left_anti").distinct()


def complete_ids(tracks: DataFrame, n_frames: int) -> DataFrame:
    """Particles seen in every one of the frames."""
    return tracks.groupBy("particle").agg(F.count_distinct("frame").alias("n")).where(F.col("n") == n_frames).select("particle")


def of_ids(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    return tracks.join(ids.select("particle"), "particle", "left_semi")


def frame_pairs(frames: DataFrame) -> DataFrame:
    """(path, ref, cur): every later frame against the first (ref0), and against the one before (dt1)."""
    w = W.orderBy("frame")  # the frame index is a small dimension
    rows = frames.select("frame").distinct().select(F.col("frame").alias("cur"), F.min("frame").over(w).alias("first"), F.lag("frame").over(w).alias("before")).where("before is not null")
    return rows.select(F.expr("stack(2, 'ref0', first, 'dt1', before) as (path, ref)"), "cur").select("path", "ref", "cur")


def displacement(tracks: DataFrame, ref: int = 0) -> DataFrame:
    """Position less that of the reference frame; null for particles the reference lacks."""
    first = tracks.where(F.col("frame") == ref).select("particle", *(F.col(c).alias(f"{c}0") for c in XYZ))
    return tracks.join(first, "particle", "left").select("frame", "particle", *((F.col(c) - F.col(f"{c}0")).alias(f"d{c}") for c in XYZ))


def displacement_dt(tracks: DataFrame, dt: int) -> DataFrame:
    """Position at t less that at t + dt, where both exist, and the direction dy/dx of the step."""
    later = tracks.select((F.col("frame") - dt).alias("frame"), "particle", *(F.col(c).alias(f"{c}1") for c in XYZ))
    rows = tracks.join(later, ["frame", "particle"]).select("frame", "particle", *((F.col(c) - F.col(f"{c}1")).alias(f"d{c}") for c in XYZ))
    return rows.withColumn("slope", F.try_divide("dy", "dx"))


def squared_by_height(tracks: DataFrame, dt: int, width: float) -> DataFrame:
    """Mean squared displacement over dt by initial height."""
    moved = displacement_dt(tracks, dt).join(tracks.select("frame", "particle", "z"), ["frame", "particle"])
    return moved.groupBy(F.floor(F.col("z") / width).alias("z_bin")).agg(F.count("*").alias("n"), F.avg(F.expr("dx * dx + dy * dy + dz * dz")).alias("msd"))


def wide(tracks: DataFrame, value: str, frames: list[int]) -> DataFrame:
    """A row for each particle and a column for each listed frame."""
    return tracks.where(F.col("frame").isin(frames)).groupBy("particle").pivot("frame", frames).agg(F.first(value)).select("particle", *(F.col(str(k)).alias(f"f{k}") for k in frames))


def long(table: DataFrame, frames: list[int], value: str) -> DataFrame:
    """The reverse of ``wide``, without the gaps."""
    pairs = ", ".join(f"{k}L, f{k}" for k in frames)
    return table.select("particle", F.expr(f"stack({len(frames)}, {pairs}) as (frame, {value})")).where(F.col(value).isNotNull())


def step_offsets(steps: DataFrame) -> DataFrame:
    """From (step_no, n_frames): frames of all earlier steps."""
    w = W.orderBy("step_no").rowsBetween(W.unboundedPreceding, -1)
    return steps.withColumn("offset", F.coalesce(F.sum("n_frames").over(w), F.lit(0)))


def reference_shift(planes: DataFrame) -> DataFrame:
    """From (step_no, c): what moves a step's heights to those of the step before."""
    return planes.withColumn("shift", F.coalesce(F.col("c") - F.lag("c").over(W.orderBy("step_no")), F.lit(0.0)))


def running_origin(stages: DataFrame, key: str = "hv") -> DataFrame:
    """From (hv, stage_no, origin): the origin summed over the stages so far."""
    w = W.partitionBy(key).orderBy("stage_no").rowsBetween(W.unboundedPreceding, 0)
    return stages.withColumn("total", F.sum("origin").over(w))


def elapsed(log: DataFrame, ts: str = "ts", by: str | None = None) -> DataFrame:
    """Seconds since the first row of the log (of each group)."""
    first = log.groupBy(*([by] if by else [])).agg(F.min(ts).alias("_first"))
    rows = log.join(first, by) if by else log.crossJoin(F.broadcast(first))
    return rows.withColumn("elapsed_s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_micros(F.col("_first").cast("timestamp")) / 1e6).drop("_first")


def loading_phase(frames: DataFrame, n_frames: int, relax: int) -> DataFrame:
    """load, peak, unload or relax, by the place of a frame about the midpoint int((frames - relax) / 2)."""
    mid, f = (n_frames - relax) // 2, F.col("frame")
    return frames.withColumn("phase", F.when(f < mid, "load").when(f == mid, "peak").when(f < n_frames - relax, "unload").otherwise("relax"))


def triangle(frames: DataFrame, peak: int, rate: float) -> DataFrame:
    """A reference curve that rises to a frame and falls after it."""
    f = F.col("frame")
    return frames.withColumn("reference", F.when(f <= peak, f * rate).otherwise((2 * peak - f) * rate))


def length_histogram(tracks: DataFrame) -> DataFrame:
    """How many particles are seen in how many frames."""
    return tracks.groupBy("particle").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("particles"))
