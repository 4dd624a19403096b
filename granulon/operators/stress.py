"""Boundaries, drift, and the stress that a calibrated elastic layer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recentre(rows: DataFrame, origin: DataFrame, px: dict[str, float], half: float = 117.5) -> DataFrame:
    """Pixel positions in a tile to the image stack, microns, and heights over the gel (x, y centred, y and depth negated).

    ``origin`` has x0, y0, z0 and z_gel, z_post for each hv: a small dimension.
    """
    r = rows.join(origin, "hv").withColumns({f"{c}_px": F.col(c) + F.col(f"{c}0") for c in "xyz"})
    r = r.withColumns({f"{c}_um": F.col(f"{c}_px") * px[c] for c in "xyz"})
    return r.withColumns({"x_rheo": F.col("x_um") - half, "y_rheo": half - F.col("y_um"), "z_height": F.col("z_um") - F.col("z_gel"), "z_depth": F.col("z_post") - F.col("z_um")})


def rheo_height(rows: DataFrame, offset: float, half: float = 117.5) -> DataFrame:
    return rows.withColumns({"x_rheo": F.col("x") - half, "y_rheo": half - F.col("y"), "z_rheo": F.col("z") + offset})


def clean(rows: DataFrame, sed: float = -1.0, gel: float = -1.5) -> DataFrame:
    """``clean_keep``: sediment above, tracers below, the interface by ``dist``."""
    return rows.withColumn("clean_keep", F.when(F.col("material") == "sed", F.col("dist") > sed).otherwise(F.col("dist") < gel))


def scaled_height(rows: DataFrame, h: float) -> DataFrame:
    """Height h z / (z - dist): as if the layer were h thick everywhere."""
    return rows.withColumn("z_scaled", F.try_divide(h * F.col("z"), F.col("z") - F.col("dist")))


def drift_corrected(moved: DataFrame, fits: DataFrame) -> DataFrame:
    """Displacements less the fit's intercept, and residuals from its line; fits (frame, m_xz, b_xz, m_yz, b_yz) are small."""
    r = moved.join(fits, "frame")
    return r.withColumns({"dx_c": F.expr("dx - b_xz"), "dy_c": F.expr("dy - b_yz"), "dz_c": F.col("dz"), "dx_r": F.expr("dx - (m_xz * z + b_xz)"), "dy_r": F.expr("dy - (m_yz * z + b_yz)")})


def boundary_strain(tracks: DataFrame, upper: DataFrame, lower: DataFrame, pairs: DataFrame, height: float, modulus: float = 1.0) -> DataFrame:
    """By frame pair: mean move of the upper boundary less that of the lower, over the height; each frame's own members count."""
    label = tracks.join(upper.select("particle", F.lit(1).alias("u")), "particle", "left").join(lower.select("particle", F.lit(1).alias("l")), "particle", "left")
    means = label.groupBy("frame").agg(*(F.avg(F.when(F.col(s) == 1, F.col(c))).alias(f"{s}{c}") for s in "ul" for c in "xy"))
    a = means.withColumnsRenamed({"frame": "ref"} | {f"{s}{c}": f"{s}{c}0" for s in "ul" for c in "xy"})
    b = means.withColumnsRenamed({"frame": "cur"})
    d = pairs.select("ref", "cur").join(a, "ref").join(b, "cur")
    d = d.select("ref", "cur", *(F.expr(f"(u{c} - u{c}0) - (l{c} - l{c}0)").alias(f"move_{c}") for c in "xy"))
    return d.withColumns({f"strain_{c}": F.expr(f"move_{c} / {height}D") for c in "xy"}).withColumns({f"stress_{c}": F.expr(f"strain_{c} * {modulus}D") for c in "xy"})


def tracer_strain(tracks: DataFrame, ref: int, thickness: float) -> DataFrame:
    """Displacement of each tracer over its reference height plus the thickness."""
    first = tracks.where(F.col("frame") == ref).select("particle", *(F.col(c).alias(f"{c}0") for c in "xyz"))
    return tracks.join(first, "particle").select("frame", "particle", *(F.expr(f"try_divide({c} - {c}0, z0 + {thickness}D)").alias(f"g{c}") for c in "xyz"))


def top_bin_strain(binned: DataFrame, top: int, factor: float, value: str = "dx") -> DataFrame:
    return binned.where(F.col("bin") == top).groupBy("frame").agg((F.avg(value) * factor).alias("strain"))


def plate_less_gel(tracks: DataFrame, thickness: float) -> DataFrame:
    """Mean x of the sediment less that of the gel by frame, relative to the first frame, over the thickness."""
    m = tracks.groupBy("frame").agg(F.avg(F.when(F.col("material") == "sed", F.col("x"))).alias("s"), F.avg(F.when(F.col("material") == "gel", F.col("x"))).alias("g"))
    base = m.where("frame = 0").select(F.expr("s - g").alias("first"))
    return m.crossJoin(F.broadcast(base)).select("frame", F.expr(f"((s - g) - first) / {thickness}D").alias("strain"))


def stress_strain(fits: DataFrame, strain: DataFrame, modulus: float) -> DataFrame:
    """Stress from the gel's shear (modulus times slope) beside the sediment's mean strain, by current frame."""
    return strain.join(fits, strain["cur"] == fits["frame"]).select("ref", "cur", (F.col("m_xz") * modulus).alias("stress"), (2 * F.col("exz")).alias("strain"), "von_mises")
