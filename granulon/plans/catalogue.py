"""Queries of the particle operators over the driver's tables, with SQL for those that it can express.

Each entry is (columns, query, SQL): ``columns`` lists what is returned, ``name:r`` rounded to six decimals and ``name:i`` as bigint, on both sides alike.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.functions import tensor
from granulon.operators import binning, clusters, fits, frames, linking, quality, setpoints, spatial, strain, stress, tiles, volume
from granulon.operators.interpolation import linear_interpolation
from granulon.plans import format_queries, report_queries, strain_queries, volume_queries
from granulon.plans.adapters import POINTS, SURFACE, TRACKS, points, surface, table, tracks


#: Moves values that lie just between two roundings off the tie, on both sides alike.
NUDGE = 1.37e-9


def _spark(df: DataFrame, spec: str) -> DataFrame:
    def column(s: str):
        name, _, kind = s.partition(":")
        c = F.col(name)
        return {"r": F.round(c + NUDGE, 6) + 0.0, "i": c.cast("long"), "": c}[kind].alias(name)

    return df.select(*map(column, spec.split()))


def _sql(sql: str, spec: str) -> str:
    def column(s: str) -> str:
        name, _, kind = s.partition(":")
        return {"r": f"round({name} + {NUDGE}::double, 6) + 0.0 as {name}", "i": f"{name}::bigint as {name}", "": name}[kind]

    return f"select {', '.join(map(column, spec.split()))} from ({sql})"


T, P, S = TRACKS, POINTS, SURFACE
GEL, SED = f"(select * from {T} where material = 'gel')", f"(select * from {T} where material = 'sed')"
RING, R_PTS = 12.0, 1.2
Q: dict[str, tuple] = {}


def add(name: str, spec: str, query, sql=None) -> None:
    Q[name] = (spec, query, sql)


# frames, joins and sets
MOVE = ", ".join(f"a.{c} - b.{c} as d{c}" for c in "xyz")
add("frame_scan", "frame particle x:r", lambda s, d: frames.frame_scan(tracks(s, d), [1, 3], ["frame", "particle", "x"]), f"select frame, particle, x from {T} where frame in (1, 3)")
add("complete_pairs", "particle x_ref:r x_cur:r z_ref:r z_cur:r", lambda s, d: frames.complete_pairs(tracks(s, d), 0, 5), f"select a.particle, a.x as x_ref, b.x as x_cur, a.z as z_ref, b.z as z_cur from {T} a join {T} b on a.particle = b.particle and a.frame = 0 and b.frame = 5")
add("dropped_ids", "particle", lambda s, d: frames.dropped_ids(tracks(s, d), 0, 5), f"select particle from {T} where frame = 0 and particle not in (select particle from {T} where frame = 5)")
add("complete_all_frames", "particle", lambda s, d: frames.complete_ids(tracks(s, d), 30), f"select particle from {T} group by particle having count(distinct frame) = 30")
add("slice_ids", "frame particle z:r", lambda s, d: frames.of_ids(tracks(s, d), frames.complete_ids(tracks(s, d), 30)), f"select frame, particle, z from {T} where particle in (select particle from {T} group by particle having count(distinct frame) = 30)")
add("frame_pairs", "path ref cur", lambda s, d: frames.frame_pairs(tracks(s, d)), f"with f as (select distinct frame from {T}) select unnest(['ref0', 'dt1']) as path, unnest([f0, before]) as ref, frame as cur from (select frame, min(frame) over () as f0, lag(frame) over (order by frame) as before from f) where before is not null")
add("displacement_ref0", "frame particle dx:r dy:r dz:r", lambda s, d: frames.displacement(tracks(s, d)), f"select a.frame, a.particle, {MOVE} from {T} a left join (select * from {T} where frame = 0) b using (particle)")
add("displacement_dt", "frame particle dx:r dy:r slope:r", lambda s, d: frames.displacement_dt(tracks(s, d), 2), f"select a.frame, a.particle, {MOVE}, case when a.x - b.x <> 0 then (a.y - b.y) / (a.x - b.x) end as slope from {T} a join {T} b on a.particle = b.particle and b.frame = a.frame + 2")
add("msd_by_height", "z_bin:i n:i msd:r", lambda s, d: frames.squared_by_height(tracks(s, d), 1, 10.0), f"select floor(a.z / 10) as z_bin, count(*) as n, avg((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2) as msd from {T} a join {T} b on a.particle = b.particle and b.frame = a.frame + 1 group by 1")
add("frame_mean_disp", "frame dx:r dy:r n:i", lambda s, d: frames.displacement(tracks(s, d)).where("dx is not null").groupBy("frame").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.count("*").alias("n")), f"select a.frame, avg(a.x - b.x) as dx, avg(a.y - b.y) as dy, count(*) as n from {T} a join {T} b on a.particle = b.particle and b.frame = 0 group by 1")
add("wide_traj", "particle f0:r f1:r f2:r", lambda s, d: frames.wide(tracks(s, d), "x", [0, 1, 2]), f"select particle, max(case when frame = 0 then x end) as f0, max(case when frame = 1 then x end) as f1, max(case when frame = 2 then x end) as f2 from {T} where frame in (0, 1, 2) group by 1")
add("long_traj", "particle frame x:r", lambda s, d: frames.long(frames.wide(tracks(s, d), "x", [0, 1, 2]), [0, 1, 2], "x"), f"select particle, frame, x from {T} where frame in (0, 1, 2)")
add("traj_lengths", "length:i particles:i", lambda s, d: frames.length_histogram(tracks(s, d)), f"select length, count(*) as particles from (select particle, count(*) as length from {T} group by 1) group by 1")
add("count_change", "particle frame delta:r relative:r", lambda s, d: quality.count_change(tracks(s, d), n="y"), f"select particle, frame, y - lag(y) over w as delta, (y - lag(y) over w) / y as relative from {T} window w as (partition by particle order by frame)")


def _steps(s, d):
    o = table(s, d, "orders")
    return o.groupBy((F.year("o_orderdate") - 1990).cast("long").alias("step_no")).agg(F.count_distinct("o_custkey").alias("n_frames"), F.max("o_totalprice").alias("c"))


STEPS = "(select year(o_orderdate)::bigint - 1990 as step_no, count(distinct o_custkey) as n_frames, max(o_totalprice) as c from orders group by 1)"
add("step_offsets", "step_no n_frames:i frame_offset:i", lambda s, d: frames.step_offsets(_steps(s, d)).withColumnRenamed("offset", "frame_offset"), f'select step_no, n_frames, coalesce(sum(n_frames) over (order by step_no rows between unbounded preceding and 1 preceding), 0) as frame_offset from {STEPS}')
add("ref_shift", "step_no shift:r", lambda s, d: frames.reference_shift(_steps(s, d)), f"select step_no, coalesce(c - lag(c) over (order by step_no), 0) as shift from {STEPS}")
add("origin_integral", "hv stage_no total:i", lambda s, d: frames.running_origin(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("hv"), F.col("l_linenumber").alias("stage_no")).agg(F.sum(F.col("l_quantity").cast("long")).alias("origin"))), "select l_suppkey as hv, l_linenumber as stage_no, sum(sum(l_quantity::bigint)) over (partition by l_suppkey order by l_linenumber) as total from lineitem group by 1, 2")
add("elapsed_time", "event_id elapsed_s:r", lambda s, d: frames.elapsed(table(s, d, "events"), by="event_type"), "select event_id, (epoch_us(ts) - min(epoch_us(ts)) over (partition by event_type)) / 1e6 as elapsed_s from events")
add("loading_phase", "frame phase reference:r", lambda s, d: frames.triangle(frames.loading_phase(tracks(s, d).select("frame").distinct(), 30, 6), 12, 0.5), f"select frame, case when frame < 12 then 'load' when frame = 12 then 'peak' when frame < 24 then 'unload' else 'relax' end as phase, case when frame <= 12 then frame * 0.5 else (24 - frame) * 0.5 end as reference from (select distinct frame from {T})")

# binning
B1 = "least(greatest(ceil(case when hi > lo then (z - lo) / ((hi - lo) / {n}) end), 1), {n})"
add("zbin_stats", "material bin:i bin_mid:r n:i x:r", lambda s, d: binning.equal_width(tracks(s, d), "z", 6, ["material"]).groupBy("material", "bin", "bin_mid").agg(F.count("*").alias("n"), F.avg("x").alias("x")), f"select material, {B1.format(n=6)} as bin, min(lo) + ({B1.format(n=6)} - 0.5) * (min(hi) - min(lo)) / 6 as bin_mid, count(*) as n, avg(x) as x from (select *, min(z) over (partition by material) as lo, max(z) over (partition by material) as hi from {T}) group by 1, 2")
HEAT = f"select material, a.frame, ceil(a.x / 23.5) as x_bin, ceil(a.z / 23.5) as y_bin, avg(a.x - b.x) as dx, count(*) as n from {T} a join (select particle, x from {T} where frame = 0) b using (particle) where a.x > 0 and a.x <= 235 and a.z > 0 and a.z <= 235 group by 1, 2, 3, 4"


def _heat(s, d):
    t = tracks(s, d)
    moved = frames.displacement(t).where("dx is not null").join(t.select("material", "frame", "particle", "x", F.col("z").alias("y")), ["frame", "particle"])
    return binning.heat_map(moved, 23.5, 235.0, ["dx"], ["material", "frame"])


add("xybin_heatmap", "material frame x_bin:i y_bin:i dx:r n:i", _heat, HEAT)
add("heatmap_residual", "frame x_bin:i y_bin:i residual:r", lambda s, d: binning.material_residual(_heat(s, d), "dx"), f"with h as ({HEAT}) select a.frame, a.x_bin, a.y_bin, a.dx - b.dx as residual from h a join h b on a.material = 'sed' and b.material = 'gel' and a.frame = b.frame and a.x_bin = b.x_bin and a.y_bin = b.y_bin")
_IV = binning.interface_intervals([0.0, 5.0, 10.0])
add("interface_bins", "frame bin:i n:i y:r", lambda s, d: tracks(s, d).withColumn("bin", binning.listed(F.col("z") - 30, _IV)).where("bin is not null").groupBy("frame", "bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")), "select frame, case " + " ".join(f"when z - 30 > {a} and z - 30 <= {b} then {k}" for k, (a, b) in enumerate(_IV)) + f" end as bin, count(*) as n, avg(y) as y from {T} where bin is not null group by 1, 2")
add("mean_strain_map", "x_bin:i y_bin:i z_bin:i y:r n:i", lambda s, d: tracks(s, d).groupBy(F.floor(F.col("x") / 15).alias("x_bin"), F.floor(F.col("y") / 2).alias("y_bin"), F.floor(F.col("z") / 15).alias("z_bin")).agg(F.avg("x").alias("y"), F.count("*").alias("n")), f"select floor(x / 15) as x_bin, floor(y / 2) as y_bin, floor(z / 15) as z_bin, avg(x) as y, count(*) as n from {T} group by 1, 2, 3")

# quality control
add("tukey_outliers", "frame particle z:r", lambda s, d: quality.tukey_outliers(tracks(s, d), "z", ["frame"]), f"with f as (select frame, quantile_cont(z, 0.25) as a, quantile_cont(z, 0.75) as b from {T} group by 1) select frame, particle, z from {T} t join f using (frame) where z < a - 1.5 * (b - a) or z > b + 1.5 * (b - a)")
add("tukey_filter", "frame particle", lambda s, d: quality.tukey_filter(tracks(s, d), ["x", "z"]), f"with t as (select * from {T}), u as (select * from t, (select quantile_cont(x, 0.25) as a, quantile_cont(x, 0.75) as b from t) where x between a - 1.5 * (b - a) and b + 1.5 * (b - a)) select frame, particle from u, (select quantile_cont(z, 0.25) as a2, quantile_cont(z, 0.75) as b2 from u) where z between a2 - 1.5 * (b2 - a2) and b2 + 1.5 * (b2 - a2)")
add("sigma_clip", "frame particle", lambda s, d: quality.sigma_clip(tracks(s, d), "x", 2), f"select frame, particle from {T}, (select avg(x) + 2 * stddev_samp(x) as m from {T}) where abs(x) <= m")
add("describe_by_frame", "frame n:i mean:r std:r low:r q25:r q50:r q75:r high:r", lambda s, d: binning.describe(tracks(s, d), "x", ["frame"]), f"select frame, count(x) as n, avg(x) as mean, stddev_samp(x) as std, min(x) as low, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as q50, quantile_cont(x, 0.75) as q75, max(x) as high from {T} group by 1")
_TH = [float(x) for x in range(5, 105, 10)]
add("ecdf_thresholds", "threshold share:r", lambda s, d: quality.below_thresholds(tracks(s, d), "z", _TH), f"select threshold, avg((z < threshold)::int) as share from {T}, (select unnest({_TH})::double as threshold) group by 1")
add("cumulative_hist", "bin:i n:i share:r", lambda s, d: quality.cumulative_histogram(tracks(s, d), "z", 10), f"select floor(z / 10) as bin, count(*) as n, sum(count(*)) over (order by floor(z / 10)) / (select count(z) from {T}) as share from {T} group by 1")
add("corr_matrix", "a b r:r", lambda s, d: quality.correlations(tracks(s, d), ["x", "y", "z"]), " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {T}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))
add("moments_by_count", "y:i n:i low:r high:r mean:r var:r skew:r kurt:r", lambda s, d: quality.moments_by(tracks(s, d), "x", ["y"]), f"select y, count(x) as n, min(x) as low, max(x) as high, avg(x) as mean, var_samp(x) as var, case when var_pop(x) > 0 then (avg(x**3) - 3 * avg(x) * avg(x**2) + 2 * avg(x)**3) / var_pop(x)**1.5 end as skew, case when var_pop(x) > 0 then (avg(x**4) - 4 * avg(x) * avg(x**3) + 6 * avg(x)**2 * avg(x**2) - 3 * avg(x)**4) / var_pop(x)**2 - 3 end as kurt from {T} group by 1")
add("value_counts", "event_type n:i", lambda s, d: quality.summary_counts(table(s, d, "events"), "event_type"), "select event_type, count(*) as n from events group by 1")
add("fill_high", "frame particle x:r", lambda s, d: quality.fill_high(tracks(s, d).withColumn("x", F.when(F.col("particle") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x"))), "x"), f"with t as (select frame, particle, case when particle % 7 <> 0 then x end as x from {T}) select frame, particle, coalesce(x, 1.1 * (select quantile_cont(x, 0.999) from t)) as x from t")
add("top_values", "l_orderkey:i total:r", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c")).orderBy(F.desc("c"), "l_orderkey").limit(50).withColumn("total", F.col("c") / 100), "select l_orderkey, sum(round(l_extendedprice * 100)::bigint)::double / 100 as total from lineitem group by 1 order by total desc, l_orderkey limit 50")

# fits
COV = "avg({u} * {v}) - avg({u}) * avg({v})"
MOM = ", ".join(f"covar_pop({u}, {v}) as s{u}{v}" for u, v in ("xx", "xy", "yy", "xz", "yz", "zz"))


def _plane(src: str) -> str:
    return f"select frame, n, a, b, mz - a * mx - b * my as c, greatest(n * (szz - a * sxz - b * syz), 0) as residual, 3 as rank from (select *, (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) as a, (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) as b from (select frame, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, {MOM} from {src} group by 1))"


DIST = f"(select s.*, z - (a * x + b * y + c) as dist from {S} s join ({_plane(S)}) p using (frame))"
add("plane_fit", "frame a:r b:r c:r residual:r rank:i n:i", lambda s, d: fits.plane_fit(surface(s, d), ["frame"]), _plane(S))
add("plane_distance", "frame x:r y:r z:r dist:r", lambda s, d: fits.plane_distance(surface(s, d), fits.plane_fit(surface(s, d), ["frame"]), ["frame"]), DIST)
add("plane_distance_max", "frame low:r high:r", lambda s, d: fits.below_highest(fits.plane_distance(surface(s, d), fits.plane_fit(surface(s, d), ["frame"]), ["frame"]), ["frame"]).groupBy("frame").agg(F.min("dist").alias("low"), F.max("dist").alias("high")), f"select frame, min(dist) - max(dist) as low, 0.0 as high from {DIST} group by 1")
TOP = "(select frame, (floor(x / 5) + 0.5) * 5 as x, (floor(y / 5) + 0.5) * 5 as y, max(z) as z from {src} group by frame, floor(x / 5), floor(y / 5))"
add("top_surface_fit", "frame a:r b:r c:r n:i", lambda s, d: fits.top_surface(surface(s, d), ["frame"], 5.0), _plane(TOP.format(src=S)))
FIVE = [f"(u.a - l.a) * {x} + (u.b - l.b) * {y} + (u.c - l.c)" for x, y in ((0, 0), (50, 0), (0, 50), (50, 50), (25, 25))]
add("gap_corners", "frame gap_min:r gap_max:r gap_center:r", lambda s, d: fits.gap(fits.top_surface(surface(s, d), ["frame"], 5.0), fits.plane_fit(surface(s, d), ["frame"]), 50.0, ["frame"]), f"select u.frame, least({', '.join(FIVE)}) as gap_min, greatest({', '.join(FIVE)}) as gap_max, {FIVE[4]} as gap_center from ({_plane(TOP.format(src=S))}) u join ({_plane(S)}) l on u.frame = l.frame")
def _t_by_integration(df: int) -> float:
    """0.975 quantile of Student's t by Simpson's rule and Newton's steps, apart from the series that the operator uses."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda t: scale * (1 + t * t / df) ** (-(df + 1) / 2)
    t, n = 1.96, 400
    for _ in range(30):
        h = t / n
        area = h / 3 * (density(0) + density(t) + 4 * sum(density((2 * k + 1) * h) for k in range(n // 2)) + 2 * sum(density(2 * k * h) for k in range(1, n // 2)))
        step = (0.475 - area) / density(t)
        t += step
        if abs(step) < 1e-12:
            break
    return t


def _ols_sql() -> str:
    table = ", ".join(f"({df}, {_t_by_integration(df)!r}::double)" for df in range(1, 261))
    sums = f"select frame, regr_slope(x, z) as m, regr_intercept(x, z) as b, regr_sxx(x, z) as sxx, regr_syy(x, z) as syy, regr_sxy(x, z) as sxy, avg(z) as mx, count(*) as n from {T} group by 1"
    errors = f"select *, sqrt(s2 / sxx) as se_m, sqrt(s2 * (1.0 / n + mx * mx / sxx)) as se_b from (select *, (syy - m * sxy) / (n - 2) as s2 from ({sums}))"
    bounds = "m - t * se_m as ci_lo, m + t * se_m as ci_hi, b - t * se_b as b_lo, b + t * se_b as b_hi"
    return f"select frame, m, b, se_m, se_b, {bounds}, n from ({errors}) left join (values {table}) as q(df, t) on df = n - 2"


add("ols_fit", "frame m:r b:r se_m:r se_b:r ci_lo:r ci_hi:r b_lo:r b_hi:r n:i", lambda s, d: fits.line_fit(tracks(s, d), "z", "x", ["frame"]), _ols_sql)
_SLOPES = f"(select a.frame, (b.x - a.x) / (b.z - a.z) as slope from {GEL} a join {GEL} b on a.frame = b.frame and a.particle < b.particle and a.z <> b.z)"
_RANKS = f"""(select frame, count(*) as pairs, median(slope) as m, list(slope order by slope) as sorted from {_SLOPES} group by 1)"""
_KENDALL = f"(select frame, count(*) as n, median(x) as mx, median(z) as mz, 1.959963984540054 * sqrt(count(*) * (count(*) - 1) * (2 * count(*) + 5) / 18.0) as half from {GEL} group by 1)"
_PLACE = "greatest(1, least(pairs, round((pairs {s} half) / 2)))::bigint"
add("theil_sen", "frame m:r b:r ci_lo:r ci_hi:r n:i", lambda s, d: fits.theil_sen(tracks(s, d).where("material = 'gel'"), "z", "x", "particle", ["frame"]), f"select frame, m, mx - m * mz as b, sorted[{_PLACE.format(s='-')}] as ci_lo, sorted[{_PLACE.format(s='+')}] as ci_hi, n from {_RANKS} join {_KENDALL} using (frame)")
add("binned_median_fit", "frame m:r b:r n:i", lambda s, d: fits.binned_median_fit(binning.equal_width(tracks(s, d), "z", 10, ["frame"]), "z", "x", ["frame"]), f"select frame, regr_slope(v, mid) as m, regr_intercept(v, mid) as b, count(*) as n from (select frame, {B1.format(n=10)} as bin, min(lo) + ({B1.format(n=10)} - 0.5) * (min(hi) - min(lo)) / 10 as mid, median(x) as v from (select *, min(z) over (partition by frame) as lo, max(z) over (partition by frame) as hi from {T}) group by 1, 2) group by 1")


# stress
def _fits(s, d):
    g = frames.displacement(tracks(s, d)).where("dx is not null").join(tracks(s, d).where("material = 'gel'").select("frame", "particle", "z"), ["frame", "particle"])
    one = lambda c, k: fits.line_fit(g, "z", c, ["frame"]).select("frame", F.col("m").alias(f"m_{k}"), F.col("b").alias(f"b_{k}"))
    return one("dx", "xz").join(one("dy", "yz"), "frame")


FITS = f"(select a.frame, regr_slope(a.x - b.x, a.z) as m_xz, regr_intercept(a.x - b.x, a.z) as b_xz, regr_slope(a.y - b.y, a.z) as m_yz, regr_intercept(a.y - b.y, a.z) as b_yz from {GEL} a join {T} b on a.particle = b.particle and b.frame = 0 group by 1)"
add("drift_residual", "frame particle dx_c:r dy_c:r dx_r:r dy_r:r", lambda s, d: stress.drift_corrected(frames.displacement(tracks(s, d)).where("dx is not null").join(tracks(s, d).select("frame", "particle", "z"), ["frame", "particle"]), _fits(s, d)), f"select t.frame, t.particle, t.x - b.x - b_xz as dx_c, t.y - b.y - b_yz as dy_c, t.x - b.x - (m_xz * t.z + b_xz) as dx_r, t.y - b.y - (m_yz * t.z + b_yz) as dy_r from {T} t join {T} b on t.particle = b.particle and b.frame = 0 join {FITS} f on f.frame = t.frame")
add("scaled_height", "frame x:r y:r z:r z_scaled:r", lambda s, d: stress.scaled_height(fits.plane_distance(surface(s, d), fits.plane_fit(surface(s, d), ["frame"]), ["frame"]), 180.0), f"select frame, x, y, z, 180.0 * z / nullif(z - dist, 0) as z_scaled from {DIST}")
add("clean_flags", "frame keep:i n:i", lambda s, d: stress.clean(fits.plane_distance(surface(s, d), fits.plane_fit(surface(s, d), ["frame"]), ["frame"]).withColumn("material", F.when(F.col("x") > 25, "sed").otherwise("gel"))).groupBy("frame", F.col("clean_keep").cast("long").alias("keep")).agg(F.count("*").alias("n")), f"select frame, (case when x > 25 then dist > -1 else dist < -1.5 end)::bigint as keep, count(*) as n from {DIST} group by 1, 2")
_UP, _LOW = (lambda s, d: tracks(s, d).where("frame = 0 and z > 60").select("particle")), (lambda s, d: tracks(s, d).where("frame = 0 and z <= 30").select("particle"))
_BM = f"(select frame, avg(x) filter (particle in (select particle from {T} where frame = 0 and z > 60)) as ux, avg(y) filter (particle in (select particle from {T} where frame = 0 and z > 60)) as uy, avg(x) filter (particle in (select particle from {T} where frame = 0 and z <= 30)) as lx, avg(y) filter (particle in (select particle from {T} where frame = 0 and z <= 30)) as ly from {T} group by 1)"
add("boundary_strain", "ref cur move_x:r strain_x:r strain_y:r stress_x:r", lambda s, d: stress.boundary_strain(tracks(s, d), _UP(s, d), _LOW(s, d), frames.frame_pairs(tracks(s, d)).where("path = 'ref0'"), 50.0, 0.3), f"select a.frame as ref, b.frame as cur, (b.ux - a.ux) - (b.lx - a.lx) as move_x, ((b.ux - a.ux) - (b.lx - a.lx)) / 50 as strain_x, ((b.uy - a.uy) - (b.ly - a.ly)) / 50 as strain_y, ((b.ux - a.ux) - (b.lx - a.lx)) / 50 * 0.3 as stress_x from {_BM} a join {_BM} b on a.frame = 0 and b.frame > 0")
add("tracer_strain", "frame particle gx:r gy:r gz:r", lambda s, d: stress.tracer_strain(tracks(s, d).where("material = 'gel'"), 0, 200.0), f"select a.frame, a.particle, (a.x - b.x) / (b.z + 200) as gx, (a.y - b.y) / (b.z + 200) as gy, (a.z - b.z) / (b.z + 200) as gz from {GEL} a join {GEL} b on a.particle = b.particle and b.frame = 0")
add("plate_less_gel", "frame strain:r", lambda s, d: stress.plate_less_gel(tracks(s, d), 100.0), f"with m as (select frame, avg(x) filter (material = 'sed') - avg(x) filter (material = 'gel') as g from {T} group by 1) select frame, (g - (select g from m where frame = 0)) / 100 as strain from m")

# space
NEAR = "(a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2"
add("radius_neighbors", "frame i n:i d2:r", lambda s, d: spatial.radius_join(points(s, d), points(s, d), R_PTS, ["frame"]).groupBy("frame", "i").agg(F.count("*").alias("n"), F.sum("d2").alias("d2")), f"select a.frame, a.id as i, count(*) as n, sum({NEAR}) as d2 from {P} a join {P} b on a.frame = b.frame and {NEAR} <= {R_PTS**2} group by 1, 2")
add("radius_pairs", "frame i j d2:r", lambda s, d: spatial.radius_pairs(points(s, d), R_PTS, ["frame"]), f"select a.frame, a.id as i, b.id as j, {NEAR} as d2 from {P} a join {P} b on a.frame = b.frame and a.id < b.id and {NEAR} <= {R_PTS**2}")
add("knn", "frame i j rank:i d2:r", lambda s, d: spatial.nearest(points(s, d), 4, R_PTS, ["frame"]), f"select * from (select a.frame, a.id as i, b.id as j, row_number() over (partition by a.id order by {NEAR}, b.id) as rank, {NEAR} as d2 from {P} a join {P} b on a.frame = b.frame and a.id <> b.id) where rank <= 4")
RDF = f"select frame, least(floor(sqrt(d2) / 0.25), 15) as bin, 2 * count(*) as n_pairs from (select a.frame, {NEAR} as d2 from {P} a join {P} b on a.frame = b.frame and a.id < b.id and {NEAR} <= 16) group by 1, 2"
RDF2 = f"select h.frame, bin, n_pairs, n_pairs / (c * (4.0::double / 3 * {math.pi}::double * (((bin + 1) * 0.25::double)**3 - (bin * 0.25::double)**3))) as density from ({RDF}) h join (select frame, count(*) as c from {P} group by 1) using (frame)"
add("rdf_hist", "frame bin:i n_pairs:i density:r", lambda s, d: spatial.pair_distribution(points(s, d), 4.0, 16, ["frame"]), RDF2)
add("rdf_peak", "frame bin:i density:r", lambda s, d: spatial.first_peak(spatial.pair_distribution(points(s, d), 4.0, 16, ["frame"]), ["frame"]), f"select frame, arg_max(bin, density) as bin, max(density) as density from ({RDF2}) group by 1")
add("coordination", "frame nnb:i n:i", lambda s, d: spatial.coordination(points(s, d), R_PTS, ["frame"]).groupBy("frame", "nnb").agg(F.count("*").alias("n")), f"select frame, nnb, count(*) as n from (select a.frame, a.id, count(*) as nnb from {P} a join {P} b on a.frame = b.frame and {NEAR} <= {R_PTS**2} group by 1, 2) group by 1, 2")
add("weld", "id", lambda s, d: spatial.weld(points(s, d).where("frame < 5"), points(s, d).where("frame >= 5 or frame is null"), 1.0), f"with u as (select * from {P}) select distinct m as id from (select a.id, min(b.id) as m from u a join u b on {NEAR} <= 1 group by 1)")
ERR = f"(select *, case when id % 5 <> 0 then sqrt((x * 0.115)**2 + (y * 0.115)**2 + (z * 0.15)**2) end as error from {P})"


def _errors(s, d):
    e = spatial.total_error(points(s, d), {"x": 0.115, "y": 0.115, "z": 0.15})
    return e.withColumn("error", F.when(F.col("id") % 5 != 0, F.col("total_error"))).drop("total_error")


add("stitch_keep", "frame id keep:i", lambda s, d: spatial.resolve_doubles(_errors(s, d), R_PTS, ["frame"]), f"with l as (select distinct case when coalesce(a.error, 'inf'::double) < coalesce(b.error, 'inf'::double) then b.id else a.id end as lost from {ERR} a join {ERR} b on a.frame = b.frame and a.id < b.id and {NEAR} <= {R_PTS**2}) select frame, id, (id not in (select lost from l))::bigint as keep from {P}")
add("line_offset", "frame id distance:r", lambda s, d: spatial.distance_to_line(points(s, d), (0.0, 0.0), (3.0, 4.0)).withColumnRenamed("offset", "distance"), f'select frame, id, abs(0.8 * x - 0.6 * y) as distance from {P}')

# local strain
_FRAMES = f"(select frame as cur, unnest([min(frame) over (), lag(frame) over (order by frame)]) as ref from (select distinct frame from {SED}))"
_REL = f"(select a.frame as ref, b.frame as cur, a.particle, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1 from {SED} a join {SED} b on a.particle = b.particle join (select distinct ref, cur from {_FRAMES} where ref < cur) p on a.frame = p.ref and b.frame = p.cur)"
_EDGE = f"(select a.ref, a.cur, a.particle, " + ", ".join(f"b.{c}0 - a.{c}0 as r{c}, b.{c}1 - a.{c}1 as c{c}" for c in "xyz") + f" from {_REL} a join {_REL} b on a.ref = b.ref and a.cur = b.cur and (a.x0 - b.x0)**2 + (a.y0 - b.y0)**2 + (a.z0 - b.z0)**2 <= {RING**2})"
_SUM = "(select ref, cur, particle, " + ", ".join(f"sum(c{a} * r{b}) as x{a}{b}" for a in "xyz" for b in "xyz") + ", " + ", ".join(f"sum(r{a} * r{b}) as y{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + f", sum(cx * cx + cy * cy + cz * cz) as cc, count(*) as nnb_count from {_EDGE} group by 1, 2, 3)"
_DET = f"(select *, yyy * yzz - yyz * yyz as k1, yxz * yyz - yxy * yzz as k2, yxy * yyz - yxz * yyy as k3, yxx * yzz - yxz * yxz as k4, yxy * yxz - yxx * yyz as k5, yxx * yyy - yxy * yxy as k6 from {_SUM})"
_DET2 = f"(select *, case when abs(yxx * k1 + yxy * k2 + yxz * k3) > 1e-9 * ((yxx + yyy + yzz) / 3)**3 then yxx * k1 + yxy * k2 + yxz * k3 end as det from {_DET})"
_INV = {"xx": "k1", "xy": "k2", "xz": "k3", "yx": "k2", "yy": "k4", "yz": "k5", "zx": "k3", "zy": "k5", "zz": "k6"}
_GRAD = "(select *, " + ", ".join("(" + " + ".join(f"x{a}{c} * {_INV[c + b]}" for c in "xyz") + f") / det as f{a}{b}" for a in "xyz" for b in "xyz") + f" from {_DET2})"
_EPS = "(select *, " + ", ".join(f"(f{a}{b} + f{b}{a}) / 2{' - 1' if a == b else ''} as e{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + ", " + ", ".join(f"(f{a}{b} - f{b}{a}) / 2 as r{a}{b}" for a, b in ("xy", "xz", "yz")) + ", greatest(cc - (" + " + ".join(f"f{a}{b} * x{a}{b}" for a in "xyz" for b in "xyz") + f"), 0) as d2_min from {_GRAD})"
_VM = "sqrt(((exx - eyy)**2 + (eyy - ezz)**2 + (ezz - exx)**2) / 2 + 3 * (exy**2 + exz**2 + eyz**2))"
_STRAIN = f"(select *, {_VM} as von_mises from {_EPS})"


def _local(s, d):
    """Of the sediment, over every pair of frames that is analysed: to the first frame, and to the one before."""
    sediment = tracks(s, d).where("material = 'sed'")
    return strain.local_strain(sediment, frames.frame_pairs(sediment).select("ref", "cur").distinct(), RING)


add("local_strain", "ref cur particle nnb_count:i exx:r exz:r eyz:r rxz:r", lambda s, d: _local(s, d).select("ref", "cur", "particle", "nnb_count", *(F.round(c, 4).alias(c) for c in ("exx", "exz", "eyz", "rxz"))), "select ref, cur, particle, nnb_count, " + ", ".join(f"round({c}, 4) as {c}" for c in ("exx", "exz", "eyz", "rxz")) + f" from {_STRAIN}")
add("d2_min", "ref cur particle d2_min:r", lambda s, d: _local(s, d).select("ref", "cur", "particle", F.round("d2_min", 2).alias("d2_min")), f"select ref, cur, particle, round(d2_min, 2) as d2_min from {_STRAIN}")
add("von_mises", "ref cur particle von_mises:r", lambda s, d: _local(s, d).select("ref", "cur", "particle", F.round("von_mises", 4).alias("von_mises")), f"select ref, cur, particle, round(von_mises, 4) as von_mises from {_STRAIN}")
add("mean_strain", "ref cur n:i exz:r von_mises:r shear_percent:r exz_std:r std_per_n:r", lambda s, d: strain.mean_strain(_local(s, d), 5), f"select ref, cur, count(*) as n, avg(exz) as exz, avg(von_mises) as von_mises, 200 * avg(exz) as shear_percent, stddev_samp(exz) as exz_std, stddev_samp(exz) / count(*) as std_per_n from {_STRAIN} where nnb_count >= 5 group by 1, 2")
_RM = tensor.rotation("y", 30.0)


def _rotated(s, d):
    e = _local(s, d)
    return e.select("ref", "cur", "particle", *(F.round(c, 4).alias(f"e{k}") for k, c in tensor.rotate_tensor(_RM, *(F.col(f"e{k}") for k in tensor.SYM)).items()))


add("rotate_strain", "ref cur particle exx:r exz:r ezz:r", _rotated, "select ref, cur, particle, " + ", ".join("round(" + " + ".join(f"{float(_RM['xyz'.index(k[0]), a] * _RM['xyz'.index(k[1]), b])!r} * e{''.join(sorted('xyz'[a] + 'xyz'[b]))}" for a in range(3) for b in range(3)) + f", 4) as e{k}" for k in ("xx", "xz", "zz")) + f" from {_STRAIN}")
_Q = "((exx + eyy + ezz) / 3)"
_MEAN = f"(select *, (exx + eyy + ezz) / 3 as q from {_STRAIN})"
_SPREAD = f"(select *, sqrt(((exx - q)**2 + (eyy - q)**2 + (ezz - q)**2 + 2 * (exy**2 + exz**2 + eyz**2)) / 6) as p from {_MEAN})"
_DET3 = "((exx - q) * ((eyy - q) * (ezz - q) - eyz**2) - exy * (exy * (ezz - q) - eyz * exz) + exz * (exy * eyz - (eyy - q) * exz))"
_ANGLE = f"(select *, acos(greatest(-1, least(1, case when p > 0 then {_DET3} / (2 * p**3) else 0 end))) / 3 as phi from {_SPREAD})"


def _eigen(s, d):
    v = _local(s, d).withColumn("v", tensor.eigenvalues(*(F.col(f"e{k}") for k in tensor.SYM)))
    return v.select("ref", "cur", "particle", *(F.round(F.get("v", k), 3).alias(f"v{k}") for k in range(3)))


add("eig_values", "ref cur particle v0:r v1:r v2:r", _eigen, f"select ref, cur, particle, round(q + 2 * p * cos(phi), 3) as v0, round(q - 2 * p * cos(phi) - 2 * p * cos(phi + 2 * pi() / 3), 3) as v1, round(q + 2 * p * cos(phi + 2 * pi() / 3), 3) as v2 from {_ANGLE}")
_GL = "(select *, " + ", ".join("(" + " + ".join(f"f{c}{a} * f{c}{b}" for c in "xyz") + (" - 1" if a == b else "") + f") / 2 as g{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + f" from {_STRAIN})"
add("green_lagrange", "ref cur particle shear:r volumetric:r", lambda s, d: strain.green_lagrange(_local(s, d)).select("ref", "cur", "particle", F.round("shear", 3).alias("shear"), F.round("volumetric", 3).alias("volumetric")), f"select ref, cur, particle, round(sqrt(gxy**2 + gxz**2 + gyz**2 + ((gxx - gyy)**2 + (gxx - gzz)**2 + (gyy - gzz)**2) / 6), 3) as shear, round((gxx + gyy + gzz) / 3, 3) as volumetric from {_GL}")
add("peak_split", "cur high:r low:r", lambda s, d: strain.split_by_peak(_local(s, d), 1.0), f"with e as (select * from {_STRAIN}), p as (select particle, max(von_mises) as m from e group by 1) select cur, avg(von_mises) filter (m > 1) as high, avg(von_mises) filter (m <= 1) as low from e join p using (particle) group by 1")
add("stress_strain", "ref cur stress:r strain:r", lambda s, d: stress.stress_strain(_fits(s, d), strain.mean_strain(_local(s, d), 5), 0.5), f"select ref, cur, m_xz * 0.5 as stress, 2 * exz as strain from (select ref, cur, avg(exz) as exz from {_STRAIN} where nnb_count >= 5 group by 1, 2) join {FITS} f on f.frame = cur")

# clusters
_HI = f"(select * from {P} where z > 0)"
_CC = f"""with recursive n as (select frame, id from {_HI}), e as (select a.frame, a.id as i, b.id as j from {_HI} a join {_HI} b on a.frame = b.frame and a.id <> b.id and {NEAR} <= {R_PTS**2}),
r as (select frame, id, id as root from n union select r.frame, e.j as id, r.root from r join e on e.i = r.id), c as (select frame, id, min(root) as root from r group by 1, 2),
k as (select frame, root, row_number() over (partition by frame order by count(*) desc, root) as cluster from c group by 1, 2)"""
_MEM = lambda s, d: clusters.find_clusters(points(s, d), F.col("z") > 0, R_PTS, ["frame"])
add("clusters", "frame id cluster:i", _MEM, f"{_CC} select p.frame, p.id, coalesce(cluster, 0) as cluster from {P} p left join c on c.id = p.id left join k on k.frame = c.frame and k.root = c.root")
add("cluster_stats", "frame cluster:i size:i com_x:r com_z:r gyration:r", lambda s, d: clusters.cluster_table(points(s, d), _MEM(s, d), ["frame"]), f"{_CC} select p.frame, cluster, count(*) as size, avg(x) as com_x, avg(z) as com_z, sqrt(greatest(var_pop(x) + var_pop(y) + var_pop(z), 0)) as gyration from {P} p join c on c.id = p.id join k on k.frame = c.frame and k.root = c.root group by 1, 2")
add("cluster_sizes", "frame size:i n:i", lambda s, d: clusters.size_counts(clusters.cluster_table(points(s, d), _MEM(s, d), ["frame"]), ["frame"]), f"{_CC} select frame, size, count(*) as n from (select frame, root, count(*) as size from c group by 1, 2) group by 1, 2")
add("near_large_clusters", "frame id", lambda s, d: clusters.near_large(points(s, d), _MEM(s, d), 4, R_PTS, ["frame"]), f"{_CC}, big as (select id from c where (frame, root) in (select (frame, root) from c group by frame, root having count(*) >= 4)) select distinct a.frame, a.id from {P} a join {P} b on a.frame = b.frame and {NEAR} <= {R_PTS**2} where b.id in (select id from big)")

# uncertainty and fields
add("kde_grid", "place:r density:r", lambda s, d: clusters.density_estimate(tracks(s, d), "z", [0.0, 10.0, 20.0, 40.0, 80.0]).withColumnRenamed("at", "place"), f"select place, avg(exp(-0.5::double * power((place - z) / w, 2)) / (w * sqrt(2 * pi()))) as density from {T}, (select stddev_samp(z) * count(z)**(-0.2::double) as w from {T}), (select unnest([0.0, 10.0, 20.0, 40.0, 80.0])::double as place) group by 1")
add("pmf_moments", "frame norm:r mean:r std:r skew:r kurt:r", lambda s, d: clusters.pmf_moments(tracks(s, d), ["frame"], "x", "y"), f"select frame, norm, mean, sqrt(m2) as std, m3 / nullif(m2, 0)**1.5 as skew, m4 / nullif(m2 * m2, 0) as kurt from (select t.frame, norm, mean, sum(y / norm * (x - mean)**2) as m2, sum(y / norm * (x - mean)**3) as m3, sum(y / norm * (x - mean)**4) as m4 from {T} t join (select frame, sum(y) as norm, sum(y * x) / sum(y) as mean from {T} group by 1) m using (frame) group by 1, 2, 3)")
add("pixel_snap", "frame id x:r", lambda s, d: clusters.snap(points(s, d), "x", -5.0, 0.25), f"select frame, id, -5.0 + floor((x + 5.0) / 0.25 + 0.5) * 0.25 as x from {P}")
add("lattice", "id x:r y:r z:r", lambda s, d: clusters.close_packed(s, 6, "ABCAB"), f"select layer * 36 + j * 6 + i as id, i + 0.5 * j + [0.0, 0.5, 1.0][layer % 3 + 1] as x, j * sqrt(3) / 2 + [0.0, sqrt(3) / 6, sqrt(3) / 3][layer % 3 + 1] as y, layer * sqrt(2.0 / 3) as z from range(6) a(i), range(6) b(j), range(5) c(layer)")
_GRID = "select i * 1.0 as x, j * 1.0 as y, k * 1.0 as z from range(-4, 5) a(i), range(-4, 5) b(j), range(-4, 5) c(k)"
_C = 1 / (4 * (4 - 5 / 3))
_E0 = 2 * 0.1 * (4 - 5 / 3) / (15 * (1 - 1 / 3))
_FAR = f"{_E0} * 8 / (4 * (h**2 + x**2)**4.5) * (36 * {_C} * h**4 - (2 + 3 * {_C}) * h**6 + 9 * {_C} * h**2 * (-32 + 5 * h**2) * x**2 + 6 * (h**2 + 4 * {_C} * (4 + h**2)) * x**4 + 4 * (1 - 6 * {_C}) * x**6 + 15 * {_C} * h**4 * (-28 + 5 * (h**2 + x**2)) * cos(4 * acos(u)))"
_INCLUSION = f"(select x, y, z, case when r < 2 then {_E0} else {_FAR} end as field from (select x::double as x, y::double as y, z::double as z, sqrt(x * x + y * y + z * z)::double as r, sqrt(y * y + z * z)::double as h, case when y = 0 and z = 0 then 0 else greatest(-1, least(1, z / sqrt(y * y + z * z))) end::double as u from ({_GRID})))"


def _grid(s):
    return s.sql("select cast(i as double) as x, cast(j as double) as y, cast(k as double) as z from (select explode(sequence(-4, 4)) as i), (select explode(sequence(-4, 4)) as j), (select explode(sequence(-4, 4)) as k)")


add("inclusion_field", "x:r y:r z:r field:r", lambda s, d: clusters.inclusion_field(_grid(s), 2.0, 0.1), f"select * from {_INCLUSION}")


def _field(s):
    return clusters.inclusion_field(_grid(s), 2.0, 0.1).select(*(F.col(a).cast("int").alias(b) for a, b in zip("xyz", "ijk", strict=True)), F.col("field").alias("v"))


_FLD = f"(select x::int as i, y::int as j, z::int as k, field as v from {_INCLUSION})"
add("spatial_corr", "si:i sj:i sk:i r:r n:i", lambda s, d: clusters.spatial_correlation(_field(s), _field(s), s.sql("select explode(sequence(-2, 2)) as si, 0 as sj, 1 as sk")), f"select si, 0 as sj, 1 as sk, corr(a.v, b.v) as r, count(*) as n from {_FLD} a, range(-2, 3) t(si), {_FLD} b where b.i = a.i + si and b.j = a.j and b.k = a.k + 1 group by 1")
_HIST = "(select l_linenumber as tile, floor(l_extendedprice / 1000)::bigint as level, count(*) as n from lineitem group by 1, 2)"
add("maxent_threshold", "tile:i threshold:i entropy:r", lambda s, d: volume.max_entropy_threshold(table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("tile"), F.floor(F.col("l_extendedprice") / 1000).alias("level")).agg(F.count("*").alias("n")), ["tile"]), f"with h as (select tile, level, n / sum(n) over (partition by tile) as p from {_HIST}), c as (select *, sum(p) over w as c, sum(p * ln(p)) over w as s, sum(p * ln(p)) over (partition by tile) as a from h window w as (partition by tile order by level)), e as (select tile, level, ln(c) - s / c + ln(1 - c) - (a - s) / (1 - c) as entropy from c where c < 1 - 1e-12) select tile, level as threshold, entropy from (select *, row_number() over (partition by tile order by round(entropy, 9) desc, level) as r from e) where r = 1")
add("recast", "l_linenumber:i level:i n:i", lambda s, d: volume.recast(table(s, d, "lineitem"), "l_extendedprice", 8, ["l_linenumber"]).groupBy("l_linenumber", "level").agg(F.count("*").alias("n")), "select l_linenumber, round_even((l_extendedprice - a) / (b - a) * 255, 0) as level, count(*) as n from lineitem join (select l_linenumber, 0.99 * min(l_extendedprice) as a, 1.01 * max(l_extendedprice) as b from lineitem group by 1) using (l_linenumber) group by 1, 2")
add("z_profile", "z:i mean:r gradient:r", lambda s, d: volume.z_profile(table(s, d, "lineitem").select(F.col("l_linenumber").alias("z"), F.col("l_quantity").alias("v"))), "select z, mean, case when lag(mean) over w is null then lead(mean) over w - mean when lead(mean) over w is null then mean - lag(mean) over w else (lead(mean) over w - lag(mean) over w) / 2 end as gradient from (select l_linenumber as z, avg(l_quantity) as mean from lineitem group by 1) window w as (order by z)")
add("master_dark", "y:i x:i dark:r", lambda s, d: volume.master_dark(table(s, d, "lineitem").select(F.col("l_linenumber").alias("y"), (F.col("l_partkey") % 10).alias("x"), F.col("l_tax").alias("mean"), F.col("l_quantity").alias("n_slices"))), "select l_linenumber as y, l_partkey % 10 as x, sum(l_tax * l_quantity) / sum(l_quantity) as dark from lineitem group by 1, 2")

# tiles and setpoints
_TILES = lambda s: tiles.tiles(s, {"x": 1000, "y": 1000, "z": 400}, {"x": 450, "y": 450, "z": 200}, 50, 3, 1)
_TS = "(select hv, (hv % 3)::int as x, (hv // 3 % 3)::int as y, (hv // 9 % 3)::int as z, (hv // 27)::int as t, case when hv // 9 % 3 < 1 then 'gel' else 'sed' end as material, round(hv % 3 * 550 / 2.0)::int as x0, round(hv // 3 % 3 * 550 / 2.0)::int as y0, round(hv // 9 % 3 * 200 / 2.0)::int as z0, round(hv % 3 * 550 / 2.0)::int + 450 as x1, round(hv // 3 % 3 * 550 / 2.0)::int + 450 as y1, round(hv // 9 % 3 * 200 / 2.0)::int + 200 as z1 from range(81) r(hv))"
_NB = f"(select a.hv as a, b.hv as b from {_TS} a join {_TS} b on a.t = b.t and a.material = b.material and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and abs(a.z - b.z) <= 1 and a.hv <> b.hv)"
add("tiles_table", "hv x:i y:i z:i t:i material x0:i x1:i y0:i z0:i z1:i", lambda s, d: _TILES(s), f"select * from {_TS}")
add("tile_neighbors", "a b", lambda s, d: tiles.neighbours(_TILES(s)), f"select * from {_NB}")
add("tile_overlap", "a b x0:i x1:i y0:i y1:i z0:i z1:i", lambda s, d: tiles.overlaps(_TILES(s)), "select n.a, n.b, " + ", ".join(f"greatest(p.{c}0, q.{c}0) as {c}0, least(p.{c}1, q.{c}1) as {c}1" for c in "xyz") + f" from {_NB} n join {_TS} p on p.hv = n.a join {_TS} q on q.hv = n.b where n.a < n.b")
add("missing_tiles", "hv", lambda s, d: tiles.missing(_TILES(s), table(s, d, "part").select((F.col("p_partkey") % 50).alias("hv"))), "select hv from range(81) r(hv) where hv not in (select p_partkey % 50 from part)")
add("tile_groups", "x:i y:i z:i hvs", lambda s, d: quality.group_tiles(_TILES(s)).withColumn("hvs", F.array_join("hvs", ",")), f"select x, y, z, string_agg(hv::varchar, ',' order by hv) as hvs from {_TS} group by 1, 2, 3")
add("tile_leaf", "hv leaf:i array_id:i", lambda s, d: tiles.leaf_array(_TILES(s), 25), "select hv, hv // 25 as leaf, hv % 25 as array_id from range(81) r(hv)")
add("setpoint_triangle", "k target:r", lambda s, d: setpoints.triangle(s, 1.0, 5.0, 8), "select k, 1.0 + (8 - abs(k - 8)) * 0.5 as target from range(17) r(k)")
add("setpoint_hold", "k target:r", lambda s, d: setpoints.up_hold_down(s, 0.0, 4.0, 4, 3), "select k, case when k < 4 then k * 1.0 when k < 7 then 4.0 else 4.0 - (k - 6) * 1.0 end as target from range(11) r(k)")

# without SQL: assignment, noise, array kernels
def _beside(p: DataFrame) -> DataFrame:
    """A place beside each point."""
    return p.select("frame", "id", F.expr("x + 0.25D").alias("x"), F.expr("y - 0.25D").alias("y"), F.expr("z + 0.125D").alias("z"))


add("traj_link", "frame id particle x:r", lambda s, d: linking.link(points(s, d), 3.0))
add("traj_link_memory", "frame id particle", lambda s, d: linking.link_with_memory(points(s, d).withColumn("material", F.when(F.col("id") % 4 == 0, "gel").otherwise("sed")), 3.0, 1))
add("linear_interpolation", "frame i v:r", lambda s, d: linear_interpolation(_beside(points(s, d)), points(s, d).withColumn("v", F.expr("x + 2 * y - z")), "v", 4.0, ["frame"]))
add("inverse_distance", "frame i v:r", lambda s, d: spatial.inverse_distance(points(s, d), points(s, d).withColumn("v", F.col("x") + F.col("y")), "v", 2.0, ["frame"]))


def _blocks(s, d):
    """Volumes of 24 voxels a side that tile the space of each label's vectors, with bright spots at them: as many blocks as the data fill."""
    import pandas as pd

    voxel = {c: F.floor(2.2 * F.col(c) + 0.5).cast("int").alias(f"v{c}") for c in "zyx"}
    spots = points(s, d).where("frame is not null and x is not null and y is not null and z is not null").select("frame", *voxel.values()).distinct()
    tile = [F.floor(F.col(f"v{c}") / 24).cast("int").alias(f"t{c}") for c in "zyx"]
    spots = spots.select("frame", *tile, *(F.pmod(F.col(f"v{c}"), F.lit(24)).alias(c) for c in "zyx"))

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        a, first = np.zeros((24, 24, 24)), pdf.iloc[0]
        a[pdf["z"].to_numpy(), pdf["y"].to_numpy(), pdf["x"].to_numpy()] = 1000.0
        a = volume.gaussian(a, 1.2).astype("float32")
        at = {f"{c}0": int(first[f"t{c}"]) * 24 for c in "zyx"}
        hv = ((int(first["frame"]) * 64 + int(first["tz"]) + 32) * 64 + int(first["ty"]) + 32) * 64 + int(first["tx"]) + 32
        return pd.DataFrame([{"hv": hv, **at, "nz": 24, "ny": 24, "nx": 24, "dtype": "float32", "data": a.tobytes()}])

    return spots.groupBy("frame", "tz", "ty", "tx").applyInPandas(paint, volume.BLOCK)


def _filtered(s, d):
    found = volume.voxels(volume.map_blocks(_blocks(s, d), lambda a: volume.curvature_filter(a, "tv", 2)))
    return found.groupBy("hv", "z").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("most"))


add("locate", "hv z:r y:r x:r mass:r round:i", lambda s, d: volume.locations(_blocks(s, d), (3.0, 3.0, 3.0), rounds=2, quantile=0.95))
add("curvature_filter", "hv z:i n:i mean:r most:r", _filtered)
add("filter_chain", "hv z:i n:i mean:r", lambda s, d: volume.voxels(volume.filter_chain(_blocks(s, d), [("tv", {"steps": 1}), ("mean", {"steps": 1}), ("blur", {"sigma": 1.0})])).groupBy("hv", "z").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))
report_queries.register(add, _local, _STRAIN)
strain_queries.register(add, _local, _SUM, _GRAD, _EPS, _CC, _MEM)
volume_queries.register(add)
format_queries.register(add)


def queries() -> dict:
    return {n: (lambda s, d, q=q, spec=spec: _spark(q(s, d), spec)) for n, (spec, q, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _sql(sql() if callable(sql) else sql, spec) for n, (spec, _, sql) in Q.items() if sql}
