"""Queries of the selections and the report tables, in the form of ``catalogue``: (name, columns, query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.operators import reports, selections, setpoints, tiles
from granulon.plans.adapters import TRACKS as T
from granulon.plans.adapters import table, tracks

SED = f"(select * from {T} where material = 'sed')"
BOTH = ["d2_min", "exz"]


def _bin(c: str, n: int) -> str:
    """Number of the equal right-closed interval over the range of a column."""
    width = f"((max({c}) over ()) - (min({c}) over ())) / {n}"
    return f"coalesce(least(greatest(ceil(({c} - (min({c}) over ())) / nullif({width}, 0)), 1), {n}), 1)::bigint"


def _channels(s, d) -> DataFrame:
    li = table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("tracer"), F.col("l_tax").alias("chunk"), (F.col("l_quantity") / 500).alias("background"), (F.col("l_quantity") / 600).alias("colloid"))


CHANNELS = "(select l_orderkey, l_linenumber, l_discount as tracer, l_tax as chunk, l_quantity / 500 as background, l_quantity / 600 as colloid from lineitem)"


def _edge(s, d, sign: int) -> DataFrame:
    return tracks(s, d).where("material = 'sed'").where(f"{sign} * x > {sign} * {9 if sign > 0 else 4}D").select("particle").distinct()


def register(add, local, strain_sql: str) -> None:
    """``local`` makes the strain of every analysed pair of frames, ``strain_sql`` is the same as SQL."""
    keys = "l_orderkey l_linenumber"
    add("tracer_rows", keys, lambda s, d: _channels(s, d).where(selections.is_tracer()), f"select l_orderkey, l_linenumber from {CHANNELS} where tracer > background")
    add("tracer_chunk_rows", keys, lambda s, d: _channels(s, d).where(selections.is_tracer(chunk="chunk")), f"select l_orderkey, l_linenumber from {CHANNELS} where tracer + chunk > background")
    add("sediment_rows", keys, lambda s, d: _channels(s, d).where(selections.is_sediment("tracer", "chunk")), f"select l_orderkey, l_linenumber from {CHANNELS} where tracer > chunk")
    add("colloid_rows", keys, lambda s, d: _channels(s, d).where(~selections.not_colloid()), f"select l_orderkey, l_linenumber from {CHANNELS} where not (chunk > colloid or tracer > colloid)")
    add("clipped", "frame particle x:r z:r", lambda s, d: selections.clip(tracks(s, d), {"x": (2.0, 12.0), "z": (None, 40.0)}), f"select frame, particle, x, z from {T} where x > 2 and x < 12 and z < 40")
    add("columns_like", "frame particle x:r y:r", lambda s, d: selections.columns_like(tracks(s, d), "^[xy]$", ["frame", "particle"]), f"select frame, particle, x, y from {T}")
    step = "case when p_partkey % 3 = 0 then 'a_refStack_f' || p_partkey when p_partkey % 3 = 1 then 'b_imageStack_f' || p_partkey else 'c' end"
    add("step_kind", "p_partkey kind", lambda s, d: table(s, d, "part").select("p_partkey", selections.step_kind(F.expr(step)).alias("kind")), "select p_partkey, case when p_partkey % 3 = 1 then 'imageStack' else 'refStack' end as kind from part")
    add("common_ids", "particle", lambda s, d: selections.common_ids(*(tracks(s, d).where(F.col("frame") == k) for k in (0, 3, 6))), f"select particle from {T} where frame in (0, 3, 6) group by 1 having count(distinct frame) = 3")
    sets = f"select distinct particle from {SED} where x > 9", f"select distinct particle from {SED} where x < 4"
    add("partition_labels", "frame particle material partition", lambda s, d: selections.partitions(tracks(s, d).withColumn("dist", F.col("z")), _edge(s, d, 1), _edge(s, d, -1), 30.0), f"select frame, particle, material, case when material <> 'sed' then 'bulk' when particle in ({sets[0]}) then 'upper' when particle in ({sets[1]}) then 'lower' when z > 30 then 'triangle' else 'bulk' end as partition from {T}")
    add("single_frame", "particle frame:i x:r", lambda s, d: selections.single_frame(tracks(s, d).where("frame = 2").drop("frame"), 7), f"select particle, 7 as frame, x from {T} where frame = 2")
    add("in_microns", "frame particle x:r y:r z:r", lambda s, d: selections.in_microns(tracks(s, d)), f"select frame, particle, x * 0.115 as x, y * 0.115 as y, z * 0.15 as z from {T}")
    add("displacement_series", "frame particle x:r dx:r dy:r dz:r theta:r", lambda s, d: selections.displacement_series(tracks(s, d)), f"select a.frame, a.particle, a.x, a.x - b.x as dx, a.y - b.y as dy, a.z - b.z as dz, case when a.x <> b.x then (a.y - b.y) / (a.x - b.x) end as theta from {T} a join {T} b on a.particle = b.particle and b.frame = 0")
    add("cleaned_series", "frame particle x:r y:r z:r", lambda s, d: selections.cleaned_series(tracks(s, d), tracks(s, d).where("z < 25"), ["x", "y", "z"]), f"select frame, particle, x, y, z from {T} where z < 25")
    whole = f"(select particle from {T} group by 1 having count(distinct frame) = (select count(distinct frame) from {T}))"
    add("complete_series", "frame particle x:r", lambda s, d: selections.complete_series(tracks(s, d)), f"select frame, particle, x from {T} where particle in {whole}")
    add("first_last_series", "frame particle x:r", lambda s, d: selections.complete_series(tracks(s, d), [0, 29]), f"select frame, particle, x from {T} where particle in {whole} and frame in (0, 29)")
    add("complete_or_dropped", "particle flag x:r", lambda s, d: selections.complete_or_dropped(tracks(s, d), 0, 5), f"select particle, case when particle in (select particle from {T} where frame = 5) then 'complete' else 'incomplete' end as flag, x from {T} where frame = 0")
    add("constant_volume", "particle volume:r", lambda s, d: selections.constant(tracks(s, d).select("particle").distinct()), f"select distinct particle, 4 / 3.0 * pi() * (2.043 / 2)**3 as volume from {T}")

    fence = "(select *, quantile_cont({c}, 0.25) over () as q1, quantile_cont({c}, 0.75) over () as q3 from {t})"
    first = f"(select ref, cur, particle, nnb_count, d2_min, exz from {strain_sql} where nnb_count > 4)"
    inside = "(select ref, cur, particle, nnb_count, d2_min, exz from {t} where {c} between q1 - 3 * (q3 - q1) and q3 + 3 * (q3 - q1))"
    for c in BOTH:
        first = inside.format(t=fence.format(c=c, t=first), c=c)
    add("filtered_strain", "ref cur particle nnb_count:i", lambda s, d: reports.filtered_strain(_rounded(local(s, d)).select("ref", "cur", "particle", "nnb_count", *BOTH), BOTH), "select ref, cur, particle, nnb_count from " + first.replace(strain_sql, _rounded_sql(strain_sql)))
    stats = "count({c}) as n, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as low, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75, max({c}) as high"
    add("described_tracks", "name n:i mean:r std:r low:r q25:r q50:r q75:r high:r", lambda s, d: reports.described(tracks(s, d), ["x", "y", "z"]), " union all ".join(f"select '{c}' as name, {stats.format(c=c)} from {T}" for c in "xyz"))
    intervals = [(0.0, 10.0), (10.0, 20.0), (20.0, 40.0)]
    line = f"(select frame, regr_slope(x, z) as m, regr_intercept(x, z) as b, regr_slope(y, z) as n, regr_intercept(y, z) as c from {T} group by 1)"
    number = "case when z > 0 and z <= 10 then 0 when z > 10 and z <= 20 then 1 when z > 20 and z <= 40 then 2 end"
    add("xy_residuals", "frame particle dx_r:r dy_r:r z_bin:i", lambda s, d: reports.residual_table(_residuals(s, d), intervals), f"select frame, particle, x - (m * z + b) as dx_r, y - (n * z + c) as dy_r, {number} as z_bin from {T} join {line} using (frame) where m is not null and n is not null")
    add("relative_residual", "frame particle r:r", lambda s, d: tracks(s, d).select("frame", "particle", reports.relative_residual(F.col("x"), F.col("z")).alias("r")), f"select frame, particle, case when z <> 0 then (x - z) / z end as r from {T}")
    add("joint_measures", "ref cur particle", lambda s, d: reports.joint_measures(_rounded(local(s, d)), most_x=20.0, between_y=(-0.5, 0.8)), f"select ref, cur, particle from {_rounded_sql(strain_sql)} where d2_min < 20 and exz > -0.5 and exz < 0.8")
    add("high_d2_positions", "frame particle x:r y:r z:r", lambda s, d: reports.flagged_positions(tracks(s, d), _rounded(local(s, d)), 5.0), f"select frame, particle, x, y, z from {T} where (frame, particle) in (select (cur, particle) from {_rounded_sql(strain_sql)} where d2_min > 5)")
    place = f"(select particle, x, y, z as dist from {SED} where frame = 0)"
    chosen = f"(select particle, x, y from {place} where dist < 60 and particle in (select particle from {strain_sql}) and particle not in (select particle from {strain_sql} where nnb_count < 1 or nnb_count is null))"
    cells = f"(select particle, {_bin('x', 4)} as x_bin, {_bin('y', 4)} as y_bin from {chosen})"
    add("interface_map", "ref cur x_bin:i y_bin:i n:i percent:r", lambda s, d: _map(s, d, local), f"select ref, cur, x_bin, y_bin, count(exz) as n, 100 * avg(exz) as percent from {_rounded_sql(strain_sql)} join {cells} using (particle) group by 1, 2, 3, 4")
    binned = f"(select x, {_bin('x', 10)} as x_bin, {_bin('y', 8)} as y_bin, {_bin('z', 5)} as z_bin from {T})"
    add("gridded_mean", "x_bin:i y_bin:i z_bin:i n:i mean:r level:i", lambda s, d: reports.gridded(tracks(s, d), "x", {"x": 10, "y": 8, "z": 5}, 3.0, 9.0), f"select x_bin, y_bin, z_bin, count(*) as n, avg(x) as mean, round_even(255 * (least(greatest(avg(x), 3), 9) - 3) / (9 - 3), 0) as level from {binned} group by 1, 2, 3")
    add("rolling_mean", "frame particle x_rolling:r", lambda s, d: reports.rolling_mean(tracks(s, d), "x", 3), f"select frame, particle, case when count(x) over w = 3 then avg(x) over w end as x_rolling from {T} window w as (partition by particle order by frame rows between 2 preceding and current row)")
    moved = f"(select a.particle, a.z, sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2) as disp from {T} a join {T} b on a.particle = b.particle and a.frame = 0 and b.frame = 4)"
    add("distance_moved", "particle disp:r ratio:r", lambda s, d: reports.distance_moved(tracks(s, d), 0, 4), f"select particle, disp, disp / nullif(z, 0) as ratio from {moved}")
    add("yield_criterion", "p_partkey e_vm:r j2:r wd:r thermal_ratio:r", lambda s, d: reports.yield_criterion(table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("stress"), (10 + F.col("p_size")).cast("double").alias("modulus"))), "select p_partkey, sqrt(s / sqrt(3) / m) as e_vm, (s / sqrt(3))**2 as j2, (s / sqrt(3))**2 / (2 * m) as wd, 0.97 / ((s / sqrt(3))**2 / (2 * m)) as thermal_ratio from (select p_partkey, p_retailprice as s, (10 + p_size)::double as m from part)")
    add("tensor_reshape", "p_partkey a:r b:r flat", lambda s, d: _reshaped(s, d), "select p_partkey, p_partkey + 4.0 as a, p_partkey + 5.0 as b, concat_ws(',', p_partkey, p_partkey + 1, p_partkey + 2, p_partkey + 3, p_partkey + 4, p_partkey + 5) as flat from part")
    add("property_columns", "vec_id x:r y:r z:r", lambda s, d: reports.property_columns(table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("p")), "p", 3).toDF("vec_id", "x", "y", "z"), "select vec_id, embedding[1] as x, embedding[2] as y, embedding[3] as z from embeddings")
    add("z_projection", "y:i x:i mean:r", lambda s, d: reports.projection(_voxels(s, d), ["y", "x"]), "select l_partkey % 10 as y, l_suppkey % 7 as x, avg(l_quantity) as mean from lineitem group by 1, 2")
    add("slice_mean", "z:i mean:r", lambda s, d: reports.projection(_voxels(s, d), ["z"]), "select l_linenumber as z, avg(l_quantity) as mean from lineitem group by 1")
    flat = "(select l_orderkey, l_linenumber as z, l_quantity as raw, l_quantity + 3 as flat, l_tax as dark, avg(l_quantity + 3 - l_tax) over (partition by l_linenumber) as m from lineitem)"
    add("flat_field_slice", "l_orderkey z:i v:r", lambda s, d: reports.flat_field(table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("z"), F.col("l_quantity").alias("raw"), (F.col("l_quantity") + 3).alias("flat"), F.col("l_tax").alias("dark")), ["z"]), f"select l_orderkey, z, (raw - dark) * m / nullif(flat - dark, 0) as v from {flat}")
    add("sub_grid", "z:i y:i x:i v:r", lambda s, d: reports.sub_grid(_voxels(s, d), {"z": 8, "y": 10, "x": 7}, {"z": 4, "y": 5, "x": 7}), "select l_linenumber as z, l_partkey % 10 as y, l_suppkey % 7 as x, l_quantity as v from lineitem where l_linenumber % 2 = 0 and l_partkey % 10 % 2 = 0")
    add("pixel_axis", "place:r", lambda s, d: tiles.pixel_axis(s, 0.0, 20.0, 0.23), "select i * 0.23 as place from range(87) r(i)")
    add("tile_lookup", "hv x:i y:i z:i t:i", lambda s, d: tiles.lookup(_tiles(s), 40), "select 40 as hv, 40 % 3 as x, 40 // 3 % 3 as y, 40 // 9 % 3 as z, 40 // 27 as t")
    add("tile_of_index", "hv", lambda s, d: tiles.lookup_index(_tiles(s), 1, 2, 0, 1), "select 1 + 2 * 3 + 27 as hv")
    add("training_tiles", "hv x:i y:i z:i t:i", lambda s, d: tiles.training(_tiles(s), 1), "select hv, hv % 3 as x, hv // 3 % 3 as y, hv // 9 % 3 as z, hv // 27 as t from range(81) r(hv) where hv // 27 in (0, 2) and hv // 9 % 3 <= 1 and ((hv % 3 <> 1 and hv // 3 % 3 <> 1) or (hv % 3 = 1 and hv // 3 % 3 = 1))")
    add("setpoint_bumps", "k target:r", lambda s, d: setpoints.bump_pause_bump(s, 1.0, 3.0, 2, 3), "select k, [1.0, 2.0, 3.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 2.0, 1.0][(k + 1)::int] as target from range(13) r(k)")
    add("setpoint_waves", "k target:r", lambda s, d: setpoints.oscillate(s, 2.0, 0.5, 8, 17, half_wave=True), "select k, 2.0 + 0.5 * abs(sin(2 * pi() * k / 8)) as target from range(17) r(k)")
    add(
        "mass_fraction",
        "l_orderkey l_linenumber mass_fraction:r",
        lambda s, d: setpoints.mass_fraction(table(s, d, "lineitem"), "l_tax", "l_discount", "l_quantity"),
        "select l_orderkey, l_linenumber, (l_discount + 1.0067::double / 5.1621::double * l_tax) / (l_tax + l_discount + l_quantity) as mass_fraction from lineitem",
    )
    add("liquid_filler", "l_orderkey l_linenumber liquid_fraction:r", lambda s, d: setpoints.liquid_filler(table(s, d, "lineitem"), {"l_tax": 0.9, "l_discount": 0.8}, "l_quantity"), "select l_orderkey, l_linenumber, (0.1 * l_tax + 0.2 * l_discount + l_quantity) / (l_tax + l_discount + l_quantity) as liquid_fraction from lineitem")


def _rounded(strain: DataFrame) -> DataFrame:
    """Measures rounded, so that limits and quartiles fall alike on both sides."""
    return strain.withColumns({"d2_min": F.round("d2_min", 2), "exz": F.round("exz", 3)})


def _rounded_sql(strain_sql: str) -> str:
    return f"(select ref, cur, particle, nnb_count, round(d2_min, 2) as d2_min, round(exz, 3) as exz from {strain_sql})"


def _residuals(s, d) -> DataFrame:
    rows = tracks(s, d)
    fit = lambda y, m, b: rows.groupBy("frame").agg(F.regr_slope(y, "z").alias(m), F.regr_intercept(y, "z").alias(b))
    both = rows.join(fit("x", "m", "b"), "frame").join(fit("y", "n", "c"), "frame")
    return both.select("frame", "particle", "x", "y", "z", F.col("z").alias("z_scaled"), F.expr("x - (m * z + b)").alias("dx_r"), F.expr("y - (n * z + c)").alias("dy_r"))


def _map(s, d, local) -> DataFrame:
    first = tracks(s, d).where("material = 'sed' and frame = 0").select("particle", "x", "y", F.col("z").alias("dist"))
    return reports.interface_map(_rounded(local(s, d)), first, value="exz", height=60.0, least=1, cells=4)


def _reshaped(s, d) -> DataFrame:
    six = [(F.col("p_partkey") + k).cast("double") for k in range(6)]
    rows = table(s, d, "part").select("p_partkey", reports.tensor_matrix(*six).alias("m"))
    flat = F.array_join(F.transform(reports.tensor_flat(F.col("m")), lambda v: v.cast("long").cast("string")), ",")
    return rows.select("p_partkey", F.get(F.get("m", 2), 0).alias("a"), F.get(F.get("m", 1), 2).alias("b"), flat.alias("flat"))


def _voxels(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_linenumber").alias("z"), (F.col("l_partkey") % 10).alias("y"), (F.col("l_suppkey") % 7).alias("x"), F.col("l_quantity").alias("v"))


def _tiles(s) -> DataFrame:
    return tiles.tiles(s, {"x": 1000, "y": 1000, "z": 400}, {"x": 450, "y": 450, "z": 200}, 50, 3, 1)
