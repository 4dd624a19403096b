"""Queries of the formats, written and read again in the shared folder, and of tile, step and tensor operators, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.functions import tensor
from granulon.operators import binning, frames, linking, stress, tiles, volume
from granulon.operators.lineage import shared_folder
from granulon.plans.adapters import POINTS, points, table, tracks
from granulon.plans.adapters import TRACKS as T
from granulon.sources import store, tables

SHEAR, SHIFT = [[1.0, 0.0, 0.02], [0.0, 1.0, -0.01], [0.0, 0.0, 1.0]], (0.5, -0.25, 0.0)
TURN = 30.0
AXIS = (2 / 3, 2 / 3, 1 / 3)


def _folder(s) -> str:
    return f"{shared_folder(s)}/formats-{uuid.uuid4().hex}"


def _ids(s, d) -> DataFrame:
    path = _folder(s)
    rows = tracks(s, d).where("material = 'sed'").select("particle").distinct()
    rows.select(F.explode(F.array(F.lit("# ids"), F.col("particle").cast("string"))).alias("value")).write.text(path)
    return tables.id_list(s, path, "sediment")


def _tracks_back(s, d) -> DataFrame:
    path = _folder(s)
    tables.write_tracks(tracks(s, d), path)
    return s.read.parquet(path)


def _replaced(s, d) -> DataFrame:
    """Strain-like rows of every partition, of which those of one frame pair are written again, ten times as large."""
    path = _folder(s)
    rows = table(s, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("strain_type"), F.col("l_linenumber").cast("int").alias("ref"), (F.col("l_linenumber") + 1).cast("int").alias("cur"), F.lit(0).alias("replicate"), F.col("l_quantity").alias("exz"))
    tables.write_strain(rows, path)
    tables.write_strain(rows.where("strain_type = 'R' and ref = 2").withColumn("exz", F.col("exz") * 10), path)
    return tables.read_strain(s, path, strain_type="R")


def _logged(s, d) -> DataFrame:
    path = _folder(s)
    rows = table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("stage"))
    for part in (rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 > 0")):
        tables.append_log(part, path)
    return s.read.parquet(path).groupBy("stage").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def _xml(s, d) -> DataFrame:
    path = _folder(s)
    table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.format("xml").option("rootTag", "measures").option("rowTag", "measure").save(path)
    return tables.rheology_xml(s, path, "measure", "n_nationkey long, n_name string, n_regionkey long")


def _yaml(s, d) -> DataFrame:
    path = _folder(s)
    rows = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") > 0, F.format_string("hv: %d\nlocating:\n  particles: %d", "n_nationkey", F.length("n_name"))).otherwise(F.format_string("hv: %d", "n_nationkey")).alias("value"))
    rows.write.partitionBy("k").text(path)
    return tables.yaml_counts(s, path)


def _placed(s, d) -> DataFrame:
    """Parts as locations of tiles, whose origins are nations."""
    n = table(s, d, "nation")
    origin = n.select(F.col("n_nationkey").cast("long").alias("hv"), (F.col("n_nationkey") * 10.0).alias("x0"), (F.col("n_nationkey") * 20.0).alias("y0"), (F.col("n_regionkey") * 5.0).alias("z0"), (F.col("n_regionkey") + 0.5).alias("z_gel"), F.lit(100.0).alias("z_post"))
    rows = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 25).cast("long").alias("hv"), F.col("p_size").cast("double").alias("x"), (F.col("p_size") * 2.0).alias("y"), (F.col("p_retailprice") / 100).alias("z"))
    return stress.recentre(rows, origin, {"x": 0.115, "y": 0.115, "z": 0.15})


def _steps(s, d) -> DataFrame:
    rows = tracks(s, d)
    steps = rows.select("frame").distinct().select("frame", F.when(F.col("frame") < 10, "a_ref").otherwise("b_shear").alias("step"), (F.col("frame") % 10).alias("frame_local"))
    return frames.at_steps(rows, steps)


def _masked(s, d) -> DataFrame:
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", F.col("l_quantity").alias("v"))
    return volume.probability_mask(li, {"l_discount": 1.0, "l_tax": 2.0}, 0.1405)


def _tiled(s, d) -> DataFrame:
    """Line items by tile number."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("hv"), (F.col("l_suppkey") % 9).alias("z"), (F.col("l_linenumber") % 3).alias("t"), F.col("l_returnflag").alias("material"))


def register(add) -> None:
    add("id_list", "set_name particle", _ids, f"select distinct 'sediment' as set_name, particle from {T} where material = 'sed'")
    add("stored_tracks", "material frame:i particle x:r y:r z:r", _tracks_back, f"select material, frame, particle, x, y, z from {T}")
    add("stored_strain", "l_orderkey ref:i cur:i exz:r", _replaced, "select l_orderkey, l_linenumber as ref, l_linenumber + 1 as cur, l_quantity * case when l_linenumber = 2 then 10 else 1 end as exz from lineitem where l_returnflag = 'R'")
    add("stage_log", "stage n:i last:i", _logged, "select o_orderstatus as stage, count(*) as n, max(o_orderkey) as last from orders group by 1")
    add("xml_rows", "n_nationkey:i n_name n_regionkey:i", _xml, "select n_nationkey, n_name, n_regionkey from nation")
    add("yaml_counts", "hv:i particle_count:i", _yaml, "select n_nationkey as hv, case when n_regionkey > 0 then length(n_name) else -1 end as particle_count from nation")
    add(
        "xyz_lines",
        "frame part:i k:i value",
        lambda s, d: tables.xyz_lines(tracks(s, d).select("frame", "particle", F.col("y").cast("long").alias("y")), ["particle", "y"], "P"),
        f"select frame, 2 as part, particle as k, 'P ' || particle || ' ' || y::bigint as value from {T} union all select frame, 0, null, count(*)::varchar from {T} group by 1 union all select distinct frame, 1, null::bigint, 'Properties=species:S:1:particle:R:1:y:R:1' from {T}",
    )
    add(
        "union_tiles",
        "frame particle x:r y:r z:r",
        lambda s, d: tables.union_tiles(tracks(s, d).where("material = 'gel'").select("frame", "particle", "x", "y"), tracks(s, d).where("material = 'sed'").select("z", "x", "particle", "frame")),
        f"select frame, particle, x, case when material = 'gel' then y end as y, case when material = 'sed' then z end as z from {T}",
    )
    add("kept_rows", "frame particle y:i z:r", lambda s, d: frames.kept(tracks(s, d).withColumn("keep", F.col("z") < 25).select("frame", "particle", "y", "z", "keep"), {"y": "bigint"}).drop("keep"), f"select frame, particle, y, z from {T} where z < 25")
    add("at_steps", "step frame_local:i particle x:r", _steps, f"select case when frame < 10 then 'a_ref' else 'b_shear' end as step, frame % 10 as frame_local, particle, x from {T}")
    origin = "(select n_nationkey as hv, n_nationkey * 10.0::double as x0, n_nationkey * 20.0::double as y0, n_regionkey * 5.0::double as z0, n_regionkey + 0.5::double as z_gel from nation)"
    add(
        "recentred",
        "p_partkey x_um:r x_rheo:r y_rheo:r z_height:r z_depth:r",
        _placed,
        f"select p_partkey, (p_size + x0) * 0.115::double as x_um, (p_size + x0) * 0.115::double - 117.5 as x_rheo, 117.5 - (2 * p_size + y0) * 0.115::double as y_rheo, (p_retailprice::double / 100 + z0) * 0.15::double - z_gel as z_height, 100 - (p_retailprice::double / 100 + z0) * 0.15::double as z_depth from part join {origin} on hv = p_partkey % 25",
    )
    add("rheo_height", "frame particle x_rheo:r y_rheo:r z_rheo:r", lambda s, d: stress.rheo_height(tracks(s, d), -3.5), f"select frame, particle, x - 117.5 as x_rheo, 117.5 - y as y_rheo, z - 3.5 as z_rheo from {T}")
    add(
        "top_bin_strain",
        "frame strain:r",
        lambda s, d: stress.top_bin_strain(tracks(s, d).withColumn("bin", binning.fixed(F.col("z"), 10.0, 0.0, 40.0)), 2, 0.05, "x"),
        f"select frame, 0.05::double * avg(x) as strain from {T} where z > 10 and z <= 20 group by 1",
    )
    add(
        "predicted_shear",
        "frame particle x:r y:r z:r",
        lambda s, d: linking.predict_shear(tracks(s, d), SHEAR, SHIFT),
        f"select frame, particle, x + 0.02::double * z + 0.5 as x, y - 0.01::double * z - 0.25 as y, z from {T}",
    )
    add("probability_mask", "l_orderkey l_linenumber v:r", _masked, "select l_orderkey, l_linenumber, case when l_discount::double + 2 * l_tax::double >= 0.1405 then l_quantity end as v from lineitem")
    add("tiles_of_time", "hv:i", lambda s, d: tiles.of_time(_tiled(s, d), 1, "R").distinct(), "select distinct l_partkey % 40 as hv from lineitem where l_linenumber % 3 = 1 and l_returnflag = 'R'")
    add("tiles_at_interface", "l_orderkey l_linenumber interface", lambda s, d: tiles.interface(_tiled(s, d), 4, 1), "select l_orderkey, l_linenumber, l_suppkey % 9 between 2 and 5 as interface from lineitem")
    ends = ", ".join(f"a.{k} as {k}_ref, b.{k} as {k}_cur" for k in "xyz")
    add(
        "stored_pairs",
        "particle " + " ".join(f"{k}_ref:r {k}_cur:r" for k in "xyz"),
        lambda s, d: frames.complete_pairs(_kept(s, d), 0, 5),
        f"select a.particle, {ends} from {T} a join {T} b on a.particle = b.particle and a.frame = 0 and b.frame = 5",
    )
    c, n = math.cos(math.radians(TURN)), math.sin(math.radians(TURN))
    add(
        "turned_points",
        "frame id x:r y:r z:r",
        lambda s, d: _turned(s, d, lambda x: tensor.rotate_vector(tensor.rotation("y", TURN), *x)),
        f"select frame, id, {c}::double * x + {n}::double * z as x, y, {c}::double * z - {n}::double * x as z from {POINTS}",
    )
    k = [f"{v!r}::double" for v in AXIS]
    dot = f"({k[0]} * x + {k[1]} * y + {k[2]} * z) * (1 - {c}::double)"
    add(
        "points_about_axis",
        "frame id x:r y:r z:r",
        lambda s, d: _turned(s, d, lambda x: tensor.rodrigues(x, [F.lit(v) for v in AXIS], math.radians(TURN))),
        f"select frame, id, x * {c}::double + ({k[1]} * z - {k[2]} * y) * {n}::double + {k[0]} * {dot} as x, y * {c}::double + ({k[2]} * x - {k[0]} * z) * {n}::double + {k[1]} * {dot} as y, z * {c}::double + ({k[0]} * y - {k[1]} * x) * {n}::double + {k[2]} * {dot} as z from {POINTS}",
    )


def _kept(s, d) -> DataFrame:
    """The tracks in a store of eight buckets."""
    name = f"tracks_{uuid.uuid4().hex}"
    return store.write_store(tracks(s, d), name, f"{shared_folder(s)}/{name}", 8)


def _turned(s, d, how) -> DataFrame:
    moved = how([F.col(c) for c in "xyz"])
    return points(s, d).select("frame", "id", *(v.alias(c) for c, v in zip("xyz", moved, strict=True)))
