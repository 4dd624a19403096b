"""Queries of stretch and rotation, of cluster axes and cluster strain, and of resampled errors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.functions.tensor import SYM
from granulon.operators import clusters, frames, quality, resampling, strain
from granulon.plans.adapters import POINTS, TRACKS, points, table, tracks

PAIRS = [a + b for a in "xyz" for b in "xyz"]
NEXT = dict(zip("xyz", "yzx", strict=True))
CLUSTER_R, LEAST, MOST, EDGE = 3.0, 3, 30, 7.5
SIGMA = {"x": 0.1, "y": 0.1, "z": 0.2}


def _strained(s, d) -> DataFrame:
    """Points with a tensor: the products of their coordinates."""
    return points(s, d).withColumns({f"e{k}": F.col(k[0]) * F.col(k[1]) for k in SYM})


def _moved(s, d) -> DataFrame:
    """Points before and after a move by the next three components of their vectors."""
    at = lambda i: F.get("embedding", i).cast("double")
    sides = [(10 * at(i)).alias(f"{c}0") for i, c in enumerate("xyz")] + [(10 * at(i) + at(i + 3)).alias(f"{c}1") for i, c in enumerate("xyz")]
    return table(s, d, "embeddings").select(F.col("label").cast("long").alias("frame"), F.col("vec_id").alias("id"), *sides)


_MOVED = "(select label::bigint as frame, vec_id as id, " + ", ".join(f"10 * embedding[{i + 1}]::double as {c}0, 10 * embedding[{i + 1}]::double + embedding[{i + 4}]::double as {c}1" for i, c in enumerate("xyz")) + " from embeddings)"


def _polar_sql(grad: str, rounds: int = 30) -> str:
    """Rotation by Newton's iteration, kept at unit volume: another scale, and more rounds, than the operator's."""
    det = "(fxx * (fyy * fzz - fyz * fzy) - fxy * (fyx * fzz - fyz * fzx) + fxz * (fyx * fzy - fyy * fzx))"
    parts = [f"n0 as materialized (select ref, cur, particle, {', '.join(f'f{k}, f{k} as q{k}' for k in PAIRS)} from {grad} where {det} > 1e-9 * power(sqrt(({' + '.join(f'f{k} * f{k}' for k in PAIRS)}) / 3), 3))"]
    minor = lambda a, b: f"(q{NEXT[a]}{NEXT[b]} * q{NEXT[NEXT[a]]}{NEXT[NEXT[b]]} - q{NEXT[a]}{NEXT[NEXT[b]]} * q{NEXT[NEXT[a]]}{NEXT[b]})"
    dq = det.replace("f", "q")
    for k in range(rounds):
        parts.append(f"n{k + 1} as materialized (select ref, cur, particle, {', '.join(f'f{p}' for p in PAIRS)}, {', '.join(f'(g * q{p} + {minor(*p)} / dq / g) / 2 as q{p}' for p in PAIRS)} from (select *, {dq} as dq, power({dq}, -1.0 / 3) as g from n{k}))")
    stretch = ", ".join(f"{' + '.join(f'q{k}{a} * f{k}{b}' for k in 'xyz')} as u{a}{b}" for a, b in SYM)
    return f"with {', '.join(parts)} select g.ref, g.cur, g.particle, round(uxx, 3) as uxx, round(uxz, 3) as uxz, round(uzz, 3) as uzz, round(qxz, 3) as qxz, round(case when qxx is not null then acos(least(greatest((qxx + qyy + qzz - 1) / 2, -1), 1)) end, 3) as angle from {grad} g left join (select *, {stretch} from n{rounds}) n using (ref, cur, particle)"


def _axes_sql(source: str, names: list[str]) -> str:
    """Rows of ``source`` with v0, v2 and the vectors u and w of both, by cross products of rows; for tensors without double roots."""
    e = dict(zip(SYM, names, strict=True))
    q = f"(({e['xx']} + {e['yy']} + {e['zz']}) / 3)"
    det = f"(({e['xx']} - q) * (({e['yy']} - q) * ({e['zz']} - q) - {e['yz']} ** 2) - {e['xy']} * ({e['xy']} * ({e['zz']} - q) - {e['yz']} * {e['xz']}) + {e['xz']} * ({e['xy']} * {e['yz']} - ({e['yy']} - q) * {e['xz']}))"
    s = f"(select *, {q} as q from {source})"
    s = f"(select *, sqrt((({e['xx']} - q) ** 2 + ({e['yy']} - q) ** 2 + ({e['zz']} - q) ** 2 + 2 * ({e['xy']} ** 2 + {e['xz']} ** 2 + {e['yz']} ** 2)) / 6) as p from {s})"
    s = f"(select *, acos(greatest(-1, least(1, {det} / (2 * p ** 3)))) / 3 as phi from {s} where p > 0)"
    s = f"(select *, q + 2 * p * cos(phi) as l0, q + 2 * p * cos(phi + 2 * pi() / 3) as l2 from {s})"
    for name, lam in (("u", "l0"), ("w", "l2")):
        r = [(f"({e['xx']} - {lam})", e["xy"], e["xz"]), (e["xy"], f"({e['yy']} - {lam})", e["yz"]), (e["xz"], e["yz"], f"({e['zz']} - {lam})")]
        cross = lambda a, b: f"[{a[1]} * {b[2]} - {a[2]} * {b[1]}, {a[2]} * {b[0]} - {a[0]} * {b[2]}, {a[0]} * {b[1]} - {a[1]} * {b[0]}]"
        s = f"(select *, list_max([{', '.join(f'{{\'n\': list_inner_product({c}, {c}), \'c\': {c}}}' for c in (cross(r[0], r[1]), cross(r[0], r[2]), cross(r[1], r[2])))}]) as b{name} from {s})"
        s = f"(select *, list_transform(b{name}.c, lambda x: x / sqrt(b{name}.n)) as c{name} from {s})"
    s = f"(select *, list_cross_product(cw::double[3], cu::double[3]) as cv from {s})".replace("list_cross_product", "array_cross_product")
    up = lambda n: f"list_transform(c{n}, lambda x: x * case when list_max(list_transform(c{n}, lambda y: abs(y))) > list_max(c{n}) then -1 else 1 end)"
    return f"(select *, {up('u')} as u, {up('v')}::double[] as v, {up('w')} as w from {s})".replace("list_transform(cv", "list_transform(cv::double[]").replace("list_max(cv)", "list_max(cv::double[])")


def _average_sql(cc: str, axes: str) -> str:
    """The average about clusters, with the axes of ``axes`` (frame, cluster, u, v, w)."""
    six = [f"e{k}" for k in SYM]
    p = f"(select *, {', '.join(f'{k[0]} * {k[1]} as e{k}' for k in SYM)} from {POINTS})"
    at = lambda i, j: "e" + "".join(sorted("xyz"[i] + "xyz"[j]))
    turned = ", ".join(f"{' + '.join(f'{a}[{i + 1}] * {b}[{j + 1}] * {at(i, j)}' for i in range(3) for j in range(3))} as t{k}" for k, (a, b) in zip(SYM, ("uu", "uv", "uw", "vv", "vw", "ww"), strict=True))
    bins = ", ".join(f"floor({' + '.join(f'{n}[{j + 1}] * d{c}' for j, c in enumerate('xyz'))} + {EDGE}::double) as {x}_bin" for x, n in zip("xyz", "uvw", strict=True))
    return f"""{cc}, own as materialized (select p.frame, p.id, coalesce(cluster, 0) as cluster, x, y, z, {', '.join(six)} from {p} p left join c on c.id = p.id left join k on k.frame = c.frame and k.root = c.root),
        middle as (select frame, cluster, avg(x) as mx, avg(y) as my, avg(z) as mz from own where cluster > 0 group by 1, 2 having count(*) > {LEAST} and count(*) < {MOST}),
        ball as materialized (select m.frame, m.cluster, o.cluster as other, x - mx as dx, y - my as dy, z - mz as dz, {', '.join(six)} from middle m join own o on m.frame = o.frame and (x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2 <= {CLUSTER_R**2}),
        outside as (select frame, cluster, {', '.join(f'coalesce(avg({e}) filter (other = 0), 0) as m{e}' for e in six)} from ball group by 1, 2),
        less as (select b.* replace ({', '.join(f'{e} - m{e} as {e}' for e in six)}) from ball b join outside using (frame, cluster)),
        axes as ({axes}),
        turned as (select {bins}, {turned} from less join axes using (frame, cluster))
        select x_bin, y_bin, z_bin, avg(txx) as exx, avg(txz) as exz, count(*) as n from turned group by 1, 2, 3"""


def register(add, local, sums: str, grad: str, eps: str, cc: str, members) -> None:
    """``local`` gives the strain of every pair; ``sums``, ``grad`` and ``eps`` are the SQL of its steps, ``cc`` the SQL of clusters and ``members`` the clusters."""
    add(
        "polar",
        "ref cur particle uxx:r uxz:r uzz:r qxz:r angle:r",
        lambda s, d: strain.polar(local(s, d)).select("ref", "cur", "particle", *(F.round(c, 3).alias(c) for c in ("uxx", "uxz", "uzz", "qxz", "angle"))),
        _polar_sql(grad),
    )
    own_mean = f"{cc}, own as (select p.frame, cluster, {', '.join(f'avg({k[0]} * {k[1]}) as e{k}' for k in SYM)} from {POINTS} p join c on c.id = p.id join k on k.frame = c.frame and k.root = c.root group by 1, 2)"
    six = [f"e{k}" for k in SYM]
    add(
        "cluster_axes",
        "frame cluster:i size:i ux:r uz:r vy:r wz:r",
        lambda s, d: _named(clusters.cluster_axes(_strained(s, d), members(s, d), ["frame"]).join(clusters.cluster_table(points(s, d), members(s, d), ["frame"]).where("size > 3").select("frame", "cluster", "size"), ["frame", "cluster"])),
        f"{own_mean}, sizes as (select c.frame, cluster, count(*) as size from c join k on k.frame = c.frame and k.root = c.root group by 1, 2 having count(*) > 3) select a.frame, a.cluster, size, round(u[1], 3) as ux, round(u[3], 3) as uz, round(v[2], 3) as vy, round(w[3], 3) as wz from {_axes_sql('own', six)} a join sizes using (frame, cluster)",
    )
    moved = f"(select m.frame, cluster, m.id, {', '.join(f'{c}{k}' for c in 'xyz' for k in (0, 1))} from {_MOVED} m join c on c.id = m.id join k on k.frame = c.frame and k.root = c.root)"
    middle = f"(select frame, cluster, {', '.join(f'avg({c}0) as m{c}' for c in 'xyz')} from {moved} group by 1, 2)"
    centre = f"(select frame, cluster, unnest(min({{'d': {' + '.join(f'({c}0 - m{c}) ** 2' for c in 'xyz')}, 'id': id, {', '.join(f'\'{c}c{k}\': {c}{k}' for c in 'xyz' for k in (0, 1))}}})) from {moved} join {middle} using (frame, cluster) group by 1, 2)"
    edges = f"(select frame, cluster, {', '.join(f'{c}0 - {c}c0 as r{c}, {c}1 - {c}c1 as c{c}' for c in 'xyz')} from {moved} join (select * exclude (id) from {centre}) using (frame, cluster))"
    whole = "(select frame, cluster, " + ", ".join(f"sum(c{a} * r{b}) as x{a}{b}" for a in "xyz" for b in "xyz") + ", " + ", ".join(f"sum(r{a} * r{b}) as y{a}{b}" for a, b in SYM) + f", sum(cx * cx + cy * cy + cz * cz) as cc, count(*) as nnb_count from {edges} group by 1, 2)"
    strain_sql = eps.replace(sums, whole)
    add(
        "cluster_strain",
        "frame cluster:i nnb_count:i exx:r exz:r d2_min:r",
        lambda s, d: strain.cluster_strain(_moved(s, d), members(s, d), ["frame"]).select("frame", "cluster", "nnb_count", *(F.round(c, 4).alias(c) for c in ("exx", "exz", "d2_min"))),
        f"{cc} select frame, cluster, nnb_count, round(exx, 4) as exx, round(exz, 4) as exz, round(d2_min, 4) as d2_min from {strain_sql}",
    )
    average = "x_bin:i y_bin:i z_bin:i exx:r exz:r n:i"
    about = lambda s, d, **how: clusters.inclusion_average(_strained(s, d), members(s, d), CLUSTER_R, ["frame"], LEAST, MOST, EDGE, **how)
    own_axes = f"select frame, cluster, u, v, w from {_axes_sql('(select frame, cluster, ' + ', '.join(f'avg({e}) as {e}' for e in six) + ' from own where cluster > 0 group by 1, 2)', six)}"
    add("inclusion_average", average, about, _average_sql(cc, own_axes))
    add("inclusion_average_identity", average, lambda s, d: about(s, d, mode="identity"), _average_sql(cc, "select frame, cluster, [1.0, 0, 0]::double[] as u, [0, 1.0, 0]::double[] as v, [0, 0, 1.0]::double[] as w from middle"))
    less = f"(select frame, cluster, {', '.join(f's.{e} - m{e} as {e}' for e in six)} from {strain_sql} s join outside using (frame, cluster) where s.exx is not null)"
    add(
        "inclusion_average_cluster",
        average,
        lambda s, d: about(s, d, mode="cluster", strains=strain.cluster_strain(_moved(s, d), members(s, d), ["frame"])),
        _average_sql(cc, f"select frame, cluster, u, v, w from {_axes_sql(less, six)}"),
    )
    uniform = lambda axis, i: f"(('0x' || substr(md5('42|' || frame || '|' || particle || '|' || replicate || '|{axis}'), {i}, 8))::bigint)"
    normal = lambda axis: f"sqrt(-2 * ln(({uniform(axis, 1)} + 1) / 4294967296.0::double)) * cos(2 * pi() * {uniform(axis, 9)} / 4294967296.0::double)"
    add(
        "resample",
        "frame particle replicate:i x:r y:r z:r",
        lambda s, d: resampling.resample(tracks(s, d), 3, SIGMA, key=["frame", "particle"]),
        f"select frame, particle, replicate, {', '.join(f'{c} + case when replicate = 0 then 0 else {g} * {normal(c)} end as {c}' for c, g in SIGMA.items())} from {TRACKS}, range(0, 4) r(replicate)",
    )
    add("resampled_strain", "ref cur particle n:i exz_mean exz_std", lambda s, d: _spread(s, d))
    add(
        "column_counts",
        "name n:i nulls:i distinct_values:i",
        lambda s, d: quality.column_counts(table(s, d, "events"), ["event_type", "user_id", "value"]),
        " union all ".join(f"select '{c}' as name, count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as distinct_values from events" for c in ("event_type", "user_id", "value")),
    )


def _named(axes: DataFrame) -> DataFrame:
    at = lambda i: F.round(F.get("axes", i), 3)
    return axes.select("frame", "cluster", "size", at(0).alias("ux"), at(2).alias("uz"), at(4).alias("vy"), at(8).alias("wz"))


def _spread(s, d) -> DataFrame:
    sediment = tracks(s, d).where("material = 'sed'")
    pairs = frames.frame_pairs(sediment).where("path = 'ref0'").select("ref", "cur")
    return strain.resampled_strain(sediment, pairs, 12.0, 3, SIGMA)
