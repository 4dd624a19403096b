"""Neighbours in space as equality joins on grid cells of the search radius; closed balls, never padded lists."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.operators.lineage import checkpointed


def _cells(r: float) -> list:
    return [F.floor(F.col(c) / r).alias(f"c{c}") for c in "xyz"]


def radius_join(left: DataFrame, right: DataFrame, r: float, by: list[str], left_id: str = "id", right_id: str = "id") -> DataFrame:
    """(by..., i, j, dx, dy, dz, d2): every right point within r of a left point of its group; a point finds itself.

    The left side goes to its own cell and the 26 around it; the right side stays in one cell. With both sides bounded by the
    density of points, a dense cell is split by the adaptive skew join.
    """
    near = lambda c: F.explode(F.expr(f"sequence(c{c} - 1, c{c} + 1)")).alias(f"c{c}")
    a = left.select(*by, F.col(left_id).alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"), *(F.floor(F.col(c) / r).alias(f"c{c}") for c in "xyz"))
    for c in "xyz":
        a = a.select(*[k for k in a.columns if k != f"c{c}"], near(c))
    b = right.select(*by, F.col(right_id).alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"), *_cells(r))
    d2 = F.expr("(x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)")
    joined = a.join(b, [*by, "cx", "cy", "cz"]).withColumn("d2", d2).where(F.col("d2") <= r * r)
    return joined.select(*by, "i", "j", *(F.expr(f"{c}2 - {c}1").alias(f"d{c}") for c in "xyz"), "d2")


GROUP = ("_bx", "_by", "_bz", "_a", "_b")


def block_groups(rows: DataFrame, by: list[str], at: list[str], key: list[str], r: float, most: int = 20_000) -> DataFrame:
    """Rows dealt to the groups (by..., ``GROUP``) in which each row of ``_query`` meets, once over all its groups, each row of ``_near`` within r.

    Rows at finite places (``at``) go to blocks of four radii and to the blocks that they reach into. A block of more than ``most`` rows is dealt
    by hash of ``key`` into slices, and every slice meets every slice, so what is summed or collected over groups is that of the block.
    """
    blocks, names = [*by, *GROUP[:3]], rows.columns
    rows = in_blocks(rows, at, r)
    dense = rows.groupBy(*blocks).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    rows = rows.join(dense, blocks, "left").withColumn("_s", F.ceil(F.coalesce("_n", F.lit(1)) / most).cast("int"))
    return in_slices(rows, key).select(*names, *GROUP, "_query", "_near")


def in_blocks(rows: DataFrame, at: list[str], r: float) -> DataFrame:
    """Rows at finite places in their block of four radii, where ``_home`` is true, and in those that they reach into."""
    side, reach = 4 * r, r * (1 + 1e-9)
    for block, c in zip(GROUP[:3], at, strict=True):
        rows = rows.withColumn(block, F.explode(F.expr(f"sequence(floor(({c} - {reach!r}D) / {side!r}D), floor(({c} + {reach!r}D) / {side!r}D))")))
    return rows.withColumn("_home", F.expr(" and ".join(f"{block} = floor({c} / {side!r}D)" for block, c in zip(GROUP[:3], at, strict=True))))


def in_slices(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of blocks in ``_s`` slices by hash of ``key``: group (a, b) has the queries of slice a and what slice b has near them."""
    names = rows.columns
    rows = rows.withColumn("_k", F.pmod(F.xxhash64(*key), F.col("_s")).cast("int"))
    meets = "transform(sequence(0, _s - 1), k -> named_struct('_a', k, '_b', _k, '_query', _home and k = _k, '_near', true))"
    asks = "transform(filter(sequence(0, _s - 1), k -> _home and k <> _k), k -> named_struct('_a', _k, '_b', k, '_query', true, '_near', false))"
    return rows.select(*names, F.expr(f"inline(concat({meets}, {asks}))"))


def _cell_spans(cells: np.ndarray, rows: np.ndarray) -> dict[tuple, np.ndarray]:
    """Those rows by their cell."""
    if not len(rows):
        return {}
    rows = rows[np.lexsort(cells[rows].T[::-1])]
    kept, starts = np.unique(cells[rows], axis=0, return_index=True)
    return {tuple(c): rows[i:j] for c, i, j in zip(kept, starts, [*starts[1:], len(rows)], strict=True)}


def _within(at: np.ndarray, p: np.ndarray, q: np.ndarray, r2: float) -> np.ndarray:
    """Which of the rows p have one of q within reach; a few distances at a time, and none for those that have found one."""
    found = np.zeros(len(p), bool)
    step = max(1, 250_000 // max(1, len(p)))
    for k in range(0, len(q), step):
        open_ = np.flatnonzero(~found)
        if not len(open_):
            break
        dx, dy, dz = (at[q[k : k + step], c][None, :] - at[p[open_], c][:, None] for c in range(3))
        found[open_] = (dx * dx + dy * dy + dz * dz <= r2).any(1)
    return found


def _meets(at: np.ndarray, p: np.ndarray, q: np.ndarray, r2: float) -> bool:
    """Whether any of the rows p has one of q within reach."""
    step = max(1, 250_000 // max(1, len(q)))
    return any(_within(at, p[k : k + step], q, r2).any() for k in range(0, len(p), step))


def _finite() -> str:
    return " and ".join(f"abs({c}) < double('inf')" for c in "xyz")


#: Cells of a third of the cube about a ball: points of one cell are within reach of each other, cells of points within reach are at most two apart.
_TIGHT = (1 - 1e-6) / math.sqrt(3)


def linked_cells(points: DataFrame, r: float, by: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The graph of points within r of each other, by cells whose points are all within r: (by..., key, cell) and (by..., i, j) between cells; a cell is named by its smallest key.

    Of two cells only whether any points are within r is found out, inside a task, so what is shuffled grows with points and not with pairs.
    Points without a finite place are cells of their own.
    """
    side, cell = r * _TIGHT, ["_ci", "_cj", "_ck"]
    placed = points.where(_finite()).select(*by, F.col(key).alias("_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    at_cell = lambda df: df.withColumns({k: F.rint(F.col(c) / F.lit(side)) + 0.0 for k, c in zip(cell, "xyz", strict=True)})
    first = checkpointed(at_cell(placed).groupBy(*by, *cell).agg(F.min("_id").alias("cell")))
    steps = [k for k in itertools.product((-2, -1, 0, 1, 2), repeat=3) if k > (0, 0, 0)]

    def links(rows: pa.Table) -> pa.Table:
        at = np.column_stack([rows[c].to_numpy() for c in "xyz"])
        cells = np.rint(at / side) + 0.0
        spans = [_cell_spans(cells, np.flatnonzero(rows[c].to_numpy(zero_copy_only=False))) for c in ("_query", "_near")]
        found = [(*k, *m) for k in spans[0] for m in (tuple(np.add(k, s)) for s in steps) if m in spans[1] and _meets(at, spans[0][k], spans[1][m], r * r)]
        found = np.array(found, float).reshape(-1, 6)
        keys = {c: pa.array([rows[c][0].as_py()] * len(found), rows.schema.field(c).type) for c in by}
        return pa.table(keys | {f"{side}{c}": pa.array(found[:, 3 * n + k]) for n, side in enumerate("ab") for k, c in enumerate(cell)})

    kinds = "".join(f"`{c}` {placed.schema[c].dataType.simpleString()}, " for c in by)
    dealt = block_groups(placed, by, list("xyz"), ["_id"], r)
    found = dealt.groupBy(*by, *GROUP).applyInArrow(links, kinds + ", ".join(f"{s}{c} double" for s in "ab" for c in cell)).distinct()
    for s, name in (("a", "i"), ("b", "j")):
        found = found.join(first.withColumnsRenamed({c: f"{s}{c}" for c in cell} | {"cell": name}), [*by, *(f"{s}{c}" for c in cell)])
    whose = at_cell(placed).join(first, [*by, *cell]).select(*by, F.col("_id").alias(key), "cell")
    lone = points.where(~F.coalesce(F.expr(_finite()), F.lit(False))).select(*by, key, F.col(key).alias("cell"))
    return whose.unionByName(lone), found.select(*by, "i", "j")


def near_any(points: DataFrame, marked: str, r: float, by: list[str], key: str = "id") -> DataFrame:
    """(by..., key) of the points within r of a point where the column ``marked`` is true, itself included; only they leave a task."""
    placed = points.where(_finite()).select(*by, key, *(F.col(c).cast("double").alias(c) for c in "xyz"), F.col(marked).alias("_m"))

    def near(rows: pa.Table) -> pa.Table:
        at = np.column_stack([rows[c].to_numpy() for c in "xyz"])
        marks = rows["_near"].to_numpy(zero_copy_only=False) & rows["_m"].to_numpy(zero_copy_only=False)
        cells = np.rint(at / r)
        spans, hit = _cell_spans(cells, np.flatnonzero(marks)), np.zeros(len(rows), bool)
        for k, p in _cell_spans(cells, np.flatnonzero(rows["_query"].to_numpy(zero_copy_only=False))).items():
            for s in sorted(itertools.product((-2, -1, 0, 1, 2), repeat=3), key=lambda s: sum(map(abs, s))):
                q = spans.get(tuple(np.add(k, s)))
                if q is not None:
                    p = p[~hit[p]]
                    for n in range(0, len(p), 4096):
                        hit[p[n : n + 4096]] = _within(at, p[n : n + 4096], q, r * r)
        return rows.filter(pa.array(hit)).select([*by, key])

    kinds = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in (*by, key))
    return block_groups(placed, by, list("xyz"), [key], r).groupBy(*by, *GROUP).applyInArrow(near, kinds).distinct()


def radius_pairs(points: DataFrame, r: float, by: list[str], key: str = "id") -> DataFrame:
    """Each pair once (i < j)."""
    return radius_join(points, points, r, by, key, key).where("i < j")


def nearest(points: DataFrame, k: int, r: float, by: list[str], key: str = "id") -> DataFrame:
    """The k nearest others of each point, ties to the smaller id. Points with too few within r look within twice that, and so on.

    Everything outside the radius is farther than all inside, so a point is done once k are found; a group with fewer others gives all of them,
    at the latest when the radius covers the group's extent. Points without three finite coordinates have no neighbours and are none.
    """
    order = W.partitionBy(*by, "i").orderBy("d2", "j")
    points = points.where(" and ".join(f"abs({c}) < double('inf')" for c in "xyz"))  # false for NaN, which is over infinity
    extent = sum((F.max(c) - F.min(c) for c in "xyz"), F.lit(0.0))
    sizes = checkpointed(points.groupBy(*by).agg((F.count("*") - 1).alias("_others"), extent.alias("_extent")))
    # in dense groups the first radius is less, so that candidates do not grow with density; it changes no result
    r = min(r, max(r / 64, typical_radius(points, 2 * k, by)))
    found, todo = None, points
    while found is None or not todo.isEmpty():
        hits = radius_join(todo, points, r, by, key, key).where("i <> j").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        counts = todo.select(*by, F.col(key).alias("i")).join(hits.groupBy(*by, "i").agg(F.count("*").alias("_n")), [*by, "i"], "left").join(sizes, by)
        enough = F.coalesce("_n", F.lit(0)) >= F.least(F.lit(k), F.col("_others"))
        done = counts.where(enough | (F.col("_extent") < F.lit(r))).select(*by, "i")
        part = hits.join(done, [*by, "i"], "left_semi")
        found = part if found is None else found.unionAll(part)
        todo = checkpointed(todo.join(done.withColumnRenamed("i", key), [*by, key], "left_anti"))
        r *= 2
    return found.select(*by, "i", "j", "rank", "d2")


def typical_radius(points: DataFrame, n: int, by: list[str]) -> float:
    """The least over the groups of the radius of a ball that holds n points on average, by the sides of the group's box; infinity where no group has a volume."""
    volume = F.lit(1.0)
    for c in "xyz":
        volume = volume * (F.max(c) - F.min(c))
    each = points.where(_finite()).groupBy(*by).agg((F.cbrt(volume * n / (F.count("*") * (4 / 3 * math.pi)))).alias("_r"))
    return each.where("_r > 0 and _r < double('inf')").agg(F.min("_r")).first()[0] or math.inf


def pair_distribution(points: DataFrame, cutoff: float, n: int, by: list[str], key: str = "id") -> DataFrame:
    """Ordered pairs by distance bin, over the shell's volume and the number of points."""
    w = cutoff / n
    pairs = radius_pairs(points, cutoff, by, key)
    bins = pairs.groupBy(*by, F.least(F.floor(F.sqrt("d2") / w), F.lit(n - 1)).alias("bin")).agg((2 * F.count("*")).alias("n_pairs"))
    sizes = points.groupBy(*by).agg(F.count("*").alias("n_points"))
    shell = F.expr(f"{4 / 3 * math.pi}D * (power((bin + 1) * {w}D, 3) - power(bin * {w}D, 3))")
    return bins.join(sizes, by).select(*by, "bin", "n_pairs", (F.col("n_pairs") / (F.col("n_points") * shell)).alias("density"))


def first_peak(rdf: DataFrame, by: list[str]) -> DataFrame:
    """The bin of greatest density of each group."""
    return rdf.groupBy(*by).agg(F.max_by("bin", "density").alias("bin"), F.max("density").alias("density"))


def coordination(points: DataFrame, r: float, by: list[str], key: str = "id") -> DataFrame:
    """Neighbours of each point within r, itself counted."""
    return radius_join(points, points, r, by, key, key).groupBy(*by, "i").agg(F.count("*").alias("nnb"))


def nearest_value(grid: DataFrame, points: DataFrame, value: str, r: float, by: list[str]) -> DataFrame:
    """Value of the nearest point within r at each grid place."""
    pairs = radius_join(grid, points.withColumn("_v", F.struct(F.col("id").alias("id"), F.col(value).alias("v"))), r, by, "id", "_v")
    return pairs.groupBy(*by, "i").agg(F.min_by("j.v", F.struct("d2", "j.id")).alias(value))


def inverse_distance(grid: DataFrame, points: DataFrame, value: str, r: float, by: list[str], power: float = 2) -> DataFrame:
    """Inverse-distance mean within r: stands in for linear interpolation on a triangulation."""
    pairs = radius_join(grid, points.withColumn("_v", F.struct("id", F.col(value).alias("v"))), r, by, "id", "_v").withColumn("w", 1 / (F.pow(F.sqrt("d2"), F.lit(power)) + 1e-9))
    return pairs.groupBy(*by, "i").agg((F.sum(F.col("w") * F.col("j.v")) / F.sum("w")).alias(value))


def weld(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """Both point sets without doubles: of each point's neighbourhood within r, the smallest id stays (not transitive)."""
    both = a.unionByName(b)
    keep = radius_join(both.withColumn("g", F.lit(0)), both.withColumn("g", F.lit(0)), r, ["g"]).groupBy("i").agg(F.min("j").alias("id")).select("id").distinct()
    return both.join(keep, "id", "left_semi")


def line_samples(p: tuple, q: tuple, step: float = 0.5, extension: float = 0.3) -> str:
    """SQL of points every ``step`` along a segment made longer by a share at both ends."""
    d = [b - a for a, b in zip(p, q, strict=True)]
    n = math.sqrt(sum(x * x for x in d))
    count = int(n * (1 + 2 * extension) / step)
    at = lambda a, x: f"{a} + {x} * (-{extension} + k * {step} / {n})"
    return f"select k, {at(p[0], d[0])} as x, {at(p[1], d[1])} as y from (select explode(sequence(0, {count})) as k)"


def distance_to_line(rows: DataFrame, p: tuple, q: tuple) -> DataFrame:
    """Perpendicular offset (ox, oy) from a line in the plane, and its length."""
    dx, dy = q[0] - p[0], q[1] - p[1]
    t = f"((x - {p[0]}D) * {dx}D + (y - {p[1]}D) * {dy}D) / {dx * dx + dy * dy}D"
    rows = rows.withColumns({"ox": F.expr(f"x - ({p[0]}D + {dx}D * {t})"), "oy": F.expr(f"y - ({p[1]}D + {dy}D * {t})")})
    return rows.withColumn("offset", F.expr("sqrt(ox * ox + oy * oy)"))


def total_error(rows: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """sqrt of the summed squares of sigma times pixel size; -1 if a sigma is null."""
    e = F.sqrt(sum((F.pow(F.col(s) * px, F.lit(2)) for s, px in sigmas.items()), F.lit(0.0)))
    return rows.withColumn("total_error", F.coalesce(e, F.lit(-1.0)))


def resolve_doubles(points: DataFrame, cutoff: float, by: list[str], key: str = "id", error: str = "error") -> DataFrame:
    """``keep`` is false for a point with a neighbour of smaller error within the cutoff; equal errors keep the higher id, a null error counts as infinite.

    A point that loses any pair goes, even if the winner goes as well.
    """
    e = points.select(*by, F.col(key).alias("_k"), F.coalesce(F.nanvl(F.col(error), F.lit(None).cast("double")), F.lit(float("inf"))).alias("_e"))
    pairs = radius_pairs(points, cutoff, by, key).select(*by, "i", "j")
    pairs = pairs.join(e.withColumnsRenamed({"_k": "i", "_e": "ei"}), [*by, "i"]).join(e.withColumnsRenamed({"_k": "j", "_e": "ej"}), [*by, "j"])
    loser = F.when(F.col("ei") < F.col("ej"), F.col("j")).otherwise(F.col("i"))
    lost = pairs.select(*by, loser.alias(key)).distinct().withColumn("keep", F.lit(False))
    return points.join(lost, [*by, key], "left").withColumn("keep", F.coalesce("keep", F.lit(True)))
