"""Local strain: the best affine map of each particle's neighbourhood between two frames, in one aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.functions.tensor import SYM, von_mises, with_polar
from granulon.operators.balls import offset_sums
from granulon.operators.resampling import resample
from granulon.operators.spatial import GROUP, in_blocks, in_slices


PLACE = [f"{c}{k}" for k in (0, 1) for c in "xyz"]
SUMS = [f"x{a}{b}" for a in "xyz" for b in "xyz"] + ["yxx", "yxy", "yxz", "yyy", "yyz", "yzz", "cc"]


def paired(tracks: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ref, cur, particle, x0.., x1..) of the particles that both frames of a pair have; pairs are a small dimension."""
    return _met(tracks, pairs, by).select(*by, "ref", "cur", F.explode("_whose").alias("particle"), *PLACE)


def _kept(tracks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return tracks.select(*by, "particle", "frame", *(F.col(c).cast("double").alias(c) for c in "xyz")).where(" and ".join(f"`{c}` is not null" for c in (*by, "particle", "frame")))


def _met(tracks: DataFrame, pairs: DataFrame, by: tuple[str, ...], size: int = 1_000_000) -> DataFrame:
    """(by..., ref, cur, x0.., x1.., _whose): ``paired`` with the particles of a place as lists, as far as they come together in ``size`` tracks.

    Tracks are dealt by particle once; the rows of a pair meet where they are, so what is shuffled does not grow with the pairs of a frame.
    """
    dealt = _kept(tracks, by).repartition(*by, "particle").sortWithinPartitions(*by, "particle")
    wanted = [(r["ref"], r["cur"]) for r in pairs.select("ref", "cur").collect()]
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in (*by, "particle")}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("ref", "cur")), *(f"{c} double" for c in PLACE), f"_whose array<{kinds['particle']}>"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                rows = pa.Table.from_batches(held).combine_chunks()
                who = _numbered(rows, [*by, "particle"])
                last = int(np.searchsorted(who, who[-1]))  # the last particle may go on
                yield from _meetings(rows.slice(0, last), who[:last], wanted, by)
                held, n = rows.slice(last).to_batches(), n - last
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from _meetings(rows, _numbered(rows, [*by, "particle"]), wanted, by)

    return dealt.mapInArrow(meet, schema)


def _numbered(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's run of equal keys."""
    new = np.zeros(len(rows), bool)
    for c in keys:
        new[1:] |= pc.not_equal(rows[c][1:], rows[c][:-1]).to_numpy()
    return np.cumsum(new)


def _meetings(rows: pa.Table, who: np.ndarray, pairs: list[tuple], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """``_met`` of whole particles; ``who`` numbers them."""
    frame = rows["frame"].to_numpy()
    order = np.argsort(frame, kind="stable")
    frames, starts = np.unique(frame[order], return_index=True)
    at = dict(zip(frames.tolist(), np.split(order, starts[1:]), strict=True))
    left, right, which = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
    for k, (ref, cur) in enumerate(pairs):
        if ref in at and cur in at:
            a, b = at[ref], at[cur]
            low = np.searchsorted(who[b], who[a], "left")
            n = np.searchsorted(who[b], who[a], "right") - low
            left.append(np.repeat(a, n))
            right.append(b[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            which.append(np.full(n.sum(), k))
    left, right, which = (np.concatenate(x) for x in (left, right, which))
    if not len(left):
        return
    void = {c: rows[c].is_null().to_numpy() for c in "xyz"}
    place = {c: rows[c].fill_null(np.nan).to_numpy() + 0.0 for c in "xyz"}
    side = lambda k: left if k == "0" else right
    same = [which, _numbered(rows, list(by))[left], *(place[c[0]][side(c[1])] for c in PLACE)]
    name = np.zeros(len(left), "uint64")
    for c in same:
        name = (name ^ c.view("uint64")) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    order = np.argsort(name)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in same])
    first = order[new]
    whose = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(order)), pa.int32()), rows["particle"].take(pa.array(left[order])).combine_chunks())
    out = {c: rows[c].take(pa.array(left[first])) for c in by} | {c: pa.array([p[k] for p in pairs]).take(pa.array(which[first])) for k, c in enumerate(("ref", "cur"))}
    out |= {c: pa.array(place[c[0]][side(c[1])[first]], mask=void[c[0]][side(c[1])[first]]) for c in PLACE}
    yield from pa.table(out | {"_whose": whose}).to_batches(max_chunksize=20_000)


def neighbour_sums(tracks: DataFrame, pairs: DataFrame, r: float, by: tuple[str, ...] = (), most: int = 200_000) -> DataFrame:
    """Sums over the reference neighbours (self included, which adds nothing) of products of offsets, by (by..., ref, cur, particle); incomplete tracks go first.

    Particles with the same two places have the same sums, so what is sent and worked out is places with their particles as lists. Places go to blocks of four
    radii and to the blocks that they reach into, where a task sums over their neighbours (see ``balls``): no edge leaves it, and a block's sums are whole.
    Only a block of more than ``most`` rows is dealt into slices, every slice meets every slice, and sums over slices add up.
    """
    return _about(tracks, pairs, r, by, most, lambda s: s, [*SUMS, "nnb_count"])


def _about(tracks: DataFrame, pairs: DataFrame, r: float, by: tuple[str, ...], most: int, measures, named: list[str]) -> DataFrame:
    """(by..., ref, cur, particle) with the columns ``named`` that ``measures`` makes of the sums: arrays by name, masked where they are null."""
    keys, block = [*by, "ref", "cur"], list(GROUP[:3])
    finite = lambda cols: " and ".join(f"abs({c}) < double('inf')" for c in cols)
    # no pair of frames has more places than its first frame: which blocks there are, and which are dense, follows from the tracks
    homes = in_blocks(_kept(tracks, by).where(finite("xyz")).withColumnRenamed("frame", "ref"), list("xyz"), r)
    counts = homes.groupBy(*by, "ref", *block).agg(F.count("*").alias("_n"), F.max("_home").alias("_own")).where("_own and _n > 0")
    extent = counts.groupBy(*by, "ref").agg(*(f(b).alias(f"{b}_{n}") for b in block for f, n in ((F.min, "low"), (F.max, "high"))))
    dense = F.broadcast(counts.where(F.col("_n") > most).select(*by, "ref", *block, F.ceil(F.col("_n") / most).cast("int").alias("_s")))
    rows = _met(tracks, pairs, by).where(" and ".join([finite(PLACE[:3]), *(f"{c} is not null" for c in ("ref", "cur"))]))
    rows = in_blocks(rows, PLACE[:3], r).join(F.broadcast(extent), [*by, "ref"]).where(" and ".join(f"{b} between {b}_low and {b}_high" for b in block))
    rows = rows.select(*keys, *block, *PLACE, F.size("_whose").cast("double").alias("_w"), "_home", F.when(F.col("_home"), F.col("_whose")).alias("_whose"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    values = ", ".join(f"{c} {'long' if c == 'nnb_count' else 'double'}" for c in named)
    whose = f"_whose {rows.schema['_whose'].dataType.simpleString()}"

    def whole(block_rows: pa.Table) -> pa.Table:
        found, sums = _block_sums(block_rows, "_home", "_w", r)
        return _named(block_rows.select([*keys, "_whose"]).take(pa.array(found)), measures(sums), named)

    light = rows.join(dense, [*by, "ref", *block], "left_anti").groupBy(*keys, *block).applyInArrow(whole, f"{kinds}, {whose}, {values}")
    heavy = _in_slices(rows.join(dense, [*by, "ref", *block]), keys, kinds, r)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = {c: np.ma.masked_array(batch[c].fill_null(0).to_numpy(zero_copy_only=False), batch[c].is_null().to_numpy(zero_copy_only=False)) for c in (*SUMS, "nnb_count")}
            yield from _named(pa.Table.from_batches([batch]).select([*keys, "_whose"]), measures(sums), named).to_batches()

    found = light.unionByName(heavy.mapInArrow(finish, f"{kinds}, {whose}, {values}"))
    return found.select(*keys, F.explode("_whose").alias("particle"), *named)


def _in_slices(rows: DataFrame, keys: list[str], kinds: str, r: float) -> DataFrame:
    """(keys..., _whose, sums) of the rows of dense blocks, in ``_s`` slices."""
    place = ["_h0", "_h1"]
    # 96 bits name a place: doubles as keys would be shuffled once more for each use
    named = [*PLACE, *(F.col(c).isNull() for c in PLACE[3:])]
    rows = rows.withColumns({"_h0": F.xxhash64(*named), "_h1": F.hash(*named)})
    own = rows.where("_home").select(*keys, *place, "_whose")
    schema = f"{kinds}, _h0 long, _h1 int, {', '.join(f'{c} double' for c in SUMS)}, nnb_count long"

    def part(group: pa.Table) -> pa.Table:
        # rows of one place have the same sums
        query = np.flatnonzero(group["_query"].to_numpy(zero_copy_only=False))
        names = np.column_stack([group[c].to_numpy()[query].astype("int64") for c in place])
        asks = np.zeros(len(group), bool)
        asks[query[np.unique(names, axis=0, return_index=True)[1]]] = True
        found, sums = _block_sums(group.set_column(group.schema.get_field_index("_query"), "_query", pa.array(asks)), "_query", "_w", r)
        return _named(group.select([*keys, *place]).take(pa.array(found)), sums, [*SUMS, "nnb_count"])

    sliced = in_slices(rows.drop("_whose"), place).drop("_s", "_home")
    sums = sliced.groupBy(*keys, *GROUP).applyInArrow(part, schema).groupBy(*keys, *place).agg(*(F.sum(c).alias(c) for c in (*SUMS, "nnb_count")))
    return own.join(sums, [*keys, *place]).select(*keys, "_whose", *SUMS, "nnb_count")


def _block_sums(rows: pa.Table, query: str, weight: str, r: float) -> tuple[np.ndarray, dict]:
    """Rows of a block that have sums, and the sums by name, masked where the place now is null."""
    at = np.column_stack([rows[c].to_numpy() for c in PLACE[:3]])
    now = np.column_stack([rows[c].fill_null(0.0).to_numpy() for c in PLACE[3:]])
    void = np.column_stack([rows[c].is_null().to_numpy() for c in PLACE[3:]])
    near = rows["_near"].to_numpy(zero_copy_only=False) if "_near" in rows.column_names else np.ones(len(rows), bool)
    found, x, y, cc, count = offset_sums(at, now, void, rows[weight].to_numpy(), rows[query].to_numpy(zero_copy_only=False), near, r)
    lost = void[found]
    sums = {f"x{a}{b}": np.ma.masked_array(x[:, i, j], lost[:, i]) for i, a in enumerate("xyz") for j, b in enumerate("xyz")}
    sums |= {f"y{a}{b}": np.ma.masked_array(y[:, "xyz".index(a), "xyz".index(b)]) for a, b in SYM}
    return found, sums | {"cc": np.ma.masked_array(cc, lost.any(1)), "nnb_count": np.ma.masked_array(count)}


def _named(rows: pa.Table, values: dict, named: list[str]) -> pa.Table:
    for c in named:
        rows = rows.append_column(c, pa.array(np.ma.getdata(values[c]), mask=np.ma.getmaskarray(values[c])))
    return rows


def _sums() -> list:
    """Sums of products of offsets now (c) and before (r)."""
    s = lambda name, e: F.sum(F.expr(e)).alias(name)
    sums = [s(f"x{a}{b}", f"c{a} * r{b}") for a in "xyz" for b in "xyz"] + [s(f"y{a}{b}", f"r{a} * r{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    extra = [s("cc", "cx * cx + cy * cy + cz * cz"), F.count("*").alias("nnb_count")] + [s(f"d{a}", f"c{a} - r{a}") for a in "xyz"] + [s("dd", "(cx - rx) * (cx - rx) + (cy - ry) * (cy - ry) + (cz - rz) * (cz - rz)")]
    return [*sums, *extra]


def local_strain(tracks: DataFrame, pairs: DataFrame, r: float, tolerance: float = 1e-9, by: tuple[str, ...] = (), most: int = 200_000) -> DataFrame:
    """Gradient f, strain e, rotation r, d2_min, von_mises and nnb_count by (by..., ref, cur, particle); null where the neighbourhood is flat."""
    return _about(tracks, pairs, r, by, most, lambda sums: _affine_arrays(sums, tolerance), MEASURES)


MEASURES = ["d2_min", "von_mises", *(f"e{k}" for k in SYM), "rxy", "rxz", "ryz", *(f"f{a}{b}" for a in "xyz" for b in "xyz"), "nnb_count"]


def _affine_arrays(s: dict, tolerance: float) -> dict:
    """``affine`` of arrays."""
    with np.errstate(all="ignore"):
        y = {a + b: np.ma.getdata(s["y" + "".join(sorted(a + b))]) for a in "xyz" for b in "xyz"}
        k = {"xx": y["yy"] * y["zz"] - y["yz"] * y["yz"], "xy": y["xz"] * y["yz"] - y["xy"] * y["zz"], "xz": y["xy"] * y["yz"] - y["xz"] * y["yy"], "yy": y["xx"] * y["zz"] - y["xz"] * y["xz"], "yz": y["xy"] * y["xz"] - y["xx"] * y["yz"], "zz": y["xx"] * y["yy"] - y["xy"] * y["xy"]}
        k |= {"yx": k["xy"], "zx": k["xz"], "zy": k["yz"]}
        det = y["xx"] * k["xx"] + y["xy"] * k["xy"] + y["xz"] * k["xz"]
        flat = np.abs(det) <= tolerance * ((y["xx"] + y["yy"] + y["zz"]) / 3) ** 3
        data, lost = {c: np.ma.getdata(v) for c, v in s.items()}, {c: np.ma.getmaskarray(v) for c, v in s.items()}
        f = {a + b: sum(data[f"x{a}{c}"] * k[c + b] for c in "xyz") / np.where(flat, 1.0, det) for a in "xyz" for b in "xyz"}
        gone = {a: flat | lost[f"x{a}x"] for a in "xyz"}
        mask = lambda v, *axes: np.ma.masked_array(v, np.logical_or.reduce([gone[a] for a in axes]))
        e = {a + b: (f[a + b] + f[b + a]) / 2 - (1 if a == b else 0) for a, b in SYM}
        out = {f"e{c}": mask(v, *c) for c, v in e.items()} | {f"f{c}": mask(v, c[0]) for c, v in f.items()}
        out |= {f"r{a}{b}": mask((f[a + b] - f[b + a]) / 2, a, b) for a, b in ("xy", "xz", "yz")}
        d2 = data["cc"] - sum(f[a + b] * data[f"x{a}{b}"] for a in "xyz" for b in "xyz")
        # as greatest() in columns: what is null is passed over, and NaN is greatest
        d2 = np.where(np.logical_or.reduce([lost["cc"], *gone.values()]), 0.0, np.where(d2 < 0, 0.0, d2))
        spread = (e["xx"] - e["yy"]) ** 2 + (e["yy"] - e["zz"]) ** 2 + (e["zz"] - e["xx"]) ** 2
        return out | {"d2_min": np.ma.masked_array(d2), "von_mises": mask(np.sqrt(spread / 2 + 3 * (e["xy"] ** 2 + e["xz"] ** 2 + e["yz"] ** 2)), *"xyz"), "nnb_count": s["nnb_count"]}


def affine(m: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """The best affine map of each row of sums, and what follows from it."""
    m = m.withColumns({"k1": F.expr("yyy * yzz - yyz * yyz"), "k2": F.expr("yxz * yyz - yxy * yzz"), "k3": F.expr("yxy * yyz - yxz * yyy"), "k4": F.expr("yxx * yzz - yxz * yxz"), "k5": F.expr("yxy * yxz - yxx * yyz"), "k6": F.expr("yxx * yyy - yxy * yxy")})
    m = m.withColumn("det", F.expr("yxx * k1 + yxy * k2 + yxz * k3"))
    m = m.withColumn("det", F.expr(f"if(abs(det) <= {tolerance}D * power((yxx + yyy + yzz) / 3, 3), null, det)"))
    inverse = {"xx": "k1", "xy": "k2", "xz": "k3", "yx": "k2", "yy": "k4", "yz": "k5", "zx": "k3", "zy": "k5", "zz": "k6"}
    m = m.withColumns({f"f{a}{b}": F.expr("(" + " + ".join(f"x{a}{c} * {inverse[c + b]}" for c in "xyz") + ") / det") for a in "xyz" for b in "xyz"})
    sym = {f"e{a}{b}": F.expr(f"(f{a}{b} + f{b}{a}) / 2" + (" - 1" if a == b else "")) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    skew = {f"r{a}{b}": F.expr(f"(f{a}{b} - f{b}{a}) / 2") for a, b in ("xy", "xz", "yz")}
    # |c - F r|^2 summed = |c|^2 - tr(F X')
    m = m.withColumns(sym | skew | {"d2_min": F.expr("greatest(cc - (" + " + ".join(f"f{a}{b} * x{a}{b}" for a in "xyz" for b in "xyz") + "), 0)")})
    m = m.withColumn("von_mises", von_mises(*(F.col(f"e{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz"))))
    return m.select(*keys, "d2_min", "von_mises", *sym, *skew, *(f"f{a}{b}" for a in "xyz" for b in "xyz"), "nnb_count")


def cluster_strain(both: DataFrame, members: DataFrame, by: list[str], tolerance: float = 1e-9) -> DataFrame:
    """The best affine map of each cluster as a whole, about its member that was nearest to the cluster's centre: from (by..., id, x0.., x1..) to the columns of ``local_strain`` by (by..., cluster).

    Equal distances take the smaller id; a cluster of fewer than four members, or a flat one, has null strain.
    """
    keys = [*by, "cluster"]
    rows = both.join(members.where("cluster > 0"), [*by, "id"])
    middle = rows.groupBy(*keys).agg(*(F.avg(f"{c}0").alias(f"m{c}") for c in "xyz"))
    apart = F.expr(" + ".join(f"({c}0 - m{c}) * ({c}0 - m{c})" for c in "xyz"))
    nearest = rows.join(middle, keys).groupBy(*keys).agg(F.min(F.struct(apart.alias("d"), "id", *(F.col(f"{c}{k}").alias(f"{c}c{k}") for c in "xyz" for k in (0, 1)))).alias("n"))
    rows = rows.join(nearest.select(*keys, "n.*").drop("d", "id"), keys)
    rows = rows.withColumns({f"r{c}": F.expr(f"{c}0 - {c}c0") for c in "xyz"} | {f"c{c}": F.expr(f"{c}1 - {c}c1") for c in "xyz"})
    return affine(rows.groupBy(*keys).agg(*_sums()), keys, tolerance)


def polar(strain: DataFrame) -> DataFrame:
    """Stretch, rotation and its angle of the same gradients, by (ref, cur, particle)."""
    return with_polar(strain.select("ref", "cur", "particle", *(f"f{a}{b}" for a in "xyz" for b in "xyz"), "nnb_count"))


def resampled_strain(tracks: DataFrame, pairs: DataFrame, r: float, n: int, sigma: dict[str, float], seed: int = 42) -> DataFrame:
    """How errors of position carry over to strain: mean and deviation of each particle's components over ``n`` noisy replicates, all of them in one neighbour join.

    The noise of a particle and frame depends on the seed and on them alone, so results do not change with partitions.
    """
    noisy = resample(tracks, n, sigma, seed, key=["frame", "particle"]).where("replicate > 0")
    found = local_strain(noisy, pairs, r, by=("replicate",))
    parts = ["exx", "exy", "exz", "eyy", "eyz", "ezz", "von_mises"]
    return found.groupBy("ref", "cur", "particle").agg(F.count("exz").alias("n"), *(F.avg(c).alias(f"{c}_mean") for c in parts), *(F.stddev_samp(c).alias(f"{c}_std") for c in parts))


def green_lagrange(strain: DataFrame) -> DataFrame:
    """E = (F'F - 1) / 2 of the same gradients, its shear invariant and its trace third."""
    g = {f"g{a}{b}": F.expr("(" + " + ".join(f"f{c}{a} * f{c}{b}" for c in "xyz") + (" - 1" if a == b else "") + ") / 2") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    s = strain.withColumns(g)
    shear = F.expr("sqrt(gxy * gxy + gxz * gxz + gyz * gyz + ((gxx - gyy) * (gxx - gyy) + (gxx - gzz) * (gxx - gzz) + (gyy - gzz) * (gyy - gzz)) / 6)")
    return s.select("ref", "cur", "particle", *g, shear.alias("shear"), F.expr("(gxx + gyy + gzz) / 3").alias("volumetric"), "nnb_count")


def mean_strain(strain: DataFrame, least: int = 9) -> DataFrame:
    """Means by frame pair over well-coordinated particles, and percentages."""
    found = strain.where(F.col("nnb_count") >= least).groupBy("ref", "cur").agg(F.count("*").alias("n"), F.avg("exz").alias("exz"), F.avg("eyz").alias("eyz"), F.avg("von_mises").alias("von_mises"), F.stddev_samp("exz").alias("exz_std"))
    return found.withColumns({"shear_percent": F.expr("exz * 200"), "von_mises_percent": F.expr("von_mises * 100"), "std_per_n": F.expr("exz_std / n")})


def rotate_positions(tracks: DataFrame, r, cols=("x", "y", "z")) -> DataFrame:
    from granulon.functions.tensor import rotate_vector

    return tracks.withColumns(dict(zip(cols, rotate_vector(r, *(F.col(c) for c in cols)), strict=True)))


def split_by_peak(strain: DataFrame, threshold: float) -> DataFrame:
    """Mean von Mises strain by current frame of the particles whose greatest exceeds a threshold, and of the rest."""
    peaked = strain.select("cur", "von_mises", F.max("von_mises").over(W.partitionBy("particle")).alias("_p"))
    return peaked.groupBy("cur").agg(F.avg(F.when(F.col("_p") > threshold, F.col("von_mises"))).alias("high"), F.avg(F.when(F.col("_p") <= threshold, F.col("von_mises"))).alias("low"))
