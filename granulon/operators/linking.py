"""Linking of locations into trajectories.

Without memory a link from t to t + 1 depends on those two frames alone, so all pairs of frames link at once: subnets from least spanning
forests of the candidates, one least-cost assignment for each subnet, and chains closed by pointer jumping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.operators.clusters import components
from granulon.operators.lineage import checkpointed
from granulon.operators.spatial import GROUP, block_groups
from granulon.operators.subnets import assign_sparse, cut, forest, least_forest, near_pairs


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of a matrix with at least as many columns as rows (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        owner[m], col = row, m
        least, back, seen = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[col] >= 0:
            seen[col] = True
            r = owner[col]
            slack = cost[r] - u[r] - v[:m]
            better = ~seen[:m] & (slack < least)
            least[better], back[better] = slack[better], col
            nxt = int(np.where(seen[:m], np.inf, least).argmin())
            delta = least[nxt]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen[:m]] -= delta
            col = nxt
        while col != m:
            owner[col], col = owner[back[col]], back[col]
    out = np.full(n, -1)
    out[owner[:m][owner[:m] >= 0]] = np.flatnonzero(owner[:m] >= 0)
    return out


def predict_shear(rows: DataFrame, f: np.ndarray, shift: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Positions as an affine map expects them in the next frame."""
    return rows.withColumns({c: sum((float(f[i][j]) * F.col("xyz"[j]) for j in range(3)), F.lit(float(shift[i]))) for i, c in enumerate("xyz")})


def links(locations: DataFrame, search: float, predicted: DataFrame | None = None, gap: int = 1, by: tuple[str, ...] = (), **options) -> DataFrame:
    """(frame, by..., a, b): location a of a frame continues as b of the frame ``gap`` later, within the groups of ``by``; options as in ``matches``."""
    keys = ["frame", *by]
    a = (locations if predicted is None else predicted).select(*keys, "id", "x", "y", "z")
    b = locations.select((F.col("frame") - gap).alias("frame"), *by, "id", "x", "y", "z")
    return matches(a, b, search, keys, **options)


def matches(a: DataFrame, b: DataFrame, search: float, keys: list[str], most: int = 30, shrink: float = 0.95, stop: float = 0.1, whole: int = 20_000, largest: int | None = None) -> DataFrame:
    """(keys..., a, b): the least-cost assignment of sources (keys..., id, x, y, z) to targets of the same keys within the search range.

    Leaving a source unlinked costs search^2. A subnet with more than ``most`` sources drops its longest candidates step by step (``shrink``
    down to ``stop`` of the range) until its parts are small enough. Candidates are never a table: a task makes those of its places. Groups of
    up to ``whole`` places take one task each; larger ones go through blocks of space, whose least forests show the subnets, and then no group
    is larger than a subnet. ``largest`` is a bound of the groups' places, where it is known.
    """
    how = (search, most, shrink, stop)
    usable = " and ".join([f"{c} is not null" for c in keys] + [f"abs({c}) < double('inf')" for c in "xyz"])
    side = lambda df, n: df.where(usable).select(*keys, "id", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.lit(n).alias("_side"))
    rows = side(a, 0).unionAll(side(b, 1))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def whole_group(pdf: pd.DataFrame) -> pd.DataFrame:
        (left, p), (right, q) = _sides(pdf)
        return _named(pdf, keys, left, right, _links_of(p, q, *how))

    in_one = lambda df: df.groupBy(*keys).applyInPandas(whole_group, f"{kinds}, a long, b long")
    if largest is not None and largest <= whole:
        return in_one(rows)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work is by pairs: small tables are spread as well
    large = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > whole).select(*keys))
    if large.isEmpty():
        return in_one(rows.repartition(parts, *keys))
    return in_one(rows.join(large, keys, "left_anti").repartition(parts, *keys)).unionAll(_in_blocks(rows.join(large, keys), keys, kinds, how))


def _sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and places of sources and of targets, each by id."""
    pdf = pdf.sort_values("id")
    return [(part["id"].to_numpy(), part[["x", "y", "z"]].to_numpy(float)) for part in (pdf[pdf["_side"] == n] for n in (0, 1))]


def _named(pdf: pd.DataFrame, keys: list[str], left: np.ndarray, right: np.ndarray, pairs) -> pd.DataFrame:
    found = pd.DataFrame({"a": left[pairs[0]], "b": right[pairs[1]]}).astype("int64")
    for n, c in enumerate(keys):
        found.insert(n, c, pdf[c].iloc[0])
    return found


def _links_of(p: np.ndarray, q: np.ndarray, search: float, most: int, shrink: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of two sets of places."""
    i, j, d2 = forest(p, q, search, stop * search)
    subnet, limits = cut(len(p), len(p) + len(q), i, len(p) + j, d2, search, most, shrink, stop)
    on = np.flatnonzero(subnet >= 0)
    on = on[np.argsort(subnet[on], kind="stable")]
    parts = np.split(on, np.flatnonzero(np.diff(subnet[on])) + 1) if len(on) else []
    out = [(np.zeros(0, int), np.zeros(0, int))]
    for part in parts:
        src, dst = part[part < len(p)], part[part >= len(p)] - len(p)
        row, col = _solved(p[src], q[dst], limits[part[0]], search)
        out.append((src[row], dst[col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _solved(p: np.ndarray, q: np.ndarray, limit: float, search: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of the places of one subnet, along its candidates within ``limit``."""
    n, m = len(p), len(q)
    if n * m <= 10_000:
        dx, dy, dz = (q[None, :, c] - p[:, None, c] for c in range(3))
        d2 = dx * dx + dy * dy + dz * dz
        cost = np.full((n, m + n), 1e12)
        cost[:, :m] = np.where(d2 <= limit * limit, d2, 1e12)
        cost[np.arange(n), m + np.arange(n)] = search * search
        got = assign(cost)
        got = np.where(got < m, got, -1)
    elif n > m:  # what stays unlinked of either side costs the same but for a constant, and each row without a column is a long search
        col, row = _solved(q, p, limit, search)
        order = np.argsort(row)
        return row[order], col[order]
    else:
        i, j, d2 = (np.concatenate(x) for x in zip(*near_pairs(p, q, limit), strict=True))
        got = assign_sparse(n, m, i, j, d2, search * search)
    row = np.flatnonzero(got >= 0)
    return row, got[row]


def _in_blocks(rows: DataFrame, keys: list[str], kinds: str, how: tuple) -> DataFrame:
    """``matches`` of large groups: least forests of blocks, their components, the cut of each, and one assignment for each subnet."""
    search, most, shrink, stop = how

    def block_forest(pdf: pd.DataFrame) -> pd.DataFrame:
        (left, p), (right, q) = _sides(pdf)
        i, j, d2 = forest(p, q, search, stop * search)
        return _named(pdf, keys, left, right, (i, j)).assign(d2=d2)

    dealt = block_groups(rows, keys, ["x", "y", "z"], ["_side", "id"], search).where("if(_side = 0, _query, _near)")
    edges = checkpointed(dealt.groupBy(*keys, *GROUP).applyInPandas(block_forest, f"{kinds}, a long, b long, d2 double"))
    # sources are even nodes and targets odd ones of a bipartite graph
    graph = edges.select(*keys, (2 * F.col("a")).alias("i"), (2 * F.col("b") + 1).alias("j"))
    nodes = graph.select(*keys, F.col("i").alias("id")).unionAll(graph.select(*keys, F.col("j").alias("id"))).distinct()
    net = components(checkpointed(nodes), graph, keys)
    net = edges.join(net.where("id % 2 = 0").select(*keys, F.expr("id div 2").alias("a"), "root"), [*keys, "a"])

    def subnets(pdf: pd.DataFrame) -> pd.DataFrame:
        (left, i), (right, j) = (np.unique(pdf[c].to_numpy(), return_inverse=True) for c in "ab")
        n, d2 = len(left), pdf["d2"].to_numpy()
        kept, _ = least_forest(np.arange(n + len(right)), i, n + j, d2)
        subnet, limits = cut(n, n + len(right), i[kept], n + j[kept], d2[kept], search, most, shrink, stop)
        out = pd.DataFrame({"id": np.concatenate([left, right]), "_side": np.repeat([0, 1], [n, len(right)]).astype("int32"), "_subnet": subnet, "_limit": limits})
        for k, c in enumerate([*keys, "root"]):
            out.insert(k, c, pdf[c].iloc[0])
        return out[subnet >= 0]

    members = net.groupBy(*keys, "root").applyInPandas(subnets, f"{kinds}, root long, id long, _side int, _subnet long, _limit double")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        (left, p), (right, q) = _sides(pdf)
        return _named(pdf, keys, left, right, _solved(p, q, pdf["_limit"].iloc[0], search))

    return rows.join(members, [*keys, "_side", "id"]).groupBy(*keys, "root", "_subnet").applyInPandas(solve, f"{kinds}, a long, b long")


def link(locations: DataFrame, search: float, **options) -> DataFrame:
    """Locations (frame, id, x, y, z; id unique over all) with ``particle``: the id of its trajectory's first location."""
    return _chained(locations, links(locations, search, **options))


def _chained(locations: DataFrame, found: DataFrame) -> DataFrame:
    """Trajectories of links (a, b), by pointer jumping."""
    head = checkpointed(locations.select("id").join(found.select(F.col("b").alias("id"), F.col("a").alias("head")), "id", "left").select("id", F.coalesce("head", "id").alias("head")))
    while True:
        jump = head.select(F.col("id").alias("head"), F.col("head").alias("next"))
        after = checkpointed(head.join(jump, "head").select("id", F.col("next").alias("head"), (F.col("next") != F.col("head")).alias("moved")))
        head = after.select("id", "head")
        if after.where("moved").isEmpty():
            return locations.join(head.withColumnRenamed("head", "particle"), "id")


def continue_tracks(tracks: DataFrame, present: DataFrame, search: float, memory: int, frame: int, by: str, **options) -> tuple[DataFrame, DataFrame]:
    """One frame's locations with their ``particle``, and the tracks after it.

    Tracks (by, particle, id, x, y, z, seen) hold each track's last place and frame. Those seen in the ``memory`` + 1 frames before this one
    compete for its locations in one assignment, at the places where they were seen last; older ones have ended.
    """
    alive = tracks.where(F.col("seen") >= frame - 1 - memory)
    got = matches(alive.select(by, "id", "x", "y", "z"), present.select(by, "id", "x", "y", "z"), search, [by], **options).select(F.col("a").alias("_last"), F.col("b").alias("id"))
    got = checkpointed(got.join(alive.select(F.col("id").alias("_last"), "particle"), "_last"))
    waiting = alive.join(got.select(F.col("_last").alias("id")), "id", "left_anti")
    here = present.select(by, "id", "x", "y", "z").join(got.select("id", "particle"), "id", "left")
    here = here.select(by, F.coalesce("particle", "id").alias("particle"), "id", "x", "y", "z", F.lit(frame).cast("long").alias("seen"))
    after = checkpointed(waiting.unionByName(here))
    return present.join(after.where(F.col("seen") == frame).select("id", "particle"), "id"), after


def no_tracks(locations: DataFrame, by: str) -> DataFrame:
    """The tracks before the first frame of a table of locations."""
    return locations.select(by, F.col("id").alias("particle"), "id", "x", "y", "z", F.col("frame").cast("long").alias("seen")).limit(0)


def link_with_memory(locations: DataFrame, search: float, memory: int, by: str = "material", whole: int = 200_000, **options) -> DataFrame:
    """Trajectories of particles that may be unseen for ``memory`` frames: present and remembered ones compete for the places of the next frame.

    A frame depends on the one before, so frames go one after the other, each as joins over all its materials. Blocks and subnets are some hundred jobs a
    frame, which the driver keeps account of, and a task holds no candidates but those of a subnet: so up to ``whole`` places of a frame and material, more
    than for frames that link at once, take one task. ``id`` is unique over all; rows without frame, ``by`` or a finite place are trajectories of their own.
    """
    usable = F.expr(f"frame is not null and {by} is not null and " + " and ".join(f"abs({c}) < double('inf')" for c in "xyz"))
    rows = locations.select("frame", by, "id", "x", "y", "z")
    usable = F.coalesce(usable, F.lit(False))
    found, tracks = rows.where(~usable).withColumn("particle", F.col("id")).select("id", "particle"), no_tracks(rows, by)
    rows = checkpointed(rows.where(usable))
    most = rows.groupBy("frame", by).agg(F.count("*").alias("n")).groupBy("frame").agg(F.max("n").alias("n"))
    most = dict(sorted((r["frame"], r["n"]) for r in most.collect()))  # a row for each frame
    for frame in most:
        near = sum(n for k, n in most.items() if frame - 1 - memory <= k <= frame)
        _, tracks = continue_tracks(tracks, rows.where(F.col("frame") == frame), search, memory, frame, by, largest=near, whole=whole, **options)
        found = found.unionByName(tracks.where(F.col("seen") == frame).select("id", "particle"))
    return locations.join(found, "id")
