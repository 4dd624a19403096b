"""Column expressions on vectors and symmetric 3 x 3 tensors, flattened as (xx, xy, xz, yy, yz, zz)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYM = ("xx", "xy", "xz", "yy", "yz", "zz")


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """Descending, in closed form (the angle of the characteristic cubic)."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.least(F.greatest(F.try_divide(det, 2 * p * p * p), F.lit(-1.0)), F.lit(1.0))
    phi = F.acos(r) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return F.when(p == 0, F.array(q, q, q)).otherwise(F.array(first, 3 * q - first - last, last))


def von_mises(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """sqrt(half the squared differences of the diagonal and three times the squares beside it)."""
    d = (xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)
    return F.sqrt(d / 2 + 3 * (xy * xy + xz * xz + yz * yz))


def shear_strain(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    d = (xx - yy) * (xx - yy) + (xx - zz) * (xx - zz) + (yy - zz) * (yy - zz)
    return F.sqrt(xy * xy + xz * xz + yz * yz + d / 6)


def rotation(axis: str, degrees: float) -> np.ndarray:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return np.array({"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis])


def rotate_vector(r: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    return [float(k[0]) * x + float(k[1]) * y + float(k[2]) * z for k in r]


def rotate_tensor(r: np.ndarray, *t: Column) -> dict[str, Column]:
    """R e R' of a symmetric tensor, by component."""
    full = {k: v for k, v in zip(SYM, t, strict=True)}
    at = lambda i, j: full["".join(sorted("xyz"[i] + "xyz"[j]))]
    return {k: sum((float(r["xyz".index(k[0]), a] * r["xyz".index(k[1]), b]) * at(a, b) for a in range(3) for b in range(3)), F.lit(0.0)) for k in SYM}


def rodrigues(v: list[Column], k: list[Column], angle: float) -> list[Column]:
    """v turned about the unit vector k."""
    c, s = math.cos(angle), math.sin(angle)
    cross = [k[1] * v[2] - k[2] * v[1], k[2] * v[0] - k[0] * v[2], k[0] * v[1] - k[1] * v[0]]
    dot = k[0] * v[0] + k[1] * v[1] + k[2] * v[2]
    return [v[i] * c + cross[i] * s + k[i] * dot * (1 - c) for i in range(3)]


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: a lambda variable is not copied into every place that uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def eigenvectors(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """Unit eigenvectors of a symmetric tensor as rows u, v, w by descending eigenvalue, nine numbers.

    The eigenvalue that is further from the middle one goes first: its vector is the longest cross product of two rows of A - lambda. The others are the axes of the tensor in the plane
    across it, so a double root gives an orthonormal pair too, and a triple one the coordinate axes. The largest component of each is positive; null where a component is null or not finite.
    """
    given = [c.cast("double") for c in (xx, xy, xz, yy, yz, zz)]
    ok = reduce(lambda x, y: x & y, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in given])
    vector = lambda s, name: [F.get(s[name], i) for i in range(3)]
    cross = lambda a, b: F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    up = lambda c: F.when(F.array_max(F.transform(c, F.abs)) > F.array_max(c), F.transform(c, lambda e: -e)).otherwise(c)

    def isolated(a: Column) -> Column:
        v = [F.get(a.v, i) for i in range(3)]
        top = v[0] - v[1] >= v[1] - v[2]
        return let(F.struct(top.alias("top"), F.when(top, v[0]).otherwise(v[2]).alias("l")), lambda s: products(a, s))

    def products(a: Column, s: Column) -> Column:
        lines = [(a.xx - s.l, a.xy, a.xz), (a.xy, a.yy - s.l, a.yz), (a.xz, a.yz, a.zz - s.l)]
        longest = lambda cs: F.array_max(F.transform(cs, lambda c: F.struct(F.aggregate(c, F.lit(0.0), lambda t, e: t + e * e).alias("n"), c.alias("c"))))
        unit = lambda b: F.when(b.n > 0, F.transform(b.c, lambda e: e / F.sqrt(b.n))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        return let(longest(F.array(*(cross(lines[i], lines[j]) for i, j in ((0, 1), (0, 2), (1, 2))))), lambda b: let(F.struct(unit(b).alias("w")), lambda w: across(a, s, w)))

    def across(a: Column, s: Column, first: Column) -> Column:
        w = vector(first, "w")
        flat = F.abs(w[0]) > F.abs(w[1])
        size = F.sqrt(F.when(flat, w[0] * w[0] + w[2] * w[2]).otherwise(w[1] * w[1] + w[2] * w[2]))
        p = F.when(flat, F.array(-w[2] / size, F.lit(0.0), w[0] / size)).otherwise(F.array(F.lit(0.0), w[2] / size, -w[1] / size))
        return let(F.struct(p.alias("p")), lambda x: let(F.struct(x.p.alias("p"), cross(w, vector(x, "p")).alias("q")), lambda y: turned(a, s, first, y)))

    def turned(a: Column, s: Column, first: Column, y: Column) -> Column:
        p, q = vector(y, "p"), vector(y, "q")
        form = lambda b, c: b[0] * (a.xx * c[0] + a.xy * c[1] + a.xz * c[2]) + b[1] * (a.xy * c[0] + a.yy * c[1] + a.yz * c[2]) + b[2] * (a.xz * c[0] + a.yz * c[1] + a.zz * c[2])
        half = F.atan2(2 * form(p, q), form(p, p) - form(q, q)) / 2
        high = lambda t: F.array(*(F.cos(t) * m + F.sin(t) * n for m, n in zip(p, q, strict=True)))
        low = lambda t: F.array(*(F.cos(t) * n - F.sin(t) * m for m, n in zip(p, q, strict=True)))
        both = lambda t: F.struct(high(t).alias("high"), low(t).alias("low"))
        order = lambda r: F.when(s.top, F.concat(up(first.w), up(r.high), up(r.low))).otherwise(F.concat(up(r.high), up(r.low), up(first.w)))
        return let(half, lambda t: let(both(t), order))

    whole = F.struct(*(c.alias(k) for k, c in zip(SYM, given, strict=True)), eigenvalues(*given).alias("v"))
    return F.when(ok, let(whole, isolated))


def with_polar(rows: DataFrame, f: str = "f", steps: int = 10, tolerance: float = 1e-9) -> DataFrame:
    """The right polar decomposition F = R U of columns fxx to fzz: the symmetric stretch u (six columns), the rotation q (nine) and its angle.

    R is the limit of R = (g R + R^-T / g) / 2 from F, where g balances the norms of both terms, so that ``steps`` are enough for any F that doubles can hold; then U = R'F.
    Null where F is null or det F is not over ``tolerance`` of the cube of F's mean stretch (a mirrored or flattened neighbourhood has no rotation).
    """
    pairs = [a + b for a in "xyz" for b in "xyz"]
    given = rows.columns
    det = lambda m: F.expr(f"{m}xx * ({m}yy * {m}zz - {m}yz * {m}zy) - {m}xy * ({m}yx * {m}zz - {m}yz * {m}zx) + {m}xz * ({m}yx * {m}zy - {m}yy * {m}zx)")
    after = dict(zip("xyz", "yzx", strict=True))
    cofactor = lambda a, b: f"(q{after[a]}{after[b]} * q{after[after[a]]}{after[after[b]]} - q{after[a]}{after[after[b]]} * q{after[after[a]]}{after[b]})"
    norm = lambda m: "sqrt(" + " + ".join(f"{m}{k} * {m}{k}" for k in pairs) + ")"
    rows = rows.withColumns({f"q{k}": F.when(det(f) > tolerance * F.pow(F.expr(norm(f)) / math.sqrt(3), F.lit(3.0)), F.col(f"{f}{k}")) for k in pairs})
    for _ in range(steps):
        rows = rows.withColumn("_d", det("q"))
        rows = rows.withColumns({f"_i{k}": F.expr(f"try_divide({cofactor(*k)}, _d)") for k in pairs})
        rows = rows.withColumn("_g", F.expr(f"sqrt(try_divide({norm('_i')}, {norm('q')}))"))
        rows = rows.withColumns({f"q{k}": F.expr(f"(_g * q{k} + try_divide(_i{k}, _g)) / 2") for k in pairs})
    rows = rows.withColumns({f"u{a}{b}": F.expr(" + ".join(f"q{k}{a} * {f}{k}{b}" for k in "xyz")) for a, b in SYM})
    angle = F.acos(F.least(F.greatest(F.expr("(qxx + qyy + qzz - 1) / 2"), F.lit(-1.0)), F.lit(1.0)))
    return rows.withColumn("angle", F.when(F.col("qxx").isNotNull(), angle)).select(*given, *(f"u{k}" for k in SYM), *(f"q{k}" for k in pairs), "angle")


def max_shear_direction(values: Column, vectors: Column) -> list[Column]:
    """The first eigenvector turned by 45 degrees about the second, scaled by the spread of the eigenvalues."""
    u, v = [F.get(vectors, i) for i in range(3)], [F.get(vectors, 3 + i) for i in range(3)]
    spread = F.get(values, 0) - F.get(values, 2)
    return [x * spread for x in rodrigues(u, v, math.pi / 4)]
