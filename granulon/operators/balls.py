"""Sums of products of offsets over all neighbours within a radius, of one task's places.

Neighbours come in leaves: small boxes of places. A leaf that lies wholly within reach of a leaf of queries counts by its sums, one that lies wholly
outside by nothing, and only places of the leaves between are compared; so what is compared is the skin of the balls and not their inside.
"""

from __future__ import annotations

import numpy as np

#: Places of a leaf of queries and of a leaf of neighbours.
ASKED, GIVEN = 128, 48
#: Queries of so few neighbouring places are summed over their offsets themselves: flat neighbourhoods, where rounding counts, are small ones.
FEW = 64


def leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of p in boxes of at most ``size`` rows, by halves along the widest side."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        at = p[rows]
        axis, half = int(np.ptp(at, axis=0).argmax()), len(rows) // 2
        rows = rows[np.argpartition(at[:, axis], half)]
        todo += [rows[half:], rows[:half]]
    return out


def _within(p: np.ndarray, q: np.ndarray, r2: float) -> np.ndarray:
    """Whether q[j] is within reach of p[i]: by a product of matrices, and by the distance itself where that is too near to tell."""
    middle = p.mean(0)
    a, b = p - middle, q - middle
    with np.errstate(over="ignore", invalid="ignore"):
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        over = np.column_stack([a, aa, np.ones(len(a))]) @ np.column_stack([-2 * b, np.ones(len(b)), bb - r2]).T
        near = 1e-13 * (r2 + 4 * (aa.max(initial=0.0) + bb.max(initial=0.0) + np.square(middle).sum()))
    hit = over <= near
    unsure = hit & (over >= -near) if near < 1e300 else np.ones_like(hit)
    if unsure.any():
        i, j = np.nonzero(unsure)
        x, y, z = (q[j, c] - p[i, c] for c in range(3))
        hit[i, j] = x * x + y * y + z * z <= r2
    return hit


def _moments(r: np.ndarray, n: np.ndarray, c: np.ndarray, cc: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Columns that add up: n, places, odd ones, r (3), rr (9), c (3), c r (9) and c c."""
    rr, cr = (r[:, :, None] * r[:, None, :] * n[:, None, None]).reshape(-1, 9), (c[:, :, None] * r[:, None, :]).reshape(-1, 9)
    return np.column_stack([n, np.ones(len(n)), odd, r * n[:, None], rr, c, cr, cc])


def offset_sums(at: np.ndarray, now: np.ndarray, void: np.ndarray, weight: np.ndarray, query: np.ndarray, near: np.ndarray, r: float) -> tuple[np.ndarray, ...]:
    """(rows, x (3, 3), y (3, 3), cc, count): for each row of ``query`` that has a row of ``near`` within r, the sums of now x before, before x before and now x now.

    ``weight`` tells how often a row counts; what is ``void`` of the places now adds nothing.
    """
    # rows with the same two places have the same sums
    both = np.column_stack([at, now, void])
    order = np.lexsort(both.T)
    new = np.concatenate([[True], (both[order[1:]] != both[order[:-1]]).any(1)])[: len(order)]
    one = np.empty(len(order), int)
    one[order] = np.cumsum(new) - 1
    first = order[new]
    x, y = np.zeros((len(first), 3, 3)), np.zeros((len(first), 3, 3))
    cc, count = np.zeros(len(first)), np.zeros(len(first), "int64")
    queries, sources = np.unique(one[query]), np.unique(one[near])
    if len(queries) and len(sources):
        _add_sums(at[first], now[first], void[first], np.bincount(one[near], weight[near], len(first)), queries, sources, r, x, y, cc, count)
    found = np.flatnonzero(query)
    found = found[count[one[found]] > 0]
    k = one[found]
    return found, x[k], y[k], cc[k], count[k]


def _add_sums(at, now, void, weight, queries, sources, r, x, y, cc, count) -> None:
    r2 = r * r
    order = np.lexsort(at.T)
    new = np.concatenate([[True], (at[order[1:]] != at[order[:-1]]).any(1)])
    of = np.empty(len(at), int)
    of[order] = np.cumsum(new) - 1
    place = at[order[new]]
    odd_row = void.any(1) | ~np.isfinite(now).all(1)
    # rows of a place, queries and sources
    asking, giving = queries[np.argsort(of[queries], kind="stable")], sources[np.argsort(of[sources], kind="stable")]
    ask_at, give_at = (np.searchsorted(of[rows], np.arange(len(place) + 1)) for rows in (asking, giving))
    asked, given = np.flatnonzero(np.diff(ask_at)), np.flatnonzero(np.diff(give_at))
    # about the middle of the group, so that little is lost where sums are moved to a query
    r0 = np.median(place, axis=0)
    plain = sources[~odd_row[sources]]
    c0 = np.median(now[plain], axis=0) if len(plain) else np.zeros(3)
    total = lambda rows, v: np.bincount(of[rows], weight[rows] * v, len(place))[given]
    c = now[plain] - c0
    moments = _moments(place[given] - r0, total(sources, 1.0), np.column_stack([total(plain, c[:, k]) for k in range(3)]), total(plain, (c * c).sum(1)), total(sources, odd_row[sources].astype(float)))
    groups = leaves(place[given], GIVEN)
    sizes, members = np.array([len(g) for g in groups]), np.concatenate(groups)
    starts = np.cumsum(sizes) - sizes
    given, moments = given[members], moments[members]
    p = place[given]
    low, high, sums = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts), np.add.reduceat(moments, starts)
    about_place = np.zeros((len(place), moments.shape[1]))
    odd_place = np.bincount(of[queries], odd_row[queries], len(place)) > 0
    alone = np.zeros(len(place), bool)  # places whose rows are summed by their offsets
    for leaf in leaves(place[asked], ASKED):
        own = asked[leaf]
        q = place[own]
        lo, hi = q.min(0), q.max(0)
        apart, reach = np.maximum(np.maximum(low - hi, lo - high), 0), np.maximum(high - lo, hi - low)
        inside = (reach * reach).sum(1) <= r2 * (1 - 1e-12)
        touched = ((apart * apart).sum(1) <= r2 * (1 + 1e-12)) & ~inside
        near = np.flatnonzero(np.repeat(touched, sizes))
        if len(near) + sizes[inside].sum() > FEW:
            found = np.repeat(sums[inside].sum(0)[None, :], len(q), axis=0)
            for k in range(0, len(near), 1024):
                part = near[k : k + 1024]
                found += _within(q, p[part], r2).astype(float) @ moments[part]
            about_place[own] = found
            alone[own] = (found[:, 1] <= FEW) | (found[:, 2] > 0)
        else:
            alone[own] = True
        few = own[alone[own] | odd_place[own]]
        alone[few] = True
        if len(few):
            about = np.concatenate([np.flatnonzero(np.repeat(inside, sizes)), near])
            step = max(1, 500_000 // max(1, len(about)))
            for k in range(0, len(few), step):
                some = few[k : k + step]
                for place_, hit in zip(some, _within(place[some], p[about], r2), strict=True):
                    there = given[about[hit]]
                    rows = np.concatenate([giving[give_at[j] : give_at[j + 1]] for j in there]) if len(there) else np.zeros(0, int)
                    for row in asking[ask_at[place_] : ask_at[place_ + 1]]:
                        _sum_offsets(row, rows, at, now, void, weight, x, y, cc, count)
    rows = asking[~alone[of[asking]]]
    m = about_place[of[rows]]
    n, sr, srr, sc, scr, scc = m[:, 0], m[:, 3:6], m[:, 6:15].reshape(-1, 3, 3), m[:, 15:18], m[:, 18:27].reshape(-1, 3, 3), m[:, 27]
    ri, ci = at[rows] - r0, now[rows] - c0
    outer = lambda a, b: a[:, :, None] * b[:, None, :]
    x[rows] = scr - outer(sc, ri) - outer(ci, sr - n[:, None] * ri)
    y[rows] = srr - outer(sr, ri) - outer(ri, sr - n[:, None] * ri)
    cc[rows] = scc - 2 * (ci * sc).sum(1) + n * (ci * ci).sum(1)
    count[rows] = np.rint(n).astype("int64")


def _sum_offsets(row, rows, at, now, void, weight, x, y, cc, count) -> None:
    with np.errstate(invalid="ignore", over="ignore"):
        w, before, after = weight[rows], at[rows] - at[row], now[rows] - now[row]
        gone = void[rows] | void[row]
        if gone.any():
            after[gone] = 0.0
            cc[row] = (w * np.where(gone.any(1), 0.0, (after * after).sum(1))).sum()
        else:
            cc[row] = (w * (after * after).sum(1)).sum()
        heavy = before * w[:, None]
        x[row], y[row], count[row] = after.T @ heavy, before.T @ heavy, w.sum()
