"""Subnets of candidates between two sets of places, and their assignments, without a list of all candidates.

Which sources and targets hang together at a range follows from a least spanning forest of the candidates: it has fewer edges than places.
"""

from __future__ import annotations

import heapq

import numpy as np


def near_pairs(p: np.ndarray, q: np.ndarray, r: float, most: int = 2_000_000):
    """Parts (i, j, d2) of the pairs of rows p[i], q[j] within r, about ``most`` distances at a time."""
    if not len(p) or not len(q):
        return
    cells, at = np.floor(np.concatenate([p, q]) / (r * (1 + 1e-9))), []
    for c in cells.T:  # empty stretches are closed up, so keys stay small
        u, inverse = np.unique(c, return_inverse=True)
        at.append(np.concatenate([[1], 1 + np.cumsum(np.minimum(np.diff(u), 2))]).astype("int64")[inverse])
    x, y, z = at
    wide, high = y.max() + 2, z.max() + 2
    key = (x * wide + y) * high + z
    order = np.argsort(key[len(p) :], kind="stable")
    there = key[len(p) :][order]
    for shift in ((dx * wide + dy) * high for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
        low = np.searchsorted(there, key[: len(p)] + shift - 1, "left")
        n = np.searchsorted(there, key[: len(p)] + shift + 1, "right") - low
        asked = np.flatnonzero(n)
        n, low = n[asked], low[asked]
        ends, start = np.cumsum(n), 0
        while start < len(asked):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            k = slice(start, stop)
            i = np.repeat(asked[k], n[k])
            j = order[np.arange(len(i)) + np.repeat(low[k] - (ends[k] - n[k] - done), n[k])]
            dx, dy, dz = (q[j, c] - p[i, c] for c in range(3))
            d2 = dx * dx + dy * dy + dz * dz
            kept = d2 <= r * r
            yield i[kept], j[kept], d2[kept]
            start = stop


def least_forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (their numbers) of a least spanning forest of the components that ``label`` names, and the labels after it."""
    number = np.argsort(weight, kind="stable")
    a, b, chosen = label[i[number]], label[j[number]], []
    while True:
        apart = a != b
        a, b, number = a[apart], b[apart], number[apart]
        if not len(number):
            return np.concatenate([*chosen, np.zeros(0, int)]).astype(int), label
        rank, none = np.arange(len(number)), len(number)
        best, other = np.full(len(label), none), np.full(len(label), none)
        best[a[::-1]], other[b[::-1]] = rank[::-1], rank[::-1]
        best = np.minimum(best, other)
        own = np.flatnonzero(best < none)
        edge, parent = best[own], np.arange(len(label))
        parent[own] = np.where(a[edge] == own, b[edge], a[edge])
        first = own[(parent[parent[own]] == own) & (own < parent[own])]
        parent[first] = first
        while (parent[parent] != parent).any():
            parent = parent[parent]
        chosen.append(number[np.unique(edge)])
        label, a, b = parent[label], parent[a], parent[b]


def forest(p: np.ndarray, q: np.ndarray, search: float, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): a least spanning forest of the pairs of p[i] and q[j] within the search range, from short ranges (``first``) to long ones."""
    n, radii, out = len(p), [search], []
    while radii[-1] > first:
        radii.append(radii[-1] / 2)
    label = np.arange(n + len(q))
    for r in reversed(radii):
        if not len(p) or not len(q):
            break
        # what the greatest component has inside needs no second look
        outside = label != np.bincount(label).argmax()
        po, qo, pi = np.flatnonzero(outside[:n]), np.flatnonzero(outside[n:]), np.flatnonzero(~outside[:n])
        every, held = np.arange(len(q)), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]

        def reduced(held=held, label=label):
            i, j, d2 = (np.concatenate(x) for x in zip(*held, strict=True))
            kept, after = least_forest(label, i, n + j, d2)
            return (i[kept], j[kept], d2[kept]), after

        for left, right in ((po, every), (pi, qo)):
            for i, j, d2 in near_pairs(p[left], q[right], r):
                i, j = left[i], right[j]
                apart = label[i] != label[n + j]
                held.append((i[apart], j[apart], d2[apart]))
                if sum(len(x[0]) for x in held) > 4_000_000:
                    held[:] = [reduced()[0]]
        edges, label = reduced()
        out.append(edges)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def cut(sources: int, nodes: int, i: np.ndarray, j: np.ndarray, d2: np.ndarray, search: float, most: int, shrink: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Subnet (-1: none) and range of each node, sources first, of a least forest (i, j, d2): a subnet with more than ``most`` sources loses its longest candidates, step by step."""
    subnet, limits, limit, named = np.full(nodes, -1), np.zeros(nodes), search, 0
    while len(i):
        last, label = not limit > stop * search, least_forest(np.arange(nodes), i, j, d2)[1]
        on = np.unique(np.concatenate([i, j]))
        size = np.bincount(label[on[on < sources]], minlength=nodes)
        final = (size <= most) | last
        done = on[final[label[on]]]
        subnet[done], limits[done] = named + label[done], limit
        named += nodes
        limit *= shrink
        kept = ~final[label[i]] & (d2 <= limit * limit)
        i, j, d2 = i[kept], j[kept], d2[kept]
    return subnet, limits


def assign_sparse(n: int, m: int, i: np.ndarray, j: np.ndarray, cost: np.ndarray, unlinked: float) -> np.ndarray:
    """Column of each row (-1: none) in a least-cost assignment along the edges (i, j, cost); a row without column costs ``unlinked``.

    Rows first bid for columns, within a bounded number of steps; shortest augmenting paths do the rest.
    """
    order = np.argsort(i, kind="stable")
    col, cost, ptr = j[order], cost[order], np.searchsorted(i[order], np.arange(n + 1)).tolist()
    v, row_of, col_of, price = np.zeros(m), [-1] * m, [-1] * n, [0.0] * n  # price: cost of the edge that a row holds
    none, free, steps = -2, list(range(n)), 0
    for _ in range(2):
        todo, free = free, []
        while todo and steps < 6 * n:
            steps += 1
            row = todo.pop()
            to = col[ptr[row] : ptr[row + 1]]
            reduced = cost[ptr[row] : ptr[row + 1]] - v[to]
            k = int(reduced.argmin()) if len(to) else -1
            if k < 0 or reduced[k] >= unlinked:
                col_of[row] = none
                continue
            low = reduced[k]
            reduced[k] = unlinked
            second, c = min(unlinked, reduced.min()), int(to[k])
            old = row_of[c]
            if old >= 0 and not low < second:
                free.append(row)
                continue
            v[c] -= second - low
            row_of[c], col_of[row], price[row] = row, c, cost[ptr[row] + k]
            if old >= 0:
                col_of[old] = -1
                todo.append(old)
        free += todo
    dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
    for start in free:
        heap, touched, scanned, best, end = [], [], [], unlinked, (start, -1)
        row, base, via = start, 0.0, -1
        while True:
            to = col[ptr[row] : ptr[row + 1]]
            far = cost[ptr[row] : ptr[row + 1]] - v[to] + base
            for k in np.flatnonzero((far < dist[to]) & (far < best) & ~done[to]).tolist():
                c, d = int(to[k]), float(far[k])
                if d < dist[c] and d < best:
                    touched.append(c)
                    dist[c], back[c] = d, row
                    if row_of[c] < 0:
                        best, end = d, (-1, c)
                    else:
                        heapq.heappush(heap, (d, c))
            while heap and (done[heap[0][1]] or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            d, via = heapq.heappop(heap)
            scanned.append((d, via))
            done[via] = True
            row = row_of[via]
            base = d - (price[row] - v[via])
            if base + unlinked < best:
                best, end = base + unlinked, (row, -1)
        for d, c in scanned:
            v[c] += d - best
        last, c = end
        if last >= 0:  # a row that gives up its column
            c, col_of[last] = col_of[last], none
        while c >= 0:
            row = int(back[c])
            before, col_of[row], row_of[c] = col_of[row], c, row
            to = col[ptr[row] : ptr[row + 1]]
            price[row] = cost[ptr[row] + int(np.flatnonzero(to == c)[0])]
            c = before if row != start else -1
        dist[touched], done[touched] = np.inf, False
    return np.array([max(c, -1) for c in col_of], dtype=int)
