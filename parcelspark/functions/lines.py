"""Networks of lines, a batch of tiles at a time, in numpy: where segments cut each other, which half-edges follow each other, and the rings that they make.

Rows belong to groups (tiles of the plane, or outlines); those of different groups never meet. Coordinates are whole numbers of cells of a grid. Groups are not looped over: all rows of a batch go through the same few array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that are looked at together; cells that the box of a face covers before it meets all holes of its group.
PAIRS, WIDE = 1_000_000, 256


def unique_rows(*keys: np.ndarray) -> np.ndarray:
    """The rows that differ from all before them, in the order of the keys."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order[new]


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row n times: the row, and a count from 0."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _blocks(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PAIRS in all."""
    at, total = 0, np.cumsum(n)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        yield at, to
        at = to


def _met(group, boxes, origin, cell: int, across: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of rows of a group whose boxes (x0, y0, x1, y1) share a cell and meet, each once. origin: the lower left corner of each row's tile; across: the cells of a tile, in one direction."""
    low = [np.floor_divide(b, cell) for b in boxes]
    wide, high = low[2] - low[0] + 1, low[3] - low[1] + 1
    row, k = _spread((wide * high).astype(np.int64))
    cx, cy = low[0][row] + k // high[row], low[1][row] + k % high[row]
    # Boxes end at most a cell beyond their tile.
    side = across + 4
    key = (group[row] * side + (cx - origin[0][row] // cell + 2)) * side + (cy - origin[1][row] // cell + 2)
    order = np.argsort(key, kind="stable")
    row, cx, cy, key = row[order], cx[order], cy[order], key[order]
    last = np.searchsorted(key, key, "right")
    after = last - np.arange(len(key)) - 1
    for first, to in _blocks(after):
        a, k = _spread(after[first:to])
        a += first
        b = a + 1 + k
        i, j = row[a], row[b]
        once = (cx[a] == np.maximum(low[0][i], low[0][j])) & (cy[a] == np.maximum(low[1][i], low[1][j]))
        meet = (boxes[0][i] <= boxes[2][j]) & (boxes[0][j] <= boxes[2][i]) & (boxes[1][i] <= boxes[3][j]) & (boxes[1][j] <= boxes[3][i])
        keep = once & meet
        yield i[keep], j[keep]


def _cut(ends: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, x, y) where the segments of pairs i < j cut each other, but for their own ends: an end that is at most a cell away, else the rounded crossing, and ends that lie on the other one, at most half a cell off."""
    ax, ay, bx, by = ([e[i], e[j]] for e in ends)
    f = lambda v: v.astype(np.float64)
    (dx, ex), (dy, ey) = ([f(b - a) for a, b in zip(p, q, strict=True)] for p, q in ((ax, bx), (ay, by)))
    qx, qy = f(ax[1] - ax[0]), f(ay[1] - ay[0])
    turn = dx * ey - dy * ex
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (qx * ey - qy * ex) / turn, (qx * dy - qy * dx) / turn
        crosses = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        x, y = (np.floor(np.where(crosses, f(a[0]) + t * d + 0.5, 0)).astype(np.int64) for a, d in ((ax, dx), (ay, dy)))
    points = [(ax[0], ay[0]), (bx[0], by[0]), (ax[1], ay[1]), (bx[1], by[1])]
    found, at = np.zeros(len(i), bool), (x.copy(), y.copy())
    for px, py in points:
        close = ~found & (np.abs(px - x) <= 1) & (np.abs(py - y) <= 1)
        at[0][close], at[1][close], found = px[close], py[close], found | close
    out = []
    for side, seg in enumerate((i, j)):
        inner = lambda px, py, side=side: ((px != ax[side]) | (py != ay[side])) & ((px != bx[side]) | (py != by[side]))
        keep = crosses & inner(*at)
        out.append((seg[keep], at[0][keep], at[1][keep]))
        sx, sy = (dx, dy) if side == 0 else (ex, ey)
        for px, py in points[2:] if side == 0 else points[:2]:
            ox, oy = f(px - ax[side]), f(py - ay[side])
            along, long, off = ox * sx + oy * sy, sx * sx + sy * sy, ox * sy - oy * sx
            keep = (along > 0) & (along < long) & (off * off <= 0.25 * long) & inner(px, py)
            out.append((seg[keep], px[keep], py[keep]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def cuts(group: np.ndarray, ends: list[np.ndarray], origin: tuple[np.ndarray, np.ndarray], cell: int, across: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, x, y): where distinct segments of a group, in the order of their ends, cut each other. Long segments meet others by pieces of about a cell, as far as they lie in their tile."""
    a, d = ends[:2], [(q - p).astype(np.float64) for p, q in zip(ends[:2], ends[2:], strict=True)]
    begin, end = np.zeros(len(group)), np.ones(len(group))
    for p, v, o in zip(a, d, origin, strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (o - 2 - p) / v, (o + cell * across + 2 - p) / v
        moves = v != 0
        begin, end = np.where(moves, np.maximum(begin, np.minimum(t, u)), begin), np.where(moves, np.minimum(end, np.maximum(t, u)), end)
    n = np.where(begin <= end, np.maximum(1, np.ceil(np.maximum(*np.abs(d)) * (end - begin) / cell)), 0).astype(np.int64)
    seg, k = _spread(n)
    at = lambda p, v, k: p[seg] + v[seg] * (begin + 0.0)[seg] + v[seg] * (end - begin)[seg] * k / n[seg]
    sides = [(at(p, v, k), at(p, v, k + 1)) for p, v in zip(a, d, strict=True)]
    boxes = [np.floor(np.minimum(*s)).astype(np.int64) - 1 for s in sides] + [np.ceil(np.maximum(*s)).astype(np.int64) + 1 for s in sides]
    found = []
    for i, j in _met(group[seg], boxes, [o[seg] for o in origin], cell, across):
        i, j = seg[i], seg[j]
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        found.append(_cut(ends, i, j))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    row, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    first = unique_rows(row, x, y)
    return row[first], x[first], y[first]


def between_nodes(ends: list[np.ndarray], cut: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(segment, ends) of the pieces of segments between their nodes, in the order along them."""
    seg = np.concatenate([np.arange(len(ends[0])), np.arange(len(ends[0])), cut[0]])
    x, y = np.concatenate([ends[0], ends[2], cut[1]]), np.concatenate([ends[1], ends[3], cut[2]])
    d, o = [(q - p).astype(np.float64)[seg] for p, q in zip(ends[:2], ends[2:], strict=True)], [(v - e[seg]).astype(np.float64) for v, e in ((x, ends[0]), (y, ends[1]))]
    order = np.lexsort((y, x, o[0] * d[0] + o[1] * d[1], seg))
    seg, x, y = seg[order], x[order], y[order]
    k = np.flatnonzero((seg[1:] == seg[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    swap = (x[k] > x[k + 1]) | ((x[k] == x[k + 1]) & (y[k] > y[k + 1]))
    p, q = np.where(swap, k + 1, k), np.where(swap, k, k + 1)
    return seg[k], [x[p], y[p], x[q], y[q]]


def _numbered(group: np.ndarray, *nodes: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Nodes (x, y) of the rows of groups as numbers, equal for equal nodes of a group."""
    g, x, y = np.tile(group, len(nodes)), np.concatenate([n[0] for n in nodes]), np.concatenate([n[1] for n in nodes])
    order = np.lexsort((y, x, g))
    new = np.zeros(len(order), np.int64)
    new[1:] = (g[order[1:]] != g[order[:-1]]) | (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new)
    return np.split(of, len(nodes))


def _sought(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of each wanted key, or -1."""
    order = np.argsort(keys, kind="stable")
    at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    return np.where(keys[order][at] == wanted, order[at], -1)


def turns(group: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of half-edges, all those that lead to their nodes b: (x, y of the node to which the next one leads, next, twin), the last two as rows, -1 in other groups. The next one is the next clockwise around b."""
    ax, ay, bx, by = ends
    a, b = _numbered(group, (ax, ay), (bx, by))
    n = max(int(a.max()), int(b.max())) + 1
    twin = _sought(a * n + b, b * n + a)
    order = np.lexsort((ay, ax, np.arctan2((ay - by).astype(np.float64), (ax - bx).astype(np.float64)), b))
    around = b[order]
    first = np.searchsorted(around, around, "left") == np.arange(len(around))
    before = np.where(first, np.searchsorted(around, around, "right") - 1, np.arange(len(around)) - 1)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[before]
    return ax[lead], ay[lead], twin[lead], twin


def follows(group: np.ndarray, ends: list[np.ndarray], cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next, twin) of the half-edges of whole outlines, of which c is known."""
    a, b, c = _numbered(group, (ends[0], ends[1]), (ends[2], ends[3]), (cx, cy))
    n = max(int(a.max()), int(b.max()), int(c.max())) + 1
    return _sought(a * n + b, b * n + c), _sought(a * n + b, b * n + a)


def walks(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a row's walk has a beginning, that beginning, or the smallest row of a closed walk). to: the row that follows, no row twice; -1: none."""
    back = np.full(len(to), -1)
    back[to[to >= 0]] = np.flatnonzero(to >= 0)
    begins = back < 0
    at, low = np.where(begins, np.arange(len(to)), back), np.arange(len(to))
    while True:
        lower, further = np.minimum(low, low[at]), at[at]
        done = (lower == low).all() and (begins[further] == begins[at]).all()
        low, at = lower, further
        if done:
            return begins[at], np.where(begins[at], at, low)


def rings(closed: np.ndarray, label: np.ndarray, to: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, offsets) of the rings of closed walks, each from its smallest row on, without edges that a walk passes in both directions: dangling lines and bridges bound nothing."""
    gone = closed & (twin >= 0) & (label[twin] == label)
    if gone.any():
        skip = np.where(gone, to[twin], np.arange(len(to)))
        kept = np.flatnonzero(closed & ~gone)
        while gone[skip[to[kept]]].any():
            skip = skip[skip]
        number = np.cumsum(closed & ~gone) - 1
        step = number[skip[to[kept]]]
        low = walks(step)[1]
    else:
        kept = np.flatnonzero(closed)
        number = np.cumsum(closed) - 1
        step, low = number[to[kept]], number[label[kept]]
    # Steps from each ring's smallest row, in doubling strides.
    back = np.empty(len(kept), np.int64)
    back[step] = np.arange(len(kept))
    first = low == np.arange(len(kept))
    at, steps = np.where(first, np.arange(len(kept)), back), (~first).astype(np.int64)
    while not first[at].all():
        steps, at = steps + steps[at], at[at]
    order = np.lexsort((steps, low))
    return kept[order], np.append(np.flatnonzero(steps[order] == 0), len(order))


def measured(x: np.ndarray, y: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a ring runs counter-clockwise, its area) from the nodes of rings, added up exactly; the area is 0 where it bounds nothing."""
    if len(offsets) < 2:
        return np.zeros(0, bool), np.zeros(0)
    n = np.diff(offsets)
    begin = np.repeat(offsets[:-1], n)
    u, v = x - x[begin], y - y[begin]
    follow = np.arange(len(x)) + 1
    follow[offsets[1:] - 1] = offsets[:-1]
    most = max(int(np.abs(u).max()), int(np.abs(v).max()))
    if 2 * most * most * int(n.max()) >= 1 << 62:
        u, v = u.astype(object), v.astype(object)
    twice = np.add.reduceat(u * v[follow] - u[follow] * v, offsets[:-1])
    return np.asarray(twice > 0, bool), np.array([abs(t) / 2 for t in twice.tolist()])


def around(px, py, x, y, offsets, hole, ring) -> np.ndarray:
    """Whether the points of holes lie in rings, or on them, for pairs (hole, ring)."""
    out = np.zeros(len(hole), bool)
    n = np.diff(offsets)[ring]
    for first, to in _blocks(n):
        pair, k = _spread(n[first:to])
        of = ring[first:to][pair]
        p, q = offsets[of] + k, offsets[of] + (k + 1) % n[first:to][pair]
        u, v = px[hole[first:to]][pair], py[hole[first:to]][pair]
        ax, ay, bx, by = ((c[e] - w).astype(np.float64) for e in (p, q) for c, w in ((x, u), (y, v)))
        with np.errstate(divide="ignore", invalid="ignore"):
            odd = ((ay > 0) != (by > 0)) & (0 < ax - (bx - ax) * ay / (by - ay))
        on = (ax * by == bx * ay) & (ax * bx <= 0) & (ay * by <= 0)
        starts = np.cumsum(n[first:to]) - n[first:to]
        out[first:to] = (np.add.reduceat(odd.astype(np.int64), starts) % 2 == 1) | np.logical_or.reduceat(on, starts)
    return out


def within(group, outer, area, boxes, x, y, offsets, cell: int) -> np.ndarray:
    """For each ring that is a hole the smallest face of its group around its first node, else -1. Faces meet holes in cells, wide ones all holes of their group."""
    out = np.full(len(group), -1)
    holes, faces = np.flatnonzero(~outer), np.flatnonzero(outer)
    if not len(holes) or not len(faces):
        return out
    px, py = x[offsets[:-1]][holes], y[offsets[:-1]][holes]
    # Cells count from the lowest of their group, so that a key is one number.
    least = [np.full(int(group.max()) + 1, np.iinfo(np.int64).max) for _ in "xy"]
    for m, b in zip(least, boxes[:2], strict=True):
        np.minimum.at(m, group, b // cell)
    low, high = [[b[faces] // cell - m[group[faces]] for b, m in zip(bs, least, strict=True)] for bs in (boxes[:2], boxes[2:])]
    side = int(max((b // cell - m[group]).max() for b, m in zip(boxes[2:], least, strict=True))) + 1
    wide, tall = high[0] - low[0] + 1, high[1] - low[1] + 1
    small = wide * tall <= WIDE
    keys = [(group[holes] * side + (px // cell - least[0][group[holes]])) * side + py // cell - least[1][group[holes]], group[holes]]
    of, k = _spread(np.where(small, wide * tall, 0))
    own = (group[faces][of] * side + low[0][of] + k // tall[of]) * side + low[1][of] + k % tall[of]
    found = []
    for key, sought, of in ((keys[0], own, of), (keys[1], group[faces][~small], np.flatnonzero(~small))):
        order = np.argsort(key, kind="stable")
        begin, end = np.searchsorted(key[order], sought, "left"), np.searchsorted(key[order], sought, "right")
        for first, to in _blocks(end - begin):
            f, k = _spread((end - begin)[first:to])
            hole, face = order[begin[first:to][f] + k], of[first:to][f]
            h, r = holes[hole], faces[face]
            keep = (area[r] > area[h]) & (boxes[0][r] <= boxes[0][h]) & (boxes[1][r] <= boxes[1][h]) & (boxes[2][r] >= boxes[2][h]) & (boxes[3][r] >= boxes[3][h])
            hole, r = hole[keep], r[keep]
            if len(hole):
                inside = around(px, py, x, y, offsets, hole, r)
                found.append((hole[inside], r[inside]))
    if found:
        hole, face = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((face, area[face], hole))
        hole, at = np.unique(hole[order], return_index=True)
        out[holes[hole]] = face[order][at]
    return out
