"""Overlays of polygons, a batch of rows at a time, in numpy.

A geometry is an array of polygons, a polygon an array of rings, outer first; by the even-odd rule, what lies in an odd number of rings is inside. Each row's plane is cut into level slabs at every vertex and crossing. Within a slab no edges cross, so the edges that pass through it, in order from left to right, bound trapezoids, whose areas are exact. Sides that two trapezoids share cancel, the others are chained to rings, and holes are nested: that is the geometry of the result. All rows of a batch go through the same few array operations, whatever their numbers of edges. Coordinates count from a vertex of the row, which keeps sums exact at the size of projected coordinates.

Rows with many edges are worked on in strips of about ``STRIP`` vertices each, in which only the edges that pass through a strip meet; so outlines of tens of thousands of vertices do not meet edge by edge.

Nulls and empty geometries have no area; rings need not be closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from parcelspark.functions import geometry as geo

PARTS = "array<array<array<array<double>>>>"
#: Pairs of edges that are looked at together.
MOST = 2_000_000
#: Vertices of a strip, and how far apart two nodes of one level are at least.
STRIP, APART = 64, 1e-8

KEEP = {"intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "union": lambda a, b: a | b, "first": lambda a, b: a}


def _offsets(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def vertices(geometries: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, ring, row) of all vertices; rings are numbered over all rows."""
    g = geometries.combine_chunks() if isinstance(geometries, pa.ChunkedArray) else geometries
    at = np.arange(len(g) + 1, dtype=np.int64) if not len(g) else None
    rows = np.arange(len(g))
    if g.null_count:
        keep = np.flatnonzero(~g.is_null().to_numpy(zero_copy_only=False))
        g, rows = g.take(pa.array(keep)), rows[keep]
    if not len(g) or at is not None:
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, level = rows, g
    for _ in range(2):  # polygons, then rings
        o = _offsets(level)
        of, level = np.repeat(of, np.diff(o)), level.values.slice(o[0], o[-1] - o[0])
    o = _offsets(level)
    ring, of = np.repeat(np.arange(len(of)), np.diff(o)), np.repeat(of, np.diff(o))
    points = level.values.slice(o[0], o[-1] - o[0])
    o = _offsets(points)
    flat = points.values.to_numpy(zero_copy_only=False)
    return flat[o[:-1]], flat[o[:-1] + 1], ring, of


def edges(geometries: pa.Array, owner: int, origin: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, owner, x and y of the lower end, x and y of the upper end) of the edges that are not level, with the rings closed."""
    x, y, ring, row = vertices(geometries)
    if not len(x):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, float, float, float))
    x, y = x - origin[0][row], y - origin[1][row]
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
    size = np.diff(np.r_[first, len(x)])
    follows = np.arange(1, len(x) + 1)
    follows[first + size - 1] = first
    up = y < y[follows]
    lo, hi = np.where(up, np.arange(len(x)), follows), np.where(up, follows, np.arange(len(x)))
    real = y != y[follows]
    lo, hi, row = lo[real], hi[real], row[real]
    return row, np.full(len(row), owner), x[lo], y[lo], x[hi], y[hi]


def origins(n: int, *geometries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first vertex of each row."""
    ox, oy, seen = np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
    for g in geometries:
        x, y, _, row = vertices(g)
        rows, at = np.unique(row, return_index=True)
        new = ~seen[rows]
        ox[rows[new]], oy[rows[new]], seen[rows] = x[at[new]], y[at[new]], True
    return ox, oy


def _strips(row: np.ndarray, y0: np.ndarray, y1: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edge, strip, low, high, row of each strip): rows cut into strips at some of their vertices' heights, strips of a row one after the other, and the part of each edge that lies in each strip that it passes."""
    count = np.bincount(row, minlength=n)
    of = np.arange(n)
    if (count <= 2 * STRIP).all():
        return np.arange(len(row)), row, y0, y1, of
    order = np.lexsort((y0, row))
    start = np.cumsum(count) - count
    strips = np.maximum(1, count // STRIP)
    base = np.cumsum(strips) - strips
    of = np.repeat(of, strips)
    k = np.arange(strips.sum()) - base[of]
    # The lower bound of a strip; the first has none, and a strip ends where the next begins.
    bound = np.where(k > 0, y0[order][np.minimum(start[of] + k * STRIP, max(len(row) - 1, 0))], -np.inf)
    upper = np.r_[np.where(k[1:] > 0, bound[1:], np.inf), np.inf]
    # Edges and bounds of all rows share one order, so that one search places them.
    values, at = np.unique(np.r_[y0, y1, bound], return_inverse=True)
    m, width = len(row), len(values) + 1
    key = of * width + at[2 * m :]
    first = np.searchsorted(key, row * width + at[:m], side="right") - 1
    last = np.searchsorted(key, row * width + at[m : 2 * m], side="left") - 1
    each = np.maximum(last - first + 1, 0)
    edge = np.repeat(np.arange(m), each)
    strip = first[edge] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    low, high = np.maximum(y0[edge], bound[strip]), np.minimum(y1[edge], upper[strip])
    some = low < high
    return edge[some], strip[some], low[some], high[some], of


def trapezoids(a: pa.Array, b: pa.Array, operation: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, low y, high y, left and right x at the low end, the same at the high end, left edge, right edge, area) of a op b, for a few strips at a time, from left to right and upwards within a row. Coordinates count from the row's origin."""
    origin = origins(len(a), a, b)
    both = [np.concatenate(c) for c in zip(edges(a, 0, origin), edges(b, 1, origin), strict=True)]
    yield from _in_strips(*both, len(a), lambda s, e, x, owner: _two(s, e, x, owner, KEEP[operation]))


def united(lists: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """As trapezoids, of the union of all geometries in each row's list."""
    offsets = _offsets(lists) if len(lists) else np.zeros(1, np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else pa.array([], pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))
    of = np.repeat(np.arange(len(lists)), np.diff(offsets))
    ox, oy = origins(len(flat), flat)
    first = np.minimum(np.searchsorted(of, np.arange(len(lists))), max(len(of) - 1, 0))
    ox, oy = (ox[first][of], oy[first][of]) if len(of) else (ox, oy)
    row, _, *ends = edges(flat, 0, (ox, oy))
    yield from _in_strips(of[row] if len(of) else row, row, *ends, len(lists), _deep)


def _in_strips(row, owner, x0, y0, x1, y1, n, inside) -> Iterator[tuple[np.ndarray, ...]]:
    edge, strip, low, high, of = _strips(row, y0, y1, n)
    order = np.argsort(strip, kind="stable")
    edge, strip, low, high = edge[order], strip[order], low[order], high[order]
    count = np.bincount(strip, minlength=len(of))
    at = np.cumsum(count) - count
    # A strip of e edges has e * e pairs, and no more slabs than vertices and crossings.
    cost = np.cumsum(count.astype(np.int64) ** 2)
    lo = 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + MOST, side="right")))
        part = slice(at[lo], at[hi - 1] + count[hi - 1])
        if part.stop > part.start:
            k = edge[part]
            out = _slabs(strip[part] - lo, owner[k], x0[k], y0[k], x1[k], y1[k], low[part], high[part], hi - lo, inside)
            yield (of[lo + out[0]], *out[1:7], k[out[7]], k[out[8]], out[9])
        lo = hi


def _two(s, e, x, owner, keep) -> tuple[np.ndarray, np.ndarray]:
    """Where the result begins and ends in each slab: (order of the edges, whether it is inside behind each), by the parity of both owners' edges."""
    order = np.lexsort((owner[e], x, s))
    s, e = s[order], e[order]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    of_slab = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
    state = []
    for who in (0, 1):
        mine = np.cumsum(owner[e] == who)
        before = mine[begin] - (owner[e[begin]] == who)
        state.append((mine - before[of_slab]) % 2 == 1)
    return order, keep(*state)


def _signs(s, e, x, owner) -> np.ndarray:
    """Whether each edge enters (1) its owner or leaves it (-1): they take turns."""
    order = np.lexsort((x, owner[e], s))
    so, eo = s[order], owner[e[order]]
    new = np.r_[True, (so[1:] != so[:-1]) | (eo[1:] != eo[:-1])]
    place = np.arange(len(so)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    sign = np.empty(len(s), dtype=np.int64)
    sign[order] = np.where(place % 2 == 0, 1, -1)
    return sign


def _depth(s: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Running sums within each slab."""
    depth = np.cumsum(sign)
    new = np.r_[True, s[1:] != s[:-1]]
    first = np.flatnonzero(new)
    return depth - np.r_[0, depth][first][np.cumsum(new) - 1]


def _deep(s, e, x, owner) -> tuple[np.ndarray, np.ndarray]:
    """As _two, for what lies in any owner."""
    sign = _signs(s, e, x, owner)
    order = np.lexsort((-sign, x, s))
    return order, _depth(s[order], sign[order]) > 0


def _deep_in_first(s, e, x, owner) -> tuple[np.ndarray, np.ndarray]:
    """As _two, for what lies in owner 0 and in any other."""
    sign = _signs(s, e, x, owner)
    order = np.lexsort((-sign, x, s))
    so, sign, mine = s[order], sign[order], owner[e[order]] == 0
    return order, (_depth(so, np.where(mine, sign, 0)) > 0) & (_depth(so, np.where(mine, 0, sign)) > 0)


def _slabs(row, owner, x0, y0, x1, y1, bottom, top, n, inside) -> tuple[np.ndarray, ...]:
    s, e, low, high, slab_row = _slab_edges(row, x0, y0, x1, y1, bottom, top, n)
    if not len(s):
        return (np.zeros(0, np.int64), *[np.zeros(0)] * 6, *[np.zeros(0, np.int64)] * 2, np.zeros(0))
    dx, dy = x1 - x0, y1 - y0
    at_ = lambda k, y: np.where(y == y0[k], x0[k], np.where(y == y1[k], x1[k], x0[k] + dx[k] * ((y - y0[k]) / dy[k])))
    order, now = inside(s, e, at_(e, (low[s] + high[s]) / 2), owner)
    s, e = s[order], e[order]
    first = np.r_[True, s[1:] != s[:-1]]
    earlier = np.r_[False, now[:-1]] & ~first
    opens, closes = np.flatnonzero(now & ~earlier), np.flatnonzero(~now & earlier)
    left, right, slab = e[opens], e[closes], s[opens]
    y_lo, y_hi = low[slab], high[slab]
    l0, r0, l1, r1 = at_(left, y_lo), at_(right, y_lo), at_(left, y_hi), at_(right, y_hi)
    # Edges that cross at a slab's end may miss each other there by a rounding.
    r0, r1 = np.maximum(l0, r0), np.maximum(l1, r1)
    real = (r0 > l0) | (r1 > l1)
    out = (slab_row[slab], y_lo, y_hi, l0, r0, l1, r1, left, right, (y_hi - y_lo) * ((r0 - l0) + (r1 - l1)) / 2)
    return tuple(c[real] for c in out)


def areas(a: pa.Array, b: pa.Array, operation: str) -> np.ndarray:
    out = np.zeros(len(a))
    for t in trapezoids(a, b, operation):
        np.add.at(out, t[0], t[-1])
    return out


def dissolved(found: Iterator[tuple[np.ndarray, ...]], n: int, origin: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Trapezoids of n rows as geometries: polygons with an outer ring counter-clockwise and their holes, closed, without vertices that lie between their neighbours."""
    columns = [np.concatenate(c) for c in zip(*[t[:9] for t in found], strict=True)] or [np.zeros(0, np.int64), *[np.zeros(0)] * 6, *[np.zeros(0, np.int64)] * 2]
    row, lo, hi, l0, r0, l1, r1, of_left, of_right = columns
    m = len(row)
    # Nodes: the corners of a level that are not APART are one.
    at_row, at_y, at_x = np.tile(row, 4), np.r_[lo, lo, hi, hi], np.r_[l0, r0, l1, r1]
    order = np.lexsort((at_x, at_y, at_row))
    ys, xs, rs = at_y[order], at_x[order], at_row[order]
    level = np.r_[True, (rs[1:] != rs[:-1]) | (ys[1:] != ys[:-1])] if m else np.zeros(0, bool)
    fresh = level | np.r_[True, np.diff(xs) > APART] if m else level
    node = np.empty(4 * m, dtype=np.int64)
    node[order] = np.cumsum(fresh) - 1
    x, y, of = xs[fresh], ys[fresh], rs[fresh]
    a, b, c, d = node[:m], node[m : 2 * m], node[2 * m : 3 * m], node[3 * m :]
    # Level sides: bottoms count up, tops down, between each node and the next of its level.
    bar = np.zeros(len(x) + 1, dtype=np.int64)
    for u, v, sign in ((a, b, 1), (c, d, -1)):
        np.add.at(bar, u, sign)
        np.add.at(bar, v, -sign)
    bar = np.cumsum(bar)[:-1] if len(x) else bar[:0]
    right, left = np.flatnonzero(bar > 0), np.flatnonzero(bar < 0)
    # Slanted sides: those that one trapezoid ends at and another begins at cancel.
    pair, some, at = np.unique(np.r_[b * (len(x) + 1) + d, a * (len(x) + 1) + c], return_index=True, return_inverse=True)
    net = np.bincount(at, weights=np.r_[np.ones(m), -np.ones(m)], minlength=len(pair)).astype(np.int64)
    up, down = pair[net > 0], pair[net < 0]
    start = np.r_[right, left + 1, up // (len(x) + 1), down % (len(x) + 1)]
    end = np.r_[right + 1, left, up % (len(x) + 1), down // (len(x) + 1)]
    along = np.r_[of_right, of_left][some]  # the edge that a side lies on; level sides are told by their direction
    along = np.r_[np.full(len(right), -1), np.full(len(left), -2), along[net > 0], along[net < 0]]
    rings = _rings(start, end, along, x, y)
    return _geometries(rings, x, y, of, n, origin)


def _rings(start: np.ndarray, end: np.ndarray, along: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Nodes of the rings of directed edges that have the inside on their left; where rings touch, each keeps to its own wedge."""
    m = len(start)
    angle = np.r_[np.arctan2(y[end] - y[start], x[end] - x[start]), np.arctan2(y[start] - y[end], x[start] - x[end])]
    # Around a node: the edges that leave it, and those that come in, seen from it. One that comes in goes on with the next clockwise that leaves.
    at, kind = np.r_[start, end], np.r_[np.zeros(m, np.int64), np.ones(m, np.int64)]
    order = np.lexsort((kind, angle, at))
    follows = np.empty(m, dtype=np.int64)
    group = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0, True]) if m else np.zeros(1, np.int64)
    sizes = np.diff(group)
    simple = np.repeat(sizes == 2, sizes)
    two = order[simple].reshape(-1, 2)
    incoming = np.where(kind[two[:, 0]] == 1, two[:, 0], two[:, 1]) - m
    follows[incoming] = np.where(kind[two[:, 0]] == 1, two[:, 1], two[:, 0])
    for k in np.flatnonzero(sizes != 2).tolist():
        around = order[group[k] : group[k + 1]].tolist()
        leaves = [i for i, e in enumerate(around) if e < m]
        free = set(leaves)
        for i, e in enumerate(around):
            if e >= m:
                j = i - 1
                while j % len(around) not in free:
                    j -= 1
                free.discard(j % len(around))
                follows[e - m] = around[j % len(around)]
    # Most rings have a few nodes: lists are walked faster than arrays of that size are made.
    seen, rings, to = bytearray(m), [], follows.tolist()
    side, begins, xs, ys = along.tolist(), start.tolist(), x.tolist(), y.tolist()
    for first in range(m):
        if not seen[first]:
            ring, e = [], first
            while not seen[e]:
                seen[e] = 1
                ring.append(e)
                e = to[e]
            nodes = [begins[e] for k, e in enumerate(ring) if side[e] != side[ring[k - 1]]]
            nodes = _turning(nodes, [xs[v] for v in nodes], [ys[v] for v in nodes])
            if len(nodes) >= 3:
                rings.append(nodes)
    return rings


def _turning(nodes: list[int], x: list[float], y: list[float]) -> list[int]:
    """The nodes of a ring without those that lie between the one kept before and the next."""
    kept: list[int] = []
    for k in range(len(x)):
        p, q = (kept[-1] if kept else k - 1), (k + 1) % len(x)
        ax, ay, bx, by = x[k] - x[p], y[k] - y[p], x[q] - x[p], y[q] - y[p]
        if abs(ax * by - ay * bx) > APART / 10 * (abs(bx) + abs(by)):
            kept.append(k)
    return [nodes[k] for k in kept]


def _geometries(rings: list[list[int]], x: np.ndarray, y: np.ndarray, of: np.ndarray, n: int, origin: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    here, after = (np.fromiter(chain.from_iterable(r), np.int64) for r in (rings, ([*r[1:], r[0]] for r in rings)))
    starts = np.r_[0, np.cumsum(np.array([len(r) for r in rings], dtype=np.int64))][:-1]
    area = np.add.reduceat(x[here] * y[after] - x[after] * y[here], starts) / 2 if rings else np.zeros(0)
    row = of[here[starts]]
    shells = [[] for _ in range(n)]
    holes: dict[int, list[int]] = {}
    for k in np.flatnonzero(area > 0).tolist():
        shells[row[k]].append(k)
    for k in np.flatnonzero(area < 0).tolist():
        own = [s for s in shells[row[k]] if area[s] >= -area[k]]
        if len(own) > 1:
            # The middle of an edge is on no other ring.
            px, py = (x[rings[k][0]] + x[rings[k][1]]) / 2, (y[rings[k][0]] + y[rings[k][1]]) / 2
            own = [s for s in own if _inside(px, py, x[rings[s]], y[rings[s]])] or own
        if own:
            holes.setdefault(min(own, key=lambda s: area[s]), []).append(k)
    order = [[[s, *holes.get(s, [])] for s in shells[i]] for i in range(n)]
    flat = [k for polygons in order for p in polygons for k in p]
    closed = [[*rings[k], rings[k][0]] for k in flat]
    nodes = np.fromiter(chain.from_iterable(closed), np.int64)
    points = np.stack([x[nodes] + origin[0][of[nodes]], y[nodes] + origin[1][of[nodes]]], axis=1).ravel() if len(nodes) else np.zeros(0)
    ends = lambda sizes: pa.array(np.r_[0, np.cumsum(np.array(sizes, dtype=np.int64))], type=pa.int32())
    level = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(nodes) + 1, 2), type=pa.int32()), pa.array(points))
    for sizes in ([len(c) for c in closed], [len(p) for polygons in order for p in polygons], [len(polygons) for polygons in order]):
        level = pa.ListArray.from_arrays(ends(sizes), level)
    return level


def _inside(px: float, py: float, x: np.ndarray, y: np.ndarray) -> bool:
    bx, by = np.roll(x, -1), np.roll(y, -1)
    crosses = (y > py) != (by > py)
    return bool(np.sum(x[crosses] + (py - y[crosses]) * (bx[crosses] - x[crosses]) / (by[crosses] - y[crosses]) > px) % 2)


def pieces(a: pa.Array, b: pa.Array, operation: str) -> pa.Array:
    """a op b as geometries."""
    return dissolved(trapezoids(a, b, operation), len(a), origins(len(a), a, b))


def united_rows(lists: pa.Array) -> pa.Array:
    """The union of each row's list of geometries, as one geometry."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ox, oy = np.zeros(len(lists)), np.zeros(len(lists))
    if len(lists):
        offsets = _offsets(lists)
        fx, fy = origins(int(offsets[-1] - offsets[0]), lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
        some = np.flatnonzero(np.diff(offsets) > 0)
        ox[some], oy[some] = fx[offsets[some] - offsets[0]], fy[offsets[some] - offsets[0]]
    return dissolved(united(lists), len(lists), (ox, oy))


def united_parts(lists: Column) -> Column:
    """The union of an array of geometries, as one geometry."""

    @arrow_udf(PARTS)
    def made(g: pa.Array) -> pa.Array:
        return united_rows(g)

    return made(lists)


def made_valid(g: Column) -> Column:
    """The same region without faults: of each polygon what lies in an odd number of its rings, rings cut where they cross themselves or each other, and polygons that overlap united."""
    return united_parts(F.transform(g, lambda p: F.array(p)))


def odd_area(g: Column) -> Column:
    """The area that lies in an odd number of a geometry's rings: for a valid one, that of its outer rings less that of its holes."""

    @arrow_udf("double")
    def odd(x: pa.Array) -> pa.Array:
        return pa.array(areas(x, pa.nulls(len(x), x.type), "first"))

    return odd(g)


def centre(g: Column) -> tuple[Column, Column]:
    """The centroid of a geometry's area, counted from its first vertex; its holes count against it. Null without area."""
    ox, oy = (F.get(F.get(F.get(F.get(g, F.lit(0)), F.lit(0)), F.lit(0)), F.lit(k)) for k in (0, 1))
    v = lambda p, k: F.get(p, F.lit(k)) - (oy if k else ox)
    cross = lambda s: v(s["a"], 0) * v(s["b"], 1) - v(s["b"], 0) * v(s["a"], 1)
    total = lambda r, f: F.aggregate(geo.edges_of(r), F.lit(0.0), lambda acc, s: acc + f(s))
    sums = lambda f: F.aggregate(F.flatten(F.transform(g, lambda p: F.transform(p, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(total(r, cross)) * total(r, f)))), F.lit(0.0), lambda acc, x: acc + x)
    double = sums(cross)
    return tuple(o + F.try_divide(sums(lambda s, k=k: (v(s["a"], k) + v(s["b"], k)) * cross(s)), 3 * double) for k, o in ((0, ox), (1, oy)))


def overlay_parts(a: Column, b: Column, operation: str) -> Column:
    """The polygons of a op b (intersection, difference, union), geometries both."""

    @arrow_udf(PARTS)
    def made(x: pa.Array, y: pa.Array) -> pa.Array:
        return pieces(x, y, operation)

    return made(a, b)


def mixed_pieces(a: pa.Array, b: pa.Array, operation: pa.Array) -> pa.Array:
    """As pieces, with an operation for each row; null where it is null."""
    named = np.array(operation.to_pylist(), dtype=object)
    out, at = [], []
    for how in KEEP:
        rows = np.flatnonzero(named == how)
        if len(rows):
            out.append(pieces(a.take(pa.array(rows)), b.take(pa.array(rows)), how))
            at.append(rows)
    place = np.full(len(named), -1)
    if at:
        place[np.concatenate(at)] = np.arange(sum(map(len, at)))
    kind = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
    made = pa.concat_arrays([g.cast(kind) for g in out]) if out else pa.nulls(0, kind)
    return made.take(pa.array(place, mask=place < 0))


def overlay_each(a: Column, b: Column, operation: Column) -> Column:
    """As overlay_parts, with an operation for each row: the geometries cross to Python once, whatever the number of operations."""

    @arrow_udf(PARTS)
    def made(x: pa.Array, y: pa.Array, how: pa.Array) -> pa.Array:
        return mixed_pieces(x, y, how)

    return made(a, b, operation)


def _is_box(g: Column) -> Column:
    """One ring of five vertices whose edges follow the axes, closed."""
    ring = F.get(F.get(g, F.lit(0)), F.lit(0))
    p = lambda k, c: F.get(F.get(ring, F.lit(k)), F.lit(c))
    turns = lambda u, v: (p(0, u) == p(1, u)) & (p(2, u) == p(3, u)) & (p(1, v) == p(2, v)) & (p(3, v) == p(0, v))
    closed = (p(0, 0) == p(4, 0)) & (p(0, 1) == p(4, 1))
    return (F.size(g) == 1) & (F.size(F.get(g, F.lit(0))) == 1) & (F.size(ring) == 5) & closed & (turns(0, 1) | turns(1, 0))


def shared_area(a: Column, b: Column) -> Column:
    """The area of the intersection of two geometries. Two boxes are settled by an expression; for others only, Python is called."""
    box = F.coalesce(_is_box(a) & _is_box(b), F.lit(False))
    ring = lambda g: F.get(F.get(g, F.lit(0)), F.lit(0))
    e, f = geo.bbox(ring(a)), geo.bbox(ring(b))
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(e[hi], f[hi]) - F.greatest(e[lo], f[lo]))

    @arrow_udf("double")
    def shared(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(areas(x, y, "intersection"))

    others = shared(F.when(~box, a), F.when(~box, b))
    return F.when(box, side("min_x", "max_x") * side("min_y", "max_y")).otherwise(others)


def contact(a: Column, b: Column, tolerance: float) -> Column:
    """A struct of shared, the length of a's outlines that runs along b's within the tolerance, and touches, whether they have a point in common."""

    @arrow_udf("struct<shared: double, touches: boolean>")
    def made(x: pa.Array, y: pa.Array) -> pa.Array:
        shared, touches = beside(x, y, tolerance)
        return pa.StructArray.from_arrays([pa.array(shared), pa.array(touches)], names=["shared", "touches"])

    return made(a, b)


def bounds(g: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 of a geometry; null if it has no vertex."""
    points = F.flatten(F.flatten(g))
    return {"x0": F.array_min(F.transform(points, lambda p: F.get(p, F.lit(0)))), "y0": F.array_min(F.transform(points, lambda p: F.get(p, F.lit(1)))), "x1": F.array_max(F.transform(points, lambda p: F.get(p, F.lit(0)))), "y1": F.array_max(F.transform(points, lambda p: F.get(p, F.lit(1))))}


def area(g: Column) -> Column:
    """Outer rings less holes; 0 for none."""
    return F.coalesce(F.aggregate(F.transform(g, geo.polygon_area), F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0))


def holds(g: Column, x: Column, y: Column) -> Column:
    """Whether a point is in one of the polygons, or on an outline."""
    inside = lambda rings: geo.point_in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: geo.point_in_ring(x, y, r) & ~geo.on_ring(x, y, r))
    return F.exists(g, inside)


def covered(geometries: pa.Array, group: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """For each group of geometries the area of their union inside the group's box (a row of cells: x0, y0, x1, y1)."""
    boxes = np.stack([cells[:, [0, 1]], cells[:, [2, 1]], cells[:, [2, 3]], cells[:, [0, 3]]], axis=1)
    out = np.zeros(len(cells))
    x, y, ring, row = vertices(geometries)
    if not len(x):
        return out
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
    size = np.diff(np.r_[first, len(x)])
    follows = np.arange(1, len(x) + 1)
    follows[first + size - 1] = first
    own = row + 1  # 0 is the cell itself
    g = group[row]
    x, y = x - cells[g, 0], y - cells[g, 1]
    ends = [(g, own, x, y, x[follows], y[follows])]
    n = len(cells)
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        ends.append((np.arange(n), np.zeros(n, np.int64), boxes[:, a, 0] - cells[:, 0], boxes[:, a, 1] - cells[:, 1], boxes[:, b, 0] - cells[:, 0], boxes[:, b, 1] - cells[:, 1]))
    g, own, xa, ya, xb, yb = (np.concatenate(c) for c in zip(*ends, strict=True))
    real = (ya != yb) & np.isfinite(xa + ya + xb + yb)
    g, own, xa, ya, xb, yb = (c[real] for c in (g, own, xa, ya, xb, yb))
    up = ya < yb
    for t in _in_strips(g, own, np.where(up, xa, xb), np.where(up, ya, yb), np.where(up, xb, xa), np.where(up, yb, ya), n, _deep_in_first):
        np.add.at(out, t[0], t[-1])
    return out


def _blocks(counts: np.ndarray) -> Iterator[slice]:
    """Ranges of rows with about MOST counts together."""
    sums, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + MOST, side="right")))
        yield slice(lo, hi)
        lo = hi


def _meeting(row, lo, hi) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges of one row whose ranges [lo, hi] meet, each once, in blocks of a bounded size."""
    values, at = np.unique(np.r_[lo, hi], return_inverse=True)
    width = len(values) + 1
    key = row * width + at[: len(lo)]
    order = np.argsort(key, kind="stable")
    last = np.searchsorted(key[order], (row * width + at[len(lo) :])[order], side="right")
    counts = np.maximum(last - np.arange(len(order)) - 1, 0)
    for part in _blocks(counts):
        c = counts[part]
        i = np.repeat(np.arange(part.start, part.stop), c)
        j = i + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield order[i], order[j]


def _crossing_levels(row, x0, y0, x1, y1, bottom, top, n):
    """(levels, their rows): the heights of ends and crossings, each once."""
    dx, dy = x1 - x0, y1 - y0
    levels, rows = [bottom, top], [row, row]
    for i, j in _meeting(row, np.minimum(x0, x1), np.maximum(x0, x1)):
        near = (bottom[i] < top[j]) & (bottom[j] < top[i])
        i, j = i[near], j[near]
        turn = dx[i] * dy[j] - dy[i] * dx[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x0[j] - x0[i]) * dy[j] - (y0[j] - y0[i]) * dx[j]) / turn
            u = ((x0[j] - x0[i]) * dy[i] - (y0[j] - y0[i]) * dx[i]) / turn
        cross = (turn != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        i, j, t = i[cross], j[cross], t[cross]
        height = y0[i] + t * dy[i]
        here = (height > np.maximum(bottom[i], bottom[j])) & (height < np.minimum(top[i], top[j]))
        levels.append(height[here])
        rows.append(row[i[here]])
    level, of = np.concatenate(levels), np.concatenate(rows)
    order = np.lexsort((level, of))
    level, of = level[order], of[order]
    new = np.r_[True, (level[1:] != level[:-1]) | (of[1:] != of[:-1])] if len(level) else np.zeros(0, bool)
    return level[new], of[new]


def _slab_edges(row, x0, y0, x1, y1, bottom, top, n):
    """(slab of each edge that passes through one, edge, slabs' low and high ends and rows)."""
    level, of = _crossing_levels(row, x0, y0, x1, y1, bottom, top, n)
    same = np.flatnonzero(of[1:] == of[:-1])
    low, high, slab_row = level[same], level[same + 1], of[same]
    # A slab begins at a level, so an edge passes through those from its own low level up to its high one.
    values, at = np.unique(np.r_[low, bottom, top], return_inverse=True)
    width = len(values) + 1
    key = slab_row * width + at[: len(low)]
    first = np.searchsorted(key, row * width + at[len(low) : len(low) + len(row)], side="left")
    last = np.searchsorted(key, row * width + at[len(low) + len(row) :], side="left")
    each = np.maximum(last - first, 0)
    e = np.repeat(np.arange(len(row)), each)
    s = first[e] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return s, e, low, high, slab_row


def all_edges(geometries: pa.Array, origin: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, ax, ay, bx, by) of all edges of a length, with the rings closed, in the order of rows."""
    x, y, ring, row = vertices(geometries)
    if not len(x):
        return np.zeros(0, np.int64), *[np.zeros(0)] * 4
    x, y = x - origin[0][row], y - origin[1][row]
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
    follows = np.arange(1, len(x) + 1)
    follows[np.r_[first[1:], len(x)] - 1] = first
    real = (x != x[follows]) | (y != y[follows])
    return row[real], x[real], y[real], x[follows][real], y[follows][real]


def beside(a: pa.Array, b: pa.Array, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(length, touches) of each row: how much of a's outlines, holes included, runs within the tolerance of an edge of b's (for each edge the longest stretch beside one edge whose ends are that close to its line), and whether the geometries have a point in common."""
    n = len(a)
    origin = origins(n, a, b)
    row, ax, ay, bx, by = all_edges(a, origin)
    other, cx, cy, ex, ey = all_edges(b, origin)
    start, stop = np.searchsorted(other, np.arange(n)), np.searchsorted(other, np.arange(n), side="right")
    counts = (stop - start)[row]
    best, touch = np.zeros(len(row)), areas(a, b, "intersection") > 0
    for part in _blocks(counts):
        c = counts[part]
        i = np.repeat(np.arange(part.start, part.stop), c)
        j = start[row[i]] + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        dx, dy = bx[i] - ax[i], by[i] - ay[i]
        long = np.hypot(dx, dy)
        along = lambda px, py: ((px - ax[i]) * dx + (py - ay[i]) * dy) / long  # noqa: B023, E731
        off = lambda px, py: ((px - ax[i]) * dy - (py - ay[i]) * dx) / long  # noqa: B023, E731
        s, t, u, v = along(cx[j], cy[j]), along(ex[j], ey[j]), off(cx[j], cy[j]), off(ex[j], ey[j])
        stretch = np.minimum(long, np.maximum(s, t)) - np.maximum(0.0, np.minimum(s, t))
        np.maximum.at(best, i, np.where((np.abs(u) <= tolerance) & (np.abs(v) <= tolerance), stretch, 0.0))
        # They touch if they cross, or an end of one lies on the other.
        gx, gy = ex[j] - cx[j], ey[j] - cy[j]
        wide = np.hypot(gx, gy)
        p, q = ((ax[i] - cx[j]) * gy - (ay[i] - cy[j]) * gx) / wide, ((bx[i] - cx[j]) * gy - (by[i] - cy[j]) * gx) / wide
        k, m = ((ax[i] - cx[j]) * gx + (ay[i] - cy[j]) * gy) / wide, ((bx[i] - cx[j]) * gx + (by[i] - cy[j]) * gy) / wide
        eps = 1e-9
        on = lambda far, at, end: (np.abs(far) <= eps) & (at >= -eps) & (at <= end + eps)
        meet = ((u * v < 0) & (p * q < 0)) | on(u, s, long) | on(v, t, long) | on(p, k, wide) | on(q, m, wide)
        touch[row[i[meet]]] = True
    return np.bincount(row, weights=best, minlength=n), touch


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise; collinear points are left out. Points within the octagon of the extremes are dropped first."""
    points = np.unique(np.stack([x, y], axis=1), axis=0)
    if len(points) < 3:
        return points

    def half(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    if len(points) > 64:
        ends = np.unique([f(v) for v in (points[:, 0], points[:, 1], points.sum(1), points[:, 0] - points[:, 1]) for f in (np.argmin, np.argmax)])
        corner = np.array(half(points[ends]) + half(points[ends][::-1]))
        if len(corner) > 2:
            a, b = corner, np.roll(corner, -1, axis=0)
            side = (b[:, None, 0] - a[:, None, 0]) * (points[None, :, 1] - a[:, None, 1]) - (b[:, None, 1] - a[:, None, 1]) * (points[None, :, 0] - a[:, None, 0])
            points = points[~(side > 0).all(axis=0)]
    return np.array(half(points) + half(points[::-1]))
