"""Faces of a network of lines: lines of one drawing are shared by all tasks.

Coordinates are counted in cells of a grid (a millimetre), so that nodes are equal or apart. The plane is shared out in tiles. Segments go to the tiles that they touch, where each is cut at its crossings; a segment of several tiles gets the cuts of all of them. An edge is two half-edges, and the one that follows a half-edge is the next one clockwise around the node it leads to; half-edges go to the tile of that node, where all that lead to it are known. Those that follow each other are the outlines of faces: most lie in one tile and are finished there, the others are paths through tiles, which are joined as components of the links between them. Edges with the same outline on both sides (dangling lines, bridges) bound nothing and go; outlines that run counter-clockwise are faces, the others holes of the smallest face around them. A hole in a face of its tile is in the smallest one of those; only the others meet the faces of several tiles.

Tiles with too many rows for a task are worked on by joins and windows over their segments and nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import geometry as geo
from parcelspark.functions import lines as ln
from parcelspark.operators.components import connected
from parcelspark.operators.grouping import groups_up_to
from parcelspark.operators.lineage import discard, materialise, tidy
from parcelspark.operators.spatial import box_join

ENDS = ["ax", "ay", "bx", "by"]
#: Cells of a tile in one direction; rows that a task takes together, and those of a tile at most.
ACROSS, ROWS, MOST = 32, 50_000, 400_000
#: Coordinates in cells up to which nodes, and their differences, are exact as doubles.
EXACT = 2.0**50


def segments(lines: DataFrame, grid: float) -> DataFrame:
    """net, ax, ay, bx, by: the segments of lines (net, points), in cells of the grid, the smaller end first. Points that are null or not finite end a segment."""
    cell = lambda v: F.floor(v / grid + 0.5).cast("long")
    fit = lambda p: F.abs(F.get(p, F.lit(0))) + F.abs(F.get(p, F.lit(1))) < EXACT * grid
    node = lambda p: F.when(fit(p), F.struct(cell(F.get(p, F.lit(0))).alias("x"), cell(F.get(p, F.lit(1))).alias("y")))
    nodes = F.transform("points", node)
    n = F.greatest(F.size("points") - 1, F.lit(0))
    pairs = F.zip_with(F.slice(nodes, F.lit(1), n), F.slice(nodes, F.lit(2), n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    rows = lines.select("net", F.explode(pairs).alias("s")).select("net", "s.p", "s.q").filter("p is not null and q is not null and p <> q")
    rows = rows.select("net", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return rows.select("net", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def _tile(v: Column, tile: int) -> Column:
    """The tile of a whole number, without rounding."""
    return ((v - F.pmod(v, F.lit(tile))) / tile).cast("long")


def in_tiles(segs: DataFrame, tile: int) -> DataFrame:
    """Segments with tx, ty of each tile that they touch, or come within two cells of; long ones by pieces of about a tile, whose boxes are small whatever their direction."""
    low, high = ([_tile(f(f"a{c}", f"b{c}") + step, tile) for c in "xy"] for f, step in ((F.least, -2), (F.greatest, 2)))
    at = lambda x, y: F.struct(x.alias("tx"), y.alias("ty"))
    d = lambda c: F.col(c).cast("double")
    parts = F.ceil(F.greatest(F.abs(d("bx") - d("ax")), F.abs(d("by") - d("ay"))) / tile).cast("int")
    place = lambda c, k: d(f"a{c}") + (d(f"b{c}") - d(f"a{c}")) * k / parts
    span = lambda c, k: F.sequence(_tile((F.floor(F.least(place(c, k), place(c, k + 1))) - 2).cast("long"), tile), _tile((F.ceil(F.greatest(place(c, k), place(c, k + 1))) + 2).cast("long"), tile))
    touched = F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.flatten(F.transform(span("x", k), lambda x: F.transform(span("y", k), lambda y: at(x, y))))))
    one = (low[0] == high[0]) & (low[1] == high[1])
    return segs.withColumn("t", F.explode(F.when(one, F.array(at(*low))).otherwise(F.array_distinct(touched)))).select("net", *ENDS, "t.*")


def _cuts(pairs: DataFrame) -> DataFrame:
    """net, ends of a segment, x, y: where the segments of pairs (l_net, l_seg, r_seg) cut each other, but for their own ends. Both get the same node: an end that is at most a cell away, else the rounded crossing."""
    # One step after the other, so that no expression is repeated inside the next.
    v = lambda side, c: F.col(f"{side}_seg")[c].cast("double")
    dx, dy, ex, ey = v("l", "bx") - v("l", "ax"), v("l", "by") - v("l", "ay"), v("r", "bx") - v("r", "ax"), v("r", "by") - v("r", "ay")
    qx, qy = v("r", "ax") - v("l", "ax"), v("r", "ay") - v("l", "ay")
    rows = pairs.select(F.col("l_net").alias("net"), "l_seg", "r_seg", (dx * ey - dy * ex).alias("turn"), (qx * ey - qy * ex).alias("t"), (qx * dy - qy * dx).alias("u"))
    rows = rows.withColumns({"t": F.try_divide("t", "turn"), "u": F.try_divide("u", "turn")})
    crosses = (F.col("turn") != 0) & F.col("t").between(0, 1) & F.col("u").between(0, 1)
    x, y = (F.floor(v("l", f"a{c}") + F.col("t") * d + 0.5).cast("long") for c, d in (("x", dx), ("y", dy)))
    rows = rows.select("net", "l_seg", "r_seg", F.when(crosses, x).alias("x"), F.when(crosses, y).alias("y"))
    end = lambda side, e: F.struct(F.col(f"{side}_seg")[f"{e}x"].alias("x"), F.col(f"{side}_seg")[f"{e}y"].alias("y"))
    close = lambda e: (F.abs(e["x"] - F.col("x")) <= 1) & (F.abs(e["y"] - F.col("y")) <= 1)
    ends = [end(side, e) for side in "lr" for e in "ab"]
    crossing = F.when(F.col("x").isNotNull(), F.coalesce(*[F.when(close(e), e) for e in ends], F.struct("x", "y")))

    def on(p: Column, side: str) -> Column:
        """An end that lies on the other segment, at most half a cell off."""
        px, py = p["x"] - v(side, "ax"), p["y"] - v(side, "ay")
        sx, sy = v(side, "bx") - v(side, "ax"), v(side, "by") - v(side, "ay")
        along, long = px * sx + py * sy, sx * sx + sy * sy
        off = px * sy - py * sx
        return F.when((along > 0) & (along < long) & (off * off <= 0.25 * long), p)

    rows = rows.select("net", "l_seg", "r_seg", crossing.alias("at"), *[on(p, side).alias(f"{side}{k}") for side, others in (("l", ends[2:]), ("r", ends[:2])) for k, p in enumerate(others)])
    inner = lambda side, c: F.when((F.col(c) != end(side, "a")) & (F.col(c) != end(side, "b")), F.struct(F.col(f"{side}_seg").alias("seg"), F.col(c).alias("at")))
    found = [inner(side, c) for side in "lr" for c in ("at", f"{side}0", f"{side}1")]
    rows = rows.filter(F.coalesce(*found).isNotNull()).select("net", F.explode(F.array(*found)).alias("c")).filter("c is not null")
    return rows.select("net", "c.seg.*", "c.at.*")


PIECES = "net string, ax long, ay long, bx long, by long, x long, y long, large boolean"


def _batch(schema: str, n: int, **columns) -> pa.RecordBatch:
    """n rows of a schema; columns that are not given are null."""
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<array<array<double>>>": pa.list_(pa.list_(pa.list_(pa.float64())))}
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], types[k]) if c in columns else pa.nulls(n, types[k]) for c, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=list(names))


def _columns(t: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [t[c].to_numpy() for c in names]


def _net(t: pa.Table, rows: np.ndarray) -> pa.Array:
    return t["net"].combine_chunks().take(pa.array(rows))


def _cut_tiles(cell: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (net, ax, ay, bx, by, tx, ty) of whole tiles to edges of segments that lie in one tile (without x, y), and nodes x, y of others, their first ends among them. Segments of tiles with more than MOST rows come back as they are (large)."""
    tile = cell * ACROSS

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups_up_to(batches, ["net", "tx", "ty"], ROWS, MOST):
            ends = _columns(t, ENDS)
            if group is None:
                yield _batch(PIECES, t.num_rows, net=t["net"].combine_chunks(), **dict(zip(ENDS, ends, strict=True)), large=np.ones(t.num_rows, bool))
                continue
            rows = ln.unique_rows(group, *ends)
            group, ends, corner = group[rows], [e[rows] for e in ends], [v[rows] * tile for v in _columns(t, ["tx", "ty"])]
            seg, x, y = ln.cuts(group, ends, corner, cell, ACROSS)
            own = np.all([(np.minimum(a, b) - 2 >= o) & (np.maximum(a, b) + 2 < o + tile) for a, b, o in zip(ends[:2], ends[2:], corner, strict=True)], axis=0)
            mine = own[seg]
            number = np.cumsum(own) - 1
            piece, made = ln.between_nodes([e[own] for e in ends], (number[seg[mine]], x[mine], y[mine]))
            yield _batch(PIECES, len(piece), net=_net(t, rows[np.flatnonzero(own)[piece]]), **dict(zip(ENDS, made, strict=True)), large=np.zeros(len(piece), bool))
            others = np.flatnonzero(~own)
            seg, x, y = np.concatenate([others, seg[~mine]]), np.concatenate([ends[0][others], x[~mine]]), np.concatenate([ends[1][others], y[~mine]])
            yield _batch(PIECES, len(seg), net=_net(t, rows[seg]), **dict(zip(ENDS, (e[seg] for e in ends), strict=True)), x=x, y=y, large=np.zeros(len(seg), bool))

    return cut


def edges(pieces: DataFrame, size: float) -> DataFrame:
    """net, ax, ay, bx, by: the edges in pieces, and those of segments of several tiles, cut at the nodes that any of these found. size: of the cells in which segments of tiles with too many rows meet. An edge may come back more than once."""
    d = lambda c: F.col(c).cast("double")
    nodes = pieces.filter("x is not null").select("net", *ENDS, "x", "y")
    large = pieces.filter("large").select("net", *ENDS).distinct()
    if not large.isEmpty():
        # Long segments meet others by pieces of about a cell, whose boxes are small whatever their direction.
        parts = F.greatest(F.lit(1.0), F.ceil(F.greatest(F.abs(d("bx") - d("ax")), F.abs(d("by") - d("ay"))) / size)).cast("int")
        by = large.select("net", *ENDS, parts.alias("parts")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        at = lambda c, k: d(f"a{c}") + (d(f"b{c}") - d(f"a{c}")) * k / F.col("parts")
        boxes = by.select("net", F.struct(*ENDS).alias("seg"), *[(f(at(c, F.col("k")), at(c, F.col("k") + 1)) + step).alias(f"{c}{e}") for f, step, e in ((F.least, -1, 0), (F.greatest, 1, 1)) for c in "xy"])
        nodes = nodes.unionByName(_cuts(box_join(boxes, boxes, size, self_join_on="seg", by=["net"]).select("l_net", "l_seg", "r_seg")))
        nodes = nodes.unionByName(large.select("net", *ENDS, F.col("ax").alias("x"), F.col("ay").alias("y")))
    along = (d("x") - d("ax")) * (d("bx") - d("ax")) + (d("y") - d("ay")) * (d("by") - d("ay"))
    # A segment is the row of its first end; the second end comes in where the order goes past it.
    place, last = F.struct(along.alias("along"), "x", "y"), F.struct((F.pow(d("bx") - d("ax"), 2) + F.pow(d("by") - d("ay"), 2)).alias("along"), F.col("bx").alias("x"), F.col("by").alias("y"))
    order = Window.partitionBy("net", *ENDS).orderBy(along, "x", "y")
    rows = nodes.distinct().select("net", place.alias("p"), F.lead(place).over(order).alias("q"), last.alias("b"))
    way = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    passes = (F.col("p") < F.col("b")) & F.coalesce(F.col("q") > F.col("b"), F.lit(True))
    rows = rows.select("net", F.explode(F.when(passes, F.array(way("p", "b"), way("b", "q"))).otherwise(F.array(way("p", "q")))).alias("s"))
    node = lambda c: F.struct(F.col(f"s.{c}.x").alias("x"), F.col(f"s.{c}.y").alias("y"))
    rows = rows.filter("s.q is not null").select("net", node("p").alias("p"), node("q").alias("q")).filter("p <> q")
    rows = rows.select("net", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    rows = rows.select("net", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))
    return pieces.filter("x is null and not large").select("net", *ENDS).unionByName(rows)


def _name(*of: Column | str) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in of])))


BOX, FIRST = ["x0", "y0", "x1", "y1"], ["fax", "fay", "fbx", "fby"]
RINGS = "net string, rings array<array<array<double>>>, area double, outer boolean, x0 double, y0 double, x1 double, y1 double"
#: Rings, or half-edges of paths: c, to which the next one leads, f, the path's first half-edge, and whether it is the path's last one.
FOUND = f"{RINGS}, ax long, ay long, bx long, by long, cx long, cy long, fax long, fay long, fbx long, fby long, last boolean, large boolean"


def _rings(schema: str, t: pa.Table, source: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray, offsets: np.ndarray, cell: int | None) -> pa.RecordBatch:
    """Rings with their areas, without those that bound nothing; with a cell, holes in faces of their group become part of the smallest one. source: the row of t of each node."""
    outer, area = ln.measured(x, y, offsets)
    keep = np.flatnonzero(area > 0)
    n = np.diff(offsets)[keep]
    at = np.repeat(offsets[:-1][keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    x, y, source, group, outer, area, offsets = x[at], y[at], source[at], group[at], outer[keep], area[keep], np.append(0, np.cumsum(n))
    if not len(keep):
        return _batch(schema, 0)
    bounds = [f.reduceat(v, offsets[:-1]) for f in (np.minimum, np.maximum) for v in (x, y)]
    owner = np.arange(len(keep))
    if cell is not None:
        face = ln.within(group[offsets[:-1]], outer, area, bounds, x, y, offsets, cell)
        owner = np.where(face >= 0, face, owner)
        area = np.where(owner == np.arange(len(keep)), area - np.bincount(owner, np.where(face >= 0, area, 0), len(keep)), area)
    order = np.lexsort((np.arange(len(keep)), owner != np.arange(len(keep)), owner))
    begins = np.flatnonzero(owner[order] == order)
    # Rings are closed: each ends with its first node.
    n = np.diff(offsets)[order] + 1
    at = np.repeat(offsets[:-1][order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at[np.cumsum(n) - 1] = offsets[:-1][order]
    points = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * 2, pa.int32()), pa.array(np.stack([x[at], y[at]], 1).ravel().astype(np.float64)))
    rings = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), points)
    rings = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), rings)
    whole = order[begins]
    more = {"large": np.zeros(len(whole), bool)} if schema == FOUND else {}
    return _batch(schema, len(whole), net=_net(t, source[offsets[:-1][whole]]), rings=rings, area=area[whole], outer=outer[whole], **{c: b[whole].astype(np.float64) for c, b in zip(BOX, bounds, strict=True)}, **more)


def _join_tiles(cell: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From half-edges (net, ax, ay, bx, by, tx, ty) of whole tiles, those of their second ends, to the faces in one tile, with their holes; holes of other faces; and the half-edges of outlines of several tiles. Half-edges of tiles with more than MOST rows come back as they are (large)."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups_up_to(batches, ["net", "tx", "ty"], ROWS, MOST):
            ends = _columns(t, ENDS)
            if group is None:
                yield _batch(FOUND, t.num_rows, net=t["net"].combine_chunks(), **dict(zip(ENDS, ends, strict=True)), large=np.ones(t.num_rows, bool))
                continue
            rows = ln.unique_rows(group, *ends)
            group, ends = group[rows], [e[rows] for e in ends]
            cx, cy, to, twin = ln.turns(group, ends)
            opened, label = ln.walks(to)
            at, offsets = ln.rings(~opened, label, to, twin)
            yield _rings(FOUND, t, rows[at], group[at], ends[0][at], ends[1][at], offsets, cell)
            path = np.flatnonzero(opened)
            yield _batch(FOUND, len(path), net=_net(t, rows[path]), **{c: e[path] for c, e in zip(ENDS, ends, strict=True)}, cx=cx[path], cy=cy[path], **{c: e[label[path]] for c, e in zip(FIRST, ends, strict=True)}, last=to[path] < 0, large=np.zeros(len(path), bool))

    return join


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (net, outline, ax, ay, bx, by, cx, cy) of whole outlines to their rings."""
    for t, group in groups_up_to(batches, ["outline"], ROWS, 1 << 62):
        ends = _columns(t, ENDS)
        rows = ln.unique_rows(group, *ends)
        group, ends = group[rows], [e[rows] for e in ends]
        to, twin = ln.follows(group, ends, *(v[rows] for v in _columns(t, ["cx", "cy"])))
        at, offsets = ln.rings(np.ones(len(rows), bool), ln.walks(to)[1], to, twin)
        yield _rings(RINGS, t, rows[at], group[at], ends[0][at], ends[1][at], offsets, None)


def outlines(found: DataFrame) -> DataFrame:
    """net, outline, ax, ay, bx, by, cx, cy: the half-edges of outlines of several tiles, with the same outline for all that follow each other. Paths are named by their first half-edges; half-edges of tiles with too many rows are paths of their own."""
    half = found.filter("cx is not null").select("net", *ENDS, "cx", "cy", *FIRST, "last")
    large = found.filter("large").select("net", *ENDS).distinct()
    if not large.isEmpty():
        # Around the node b that half-edges lead to, in the order of the angles back to their a: the one before leads on.
        angle = F.atan2((F.col("ay") - F.col("by")).cast("double"), (F.col("ax") - F.col("bx")).cast("double"))
        around = Window.partitionBy("net", "bx", "by").orderBy(angle, "ax", "ay")
        other = F.struct("ax", "ay")
        before = F.coalesce(F.lag(other).over(around), F.last(other).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        turned = large.select("net", *ENDS, before.alias("c"))
        half = half.unionByName(turned.select("net", *ENDS, F.col("c.ax").alias("cx"), F.col("c.ay").alias("cy"), *[F.col(c).alias(f) for c, f in zip(ENDS, FIRST, strict=True)], F.lit(True).alias("last")))
    of = connected(half.filter("last").select(_name("net", *FIRST).alias("a"), _name("net", "bx", "by", "cx", "cy").alias("b")))
    return half.withColumn("id", _name("net", *FIRST)).hint("merge").join(of.hint("merge"), "id").select("net", F.col("root").alias("outline"), *ENDS, "cx", "cy")


@tidy
def polygonize(lines: DataFrame, grid: float = 1e-3, size: float = 50.0, least: float = 0.0, most: float | None = None) -> DataFrame:
    """The faces of lines (net, points): net, face, rings (the outer one, then holes; closed), area. Lines of different nets do not meet.

    grid: the cell to which nodes are rounded; size: about the usual length of a line; faces under ``least`` or over ``most`` square units are left out, after their holes have been taken off. Empty nets have no faces."""
    width = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = max(16, round(size / grid))
    tile = cell * ACROSS
    tiled = lambda rows: rows.repartition(width, "net", "tx", "ty").sortWithinPartitions("ty", "tx", "net")
    pieces = materialise(tiled(in_tiles(segments(lines, grid), tile)).mapInArrow(_cut_tiles(cell), PIECES))
    way = lambda *of: F.struct(*[F.col(c).alias(e) for c, e in zip(of, ENDS, strict=True)])
    half = edges(pieces, cell).select("net", F.explode(F.array(way(*ENDS), way("bx", "by", "ax", "ay"))).alias("h")).select("net", "h.*")
    half = half.withColumns({"tx": _tile(F.col("bx"), tile), "ty": _tile(F.col("by"), tile)})
    found = materialise(tiled(half).mapInArrow(_join_tiles(cell), FOUND))
    discard(pieces)
    rings = materialise(outlines(found).repartition(width, "outline").sortWithinPartitions("outline").mapInArrow(_chained, RINGS))
    own = found.filter("rings is not null")
    ring = F.get("rings", F.lit(0))
    # A ring is named by its first edge, from its smallest node on.
    at = lambda k, c: F.get(F.get(ring, F.lit(k)), F.lit(c)).cast("long")
    name = F.upper(F.md5(F.concat_ws(",", "net", *[at(k, c).cast("string") for k in (0, 1) for c in (0, 1)])))
    faces = rings.filter("outer").select("net", name.alias("face"), "rings", "area", *BOX)
    holes = rings.filter("not outer").select("net", *BOX, "rings", "area").unionByName(own.filter("not outer").select("net", *BOX, "rings", "area"))
    holes = holes.select("net", name.alias("hole"), ring.alias("ring"), "area", *BOX)
    # What is as large as the largest face of several tiles, as the outside of a whole drawing, is in none of them.
    holes_within = holes.join(F.broadcast(faces.agg(F.max("area").alias("largest"))), F.col("area") < F.col("largest")).drop("largest")  # one row
    near = box_join(holes_within.select("net", "hole", "area", *BOX, F.get("ring", F.lit(0)).alias("p")), faces.select("net", "face", "area", *BOX), cell, by=["net"])
    around = (F.col("r_area") > F.col("l_area")) & (F.col("r_x0") <= F.col("l_x0")) & (F.col("r_y0") <= F.col("l_y0")) & (F.col("r_x1") >= F.col("l_x1")) & (F.col("r_y1") >= F.col("l_y1"))
    near = near.filter(around).hint("merge").join(faces.select(F.col("face").alias("r_face"), ring.alias("r_ring")).hint("merge"), "r_face")
    near = near.filter(geo.point_in_ring(F.get("l_p", F.lit(0)), F.get("l_p", F.lit(1)), F.col("r_ring")))
    of = near.groupBy(F.col("l_hole").alias("hole")).agg(F.min_by("r_face", F.struct("r_area", "r_face")).alias("face"))
    inner = of.hint("merge").join(holes.select("hole", "ring", F.col("area").alias("size")).hint("merge"), "hole").groupBy("face").agg(F.sum("size").alias("holes"), F.array_sort(F.collect_list("ring")).alias("inner"))
    wide = faces.hint("merge").join(inner.hint("merge"), "face", "left")
    wide = wide.select("net", "face", F.concat("rings", F.coalesce("inner", F.array().cast("array<array<array<double>>>"))).alias("rings"), (F.col("area") - F.coalesce("holes", F.lit(0.0))).alias("area"))
    out = own.filter("outer").select("net", name.alias("face"), "rings", "area").unionByName(wide)
    scaled = F.transform("rings", lambda r: F.transform(r, lambda p: F.transform(p, lambda v: v * grid)))
    out = out.select("net", "face", scaled.alias("rings"), (F.col("area") * grid * grid).alias("area")).filter(F.col("area") >= least)
    return out.filter(F.col("area") <= most) if most is not None else out
