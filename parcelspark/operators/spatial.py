"""Spatial joins by a grid of cells.

Every box is written to the cells it covers, cells are joined by equality, and the exact predicate follows; a pair that shares several cells is kept in its lowest one, so no distinct is needed. The work is an equi-join that Spark shuffles and splits as any other.

Cells come in levels, each ``STEP`` times as wide as the one before. A box belongs to the first level where it is at most ``STEP`` cells wide and high, so it covers a bounded number of cells whatever its size, and is written to the coarser levels that are in use too; a pair meets at the coarser level of its two. The caller picks the cells of the first level about as large as the usual boxes.

Tables may have a geometry besides the box, ``parts`` (an array of polygons); then the box only finds candidates, and the predicate is that of the polygons. Boxes with a null or non-finite side meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import geometry as geo
from parcelspark.functions import planar

BOX = ["x0", "y0", "x1", "y1"]
STEP, LEVELS = 8, 16


def with_box(df: DataFrame) -> DataFrame:
    """df with the bounds of its parts as x0, y0, x1, y1."""
    return df.withColumns(planar.bounds(F.col("parts")))


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size).cast("long")


def _level(df: DataFrame, prefix: str, size: float) -> DataFrame:
    x0, y0, x1, y1 = (F.col(f"{prefix}{c}") for c in BOX)
    fit = (x0 <= x1) & (y0 <= y1) & (F.greatest(*[F.abs(v) for v in (x0, y0, x1, y1)]) < float("inf"))
    wide = F.greatest(x1 - x0, y1 - y0)
    level = F.ceil(F.log(float(STEP), F.greatest(wide / (size * STEP), F.lit(1.0)))).cast("int")
    return df.filter(fit).withColumn(f"{prefix}level", F.least(level, F.lit(LEVELS)))


def _levels(*leveled: tuple[DataFrame, str]) -> DataFrame:
    """One row, levels: an array of those in use, from an aggregate of bits, in the same query."""
    bits = None
    for df, prefix in leveled:
        own = df.select(F.expr(f"shiftleft(1, {prefix}level)").alias("bit"))
        bits = own if bits is None else bits.unionByName(own)
    bits = bits.agg(F.coalesce(F.bit_or("bit"), F.lit(1)).alias("bits"))
    return bits.select(F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.getbit("bits", k) == 1).alias("levels"))


#: How a pair of boxes meets in a cell: the left one in its own level, or in a coarser one, where the right one is in its own. Two boxes that are both in a coarser level than theirs never meet there.
OWN, LIFTED = 0, 1


def _gridded(df: DataFrame, prefix: str, size: float, levels: DataFrame, left: bool = True) -> DataFrame:
    """df with level, meets, cx, cy of each cell that a box covers, in its own level and in coarser ones that are in use."""
    x0, y0, x1, y1 = (F.col(f"{prefix}{c}") for c in BOX)
    df = df.join(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda level: level >= F.col(f"{prefix}level"))))
    own = F.col("level") == F.col(f"{prefix}level")
    if left:
        df = df.withColumn("meets", F.when(own, OWN).otherwise(LIFTED))
    else:
        finer = F.array_min("levels") < F.col("level")
        df = df.withColumn("meets", F.explode(F.when(own & finer, F.array(F.lit(OWN), F.lit(LIFTED))).otherwise(F.array(F.lit(OWN)))))
    df = df.drop("levels")
    width = F.pow(F.lit(float(STEP)), F.col("level")) * size
    df = df.withColumn("cx", F.explode(F.sequence(_cell(x0, width), _cell(x1, width))))
    return df.withColumn("cy", F.explode(F.sequence(_cell(y0, width), _cell(y1, width))))


def box_join(left: DataFrame, right: DataFrame, size: float, touching: bool = True, self_join_on: str | None = None, by: list[str] | None = None, ids: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows whose boxes (x0, y0, x1, y1) meet; columns come back as l_* and r_*.

    touching: whether boxes that only share an edge meet. self_join_on: for a join of a table with itself, only pairs with l < r in this column. by: columns that must be equal too. ids: unique columns of both sides; then geometries (parts) stay out of the cells and are joined to the pairs by them."""
    heavy = [c for c in ("parts",) if ids]
    side = lambda df, p: _level(df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in heavy]), p, size)
    lft, rgt = side(left, "l_"), side(right, "r_")
    levels = _levels((lft, "l_")) if self_join_on and left is right else _levels((lft, "l_"), (rgt, "r_"))
    g1, g2 = _gridded(lft, "l_", size, levels), _gridded(rgt, "r_", size, levels, left=False)
    if by:
        g1, g2 = (g.withColumns({f"__by{k}": F.col(f"{p}{c}") for k, c in enumerate(by)}) for g, p in ((g1, "l_"), (g2, "r_")))
    same = [f"__by{k}" for k in range(len(by or []))]
    width = F.pow(F.lit(float(STEP)), F.col("level")) * size
    lowest = (F.col("cx") == _cell(F.greatest("l_x0", "r_x0"), width)) & (F.col("cy") == _cell(F.greatest("l_y0", "r_y0"), width))
    le = (lambda a, b: F.col(a) <= F.col(b)) if touching else (lambda a, b: F.col(a) < F.col(b))
    meet = le("l_x0", "r_x1") & le("r_x0", "l_x1") & le("l_y0", "r_y1") & le("r_y0", "l_y1")
    joined = g1.join(g2, ["level", "meets", "cx", "cy", *same]).filter(meet & lowest).drop("level", "meets", "cx", "cy", "l_level", "r_level", *same)
    joined = joined.filter(F.col(f"l_{self_join_on}") < F.col(f"r_{self_join_on}")) if self_join_on else joined
    for df, p, id_ in ((left, "l_", (ids or ("",))[0]), (right, "r_", (ids or ("",))[-1])):
        if ids and "parts" in df.columns:
            joined = joined.join(df.select(F.col(id_).alias(f"{p}{id_}"), F.col("parts").alias(f"{p}parts")), f"{p}{id_}")
    return joined


def points_in(points: DataFrame, areas: DataFrame, size: float, id_: str, order: str) -> DataFrame:
    """Each point (x, y) with the first of the areas (by ``order``) that holds it, or nulls: columns of points, then b_*. The boundary counts as inside. areas: with an ``order`` of their own each, boxes, or polygons as parts with their boxes."""
    heavy = "parts" in areas.columns
    b = _level(areas.select(*[F.col(c).alias(f"b_{c}") for c in areas.columns if c != "parts"]), "b_", size)
    levels = _levels((b, "b_"))
    p = points.select(id_, "x", "y").join(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels")
    width = F.pow(F.lit(float(STEP)), F.col("level")) * size
    p = p.withColumn("cx", _cell(F.col("x"), width)).withColumn("cy", _cell(F.col("y"), width))
    b = _gridded(b, "b_", size, levels).filter("level = b_level").drop("b_level", "meets")
    hit = p.join(b, ["level", "cx", "cy"]).filter(F.col("x").between(F.col("b_x0"), F.col("b_x1")) & F.col("y").between(F.col("b_y0"), F.col("b_y1")))
    if heavy:
        hit = hit.join(areas.select(F.col(order).alias(f"b_{order}"), F.col("parts").alias("b_parts")), f"b_{order}")
        hit = hit.filter(planar.holds(F.col("b_parts"), F.col("x"), F.col("y")))
    first = hit.groupBy(id_).agg(F.min_by(F.struct(*[f"b_{c}" for c in areas.columns]), F.col(f"b_{order}")).alias("__b"))
    return points.join(first, id_, "left").select(*points.columns, *[F.col("__b")[f"b_{c}"].alias(f"b_{c}") for c in areas.columns])


def overlap_area(pairs: DataFrame) -> Column:
    """The area that the two sides (l_*, r_*) of a pair share: that of their polygons, where both have parts, else of their boxes."""
    if {"l_parts", "r_parts"} <= set(pairs.columns):
        return planar.shared_area(F.col("l_parts"), F.col("r_parts"))
    w = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    h = F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0")
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def own_area(df: DataFrame, prefix: str = "") -> Column:
    """The area of a row's polygons, or of its box."""
    if f"{prefix}parts" in df.columns:
        return planar.area(F.col(f"{prefix}parts"))
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def outline(df: DataFrame, prefix: str = "") -> Column:
    """A row's first outer ring, or its box as a ring."""
    if f"{prefix}parts" in df.columns:
        return F.get(F.get(F.col(f"{prefix}parts"), F.lit(0)), F.lit(0))
    return geo.rectangle(*[F.col(f"{prefix}{c}") for c in BOX])


def nearest_area(points: DataFrame, areas: DataFrame, size: float, within: float, id_: str, code: str) -> DataFrame:
    """For each point (x, y) the area that holds it, else the nearest one within so many metres of it; ties by code. Columns id_, code, distance and approx (it lies outside); points without any are left out.

    areas: boxes, or polygons as parts with their boxes."""
    around = points.select(id_, "x", "y", (F.col("x") - within).alias("x0"), (F.col("y") - within).alias("y0"), (F.col("x") + within).alias("x1"), (F.col("y") + within).alias("y1"))
    near = box_join(around, areas, size)
    if "parts" in areas.columns:
        x, y = F.col("l_x"), F.col("l_y")
        outlines = F.flatten(F.col("r_parts"))
        d = F.when(planar.holds(F.col("r_parts"), x, y), 0.0).otherwise(F.array_min(F.transform(outlines, lambda r: geo.distance_to_ring(x, y, r))))
    else:
        dx = F.greatest(F.col("r_x0") - F.col("l_x"), F.lit(0.0), F.col("l_x") - F.col("r_x1"))
        dy = F.greatest(F.col("r_y0") - F.col("l_y"), F.lit(0.0), F.col("l_y") - F.col("r_y1"))
        d = F.sqrt(dx * dx + dy * dy)
    near = near.withColumn("d", d).filter(F.col("d") <= within)
    best = near.groupBy(F.col(f"l_{id_}").alias(id_)).agg(F.min(F.struct("d", F.col(f"r_{code}").alias(code))).alias("b"))
    return best.select(id_, F.col("b")[code].alias(code), F.col("b.d").alias("distance"), (F.col("b.d") > 0).alias("approx"))


def nearest_in_degrees(points: DataFrame, areas: DataFrame, size: float, within: float, id_: str, code: str) -> DataFrame:
    """As nearest_area, for points (lon, lat) and polygons (parts) in degrees: candidates are found in metres of the projection, distances are those on the ellipsoid, from the nearest point of the outlines. A point within a micrometre of an outline, which is less than the projection's rounding, lies on it. Columns id_, code, distance and approx."""
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    p = points.select(id_, x.alias("x"), y.alias("y"))
    # The projection's scale is within a thousandth of 1 in its zone.
    r = within * 1.002
    around = p.select(id_, "x", "y", (F.col("x") - r).alias("x0"), (F.col("y") - r).alias("y0"), (F.col("x") + r).alias("x1"), (F.col("y") + r).alias("y1"))
    shapes = areas.select(code, F.explode(F.array(geo.parts_to_utm(F.col("parts")))).alias("parts"))  # a column from here on
    shapes = with_box(shapes)
    near = box_join(around, shapes, size, ids=(id_, code))
    near = near.withColumn("inside", planar.holds(F.col("r_parts"), F.col("l_x"), F.col("l_y"))).withColumn("n", geo.nearest_on(F.col("l_x"), F.col("l_y"), F.flatten("r_parts")))
    ends = lambda n, x, y: geo.geodesic(*geo.to_wgs84(x, y), *geo.to_wgs84(n["px"], n["py"]))
    near = near.withColumn("d", F.when(F.col("inside") | (F.col("n.d") < 1e-6), 0.0).otherwise(geo.let(ends, F.col("n"), F.col("l_x"), F.col("l_y")))).filter(F.col("d") <= within)
    best = near.groupBy(F.col(f"l_{id_}").alias(id_)).agg(F.min(F.struct("d", F.col(f"r_{code}").alias(code))).alias("b"))
    return best.select(id_, F.col("b")[code].alias(code), F.col("b.d").alias("distance"), (F.col("b.d") > 0).alias("approx"))
