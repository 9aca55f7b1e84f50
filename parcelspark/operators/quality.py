"""Quality analysis of a parcel layer: identifiers, duplicates, slivers, overlaps, gaps, boundary; errors, counters, score.

A parcel is a row of feature_idx, nicad_raw and a box x0, y0, x1, y1, which is the parcel itself or, where there is a column parts (an array of polygons), the bounds of its geometry. Errors are rows of error_type, severity, feature_idx, nicad1, nicad2, area, confidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import geometry as geo
from parcelspark.functions import nicad as nic
from parcelspark.functions import planar
from parcelspark.functions.text import half_up
from parcelspark.operators.components import connected
from parcelspark.operators.grouping import whole_groups
from parcelspark.operators.lineage import materialise, tidy
from parcelspark.operators.spatial import BOX, STEP, box_join, outline, overlap_area, own_area

ERROR = ["error_type", "severity", "feature_idx", "nicad1", "nicad2", "area", "confidence"]
#: The order of severities, which is not that of their names (fixed values).
SEVERITIES = ["critical", "high", "medium", "low"]


def severity_rank(c: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for k, s in enumerate(SEVERITIES):
        out = F.when(F.lower(c) == s, k).otherwise(out)
    return out


def _named(nicad: Column, idx: Column) -> Column:
    return F.when(nicad != "", nicad).otherwise(F.concat(F.lit("feature_"), idx.cast("string")))


def _error(df: DataFrame, kind: str, severity: Column | str, nicad1: Column, nicad2: Column | None = None, area: Column | None = None, confidence: float = 1.0) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    none = F.lit(None)
    return df.select(F.lit(kind).alias("error_type"), severity.alias("severity"), "feature_idx", nicad1.alias("nicad1"), (none.cast("string") if nicad2 is None else nicad2).alias("nicad2"), (none.cast("double") if area is None else area).alias("area"), F.lit(confidence).alias("confidence"))


def trimmed(parcels: DataFrame) -> DataFrame:
    return parcels.withColumn("nicad", F.trim(F.coalesce("nicad_raw", F.lit("")))).withColumn("missing", nic.is_missing(F.col("nicad")))


def nicad_counters(parcels: DataFrame) -> DataFrame:
    """One row of overlapping counters over the identifiers."""
    n, missing = F.length("nicad"), F.col("missing")
    short = missing | (n < 8)
    return trimmed(parcels).agg(
        F.count("*").alias("total"),
        F.count_if(~short).alias("with_nicad"),
        F.count_if(short).alias("without_nicad"),
        F.count_if(~missing & (n > 0) & (n < 8)).alias("short_nicad"),
        F.count_if(~missing & (n == 16)).alias("valid_16"),
        F.count_if(~missing & (n > 0) & (n != 16)).alias("invalid_length"),
    )


def missing_nicad(parcels: DataFrame) -> DataFrame:
    """Errors of parcels whose identifier is missing or shorter than 8."""
    return _error(trimmed(parcels).filter("missing or length(nicad) < 8"), "missing_nicad", "critical", F.lit(None).cast("string"))


def duplicates(parcels: DataFrame) -> DataFrame:
    """One row for each occurrence of an identifier that occurs more than once: its place in the group, the group's size and first occurrence.

    The sizes are aggregated first and joined back, so a frequent identifier is never sorted in one task; places come from ids, not from gathering a group."""
    rows = trimmed(parcels).filter("not missing and length(nicad) >= 8").select("feature_idx", "nicad")
    groups = rows.groupBy("nicad").agg(F.count("*").alias("occurrences"), F.min("feature_idx").alias("first_idx")).filter("occurrences > 1")
    return rows.join(groups, "nicad")


def duplicate_errors(parcels: DataFrame) -> DataFrame:
    return _error(duplicates(parcels), "duplicate", "critical", F.col("nicad"), F.col("feature_idx").cast("string"))


def duplicate_listing(parcels: DataFrame) -> DataFrame:
    """For each duplicated identifier its occurrences, as a text of ids in order: the one place where a group's ids become one value, since that is what is asked for."""
    ids = F.transform(F.array_sort(F.collect_list("feature_idx")), lambda i: i.cast("string"))
    return duplicates(parcels).groupBy("nicad").agg(F.count("*").alias("occurrences"), F.array_join(ids, ", ").alias("object_ids"))


def slivers(parcels: DataFrame) -> DataFrame:
    """Parcels with area, aspect of the box and whether they are slivers."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area = own_area(parcels)
    return parcels.withColumn("area", area).withColumn("aspect", geo.aspect_ratio(w, h)).withColumn("is_sliver", geo.is_sliver(area, w, h, F.col("x0")))


def is_valid(parcels: DataFrame) -> Column:
    """A geometry is there, and the outer ring of a single polygon has four vertices; parcels of several polygons are not looked into."""
    if "parts" not in parcels.columns:
        return F.coalesce(F.least(*[F.col(c) for c in BOX]).isNotNull(), F.lit(False))
    return F.coalesce((F.size("parts") > 1) | (F.size(F.get(F.get(F.col("parts"), F.lit(0)), F.lit(0))) >= 4), F.lit(False))


def is_simple(parcels: DataFrame) -> Column:
    """The stricter check of drawn parcels: a positive area, every ring closed with four vertices, and rings that cross neither themselves nor each other: then what lies in an odd number of rings is what the outer rings have more than the holes."""
    if "parts" not in parcels.columns:
        return (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    rings = F.flatten("parts")
    closed = F.forall(rings, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)))
    crossed = F.exists(rings, geo.crosses_itself) | (F.abs(planar.odd_area(F.col("parts").cast(planar.PARTS)) - planar.area(F.col("parts"))) > 1e-9 * planar.area(F.col("parts")))
    return F.coalesce((planar.area(F.col("parts")) > 0) & closed & ~crossed, F.lit(False))


def repaired(parcels: DataFrame) -> DataFrame:
    """parcels with their geometry made valid, and faulty: whether it was not."""
    return parcels.withColumn("faulty", ~is_simple(parcels)).withColumn("parts", planar.made_valid(F.col("parts").cast(planar.PARTS)))


def sliver_errors(parcels: DataFrame) -> DataFrame:
    rows = slivers(trimmed(parcels)).filter("is_sliver")
    return _error(rows, "sliver", "medium", _named(F.col("nicad"), F.col("feature_idx")), None, F.col("area"), 0.9)


def overlap_severity(percent: Column) -> Column:
    return F.when(percent > 50, "critical").when(percent > 20, "high").when(percent > 5, "medium").otherwise("low")


def overlaps(parcels: DataFrame, size: float = 60.0, least: float = 0.01, first: int | None = None, most: int | None = None) -> DataFrame:
    """Pairs (i < j) of parcels that overlap by ``least`` square metres: i, j, area, percent of the smaller one, severity.

    first and most give the report's caps: only the first features, only so many pairs in the order of (i, j). Without them every pair is found."""
    p = trimmed(parcels)
    p = p.filter(F.col("feature_idx") < first) if first else p
    pairs = box_join(p, p, size, touching=False, self_join_on="feature_idx", ids=("feature_idx", "feature_idx"))
    pairs = pairs.withColumn("area", overlap_area(pairs)).filter(F.col("area") >= least)
    smaller = F.least(own_area(pairs, "l_"), own_area(pairs, "r_"))
    percent = F.when(smaller > 0, F.col("area") / smaller * 100).otherwise(0.0)
    out = pairs.select(F.col("l_feature_idx").alias("i"), F.col("r_feature_idx").alias("j"), _named(F.col("l_nicad"), F.col("l_feature_idx")).alias("nicad1"), _named(F.col("r_nicad"), F.col("r_feature_idx")).alias("nicad2"), "area", percent.alias("percent"))
    out = out.withColumn("severity", overlap_severity(F.col("percent")))
    return out.orderBy("i", "j").limit(most) if most else out


def overlap_errors(parcels: DataFrame, **how) -> DataFrame:
    rows = overlaps(parcels, **how).withColumn("feature_idx", F.col("i"))
    return _error(rows, "overlap", F.col("severity"), F.col("nicad1"), F.col("nicad2"), F.col("area"), 0.99)


def partial_overlaps(parcels: DataFrame, size: float = 60.0) -> DataFrame:
    """Pairs whose interiors meet where neither holds the other: both have area outside what they share."""
    # Interiors meet only where those of the boxes do; only what that needs goes to the cells.
    slim = parcels.select("feature_idx", *BOX, *[c for c in ("parts",) if c in parcels.columns])
    pairs = box_join(slim, slim, size, touching=False, self_join_on="feature_idx", ids=("feature_idx", "feature_idx"))
    pairs = pairs.withColumn("shared", overlap_area(pairs)).filter("shared > 0")
    more = lambda side: own_area(pairs, side) - F.col("shared") > 1e-9 * own_area(pairs, side)
    return pairs.filter(more("l_") & more("r_")).select(F.col("l_feature_idx").alias("i"), F.col("r_feature_idx").alias("j"))


def intersecting(left: DataFrame, right: DataFrame, size: float = 60.0, self_join_on: str | None = None) -> DataFrame:
    """Pairs of rows whose geometries have a point in common, be it of their outlines: their interiors meet, or an outline comes within 1e-9 of the other's vertices or crosses it. Columns l_* and r_* without the geometries (parts). self_join_on: only pairs with l < r in this column.

    Of two rows that are boxes the boxes tell; geometries of boxes are not moved, but made again where the other row is none."""
    if not {"parts"} <= set(left.columns) & set(right.columns):
        return box_join(left, right, size, touching=True, self_join_on=self_join_on)
    thin = lambda df: df.filter("parts is not null").withColumn("parts", F.when(~F.coalesce(planar._is_box(F.col("parts")), F.lit(False)), F.col("parts")))
    lft = thin(left)
    pairs = box_join(lft, lft if right is left else thin(right), size, touching=True, self_join_on=self_join_on)
    boxes = F.col("l_parts").isNull() & F.col("r_parts").isNull()
    shape = lambda p: F.when(~boxes, F.coalesce(f"{p}parts", F.array(F.array(outline(pairs.drop(f"{p}parts"), p)))))
    pairs = pairs.withColumns({"__a": shape("l_"), "__b": shape("r_")})
    met = boxes | (planar.shared_area(F.col("__a"), F.col("__b")) > 0) | geo.touches(F.flatten("__a"), F.flatten("__b"))
    return pairs.filter(met).drop("__a", "__b", "l_parts", "r_parts")


def boundary_errors(parcels: DataFrame, boundary: DataFrame) -> DataFrame:
    """Parcels whose box leaves that of the boundary's first feature (lowest k); boundary is one row by construction."""
    first = boundary.orderBy("k").limit(1).select(*[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    out = trimmed(parcels).join(F.broadcast(first), (F.col("x0") < F.col("b_x0")) | (F.col("y0") < F.col("b_y0")) | (F.col("x1") > F.col("b_x1")) | (F.col("y1") > F.col("b_y1")))
    return _error(out, "boundary_cross", "high", _named(F.col("nicad"), F.col("feature_idx")), None, None, 0.9)


def _covered(batches):
    """From (cell, cx, cy, h1, h2, parts) in whole cells to the area that each cell's geometries cover in it. Copies, equal in both hashes, count once."""
    for t in whole_groups(batches, ["cx", "cy"], 20_000):
        cx, cy, cell = (t[c].to_numpy() for c in ("cx", "cy", "cell"))
        group = np.cumsum(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])]) - 1
        _, once = np.unique(np.stack([group, t["h1"].to_numpy(), t["h2"].to_numpy()], axis=1), axis=0, return_index=True)
        t, group = t.take(pa.array(once)), group[once]
        at = np.unique(group, return_index=True)[1]
        x0, y0, size = cx[once][at] * cell[once][at], cy[once][at] * cell[once][at], cell[once][at]
        area = planar.covered(t["parts"].combine_chunks(), group, np.stack([x0, y0, x0 + size, y0 + size], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(area)], names=["area"])


def _hulls(batches):
    """One row: the hull of all vertices of the batches."""
    kept = np.zeros((0, 2))
    for batch in batches:
        x, y, _, _ = planar.vertices(batch["parts"])
        kept = planar.hull(np.r_[kept[:, 0], x], np.r_[kept[:, 1], y])
    yield pa.RecordBatch.from_arrays([pa.array([kept[:, 0].tolist()], pa.list_(pa.float64())), pa.array([kept[:, 1].tolist()], pa.list_(pa.float64()))], names=["x", "y"])


def with_parts(parcels: DataFrame) -> DataFrame:
    """parcels with a geometry: that of their boxes, if they have no other."""
    return parcels if "parts" in parcels.columns else parcels.withColumn("parts", F.array(F.array(outline(parcels))))


def finite(parcels: DataFrame) -> DataFrame:
    """Parcels whose box has no null, infinite or inverted side."""
    x0, y0, x1, y1 = map(F.col, BOX)
    return parcels.filter((x0 <= x1) & (y0 <= y1) & (F.greatest(*[F.abs(v) for v in (x0, y0, x1, y1)]) < float("inf")))


#: Cells for each parcel, and besides, that are made at most; larger cells are taken beyond.
CELLS_EACH, CELLS = 16, 1 << 20


def _cell_size(parcels: DataFrame, cell: float, whole: bool) -> DataFrame:
    """One row, cell: the width of cells, STEP times as wide until the parcels' boxes (whole: or the layer's extent) are in few enough."""
    width = [cell * STEP**k for k in range(24)]
    span = lambda lo, hi, w: F.floor(hi / w) - F.floor(lo / w) + 1.0
    boxes = [F.sum(span(F.col("x0"), F.col("x1"), w) * span(F.col("y0"), F.col("y1"), w)) for w in width]
    extent = [span(F.min("x0"), F.max("x1"), w) * span(F.min("y0"), F.max("y1"), w) for w in width]
    most = CELLS_EACH * F.count("*") + CELLS
    fits = [F.when((F.greatest(n, e) if whole else n) <= most, F.lit(w)) for n, e, w in zip(boxes, extent, width, strict=True)]
    return parcels.agg(F.coalesce(*fits, F.lit(width[-1])).alias("cell"))


def _in_cells(parcels: DataFrame, cell: DataFrame) -> DataFrame:
    """cell, cx, cy, h1, h2, parts: parcels in each cell that their box touches."""
    p = finite(with_parts(parcels)).select(*BOX, F.col("parts").cast(planar.PARTS).alias("parts"))
    p = p.select("*", F.xxhash64("parts").alias("h1"), F.xxhash64(F.lit(1), "parts").alias("h2")).join(F.broadcast(cell))
    at = lambda c: F.floor(F.col(c) / F.col("cell")).cast("long")
    return p.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1")))).select("cell", "cx", "cy", "h1", "h2", "parts")


def union_area(parcels: DataFrame, cell: float = 120.0) -> DataFrame:
    """One row, area_union: what all parcels cover together. Every parcel goes to the cells that its box touches, a cell's task adds up what is covered in the cell, and the cells' areas are summed, so no geometry of the whole layer is ever made. Boxes that are not finite count for nothing; very large ones make the cells larger, not more."""
    width = max(1, int(parcels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = _in_cells(parcels, _cell_size(finite(parcels), cell, whole=False))
    met = cells.repartition(width, "cx", "cy").sortWithinPartitions("cx", "cy")
    return met.mapInArrow(_covered, "area double").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area_union"))


def _voids(batches):
    """From (cell, cx, cy, frame, parts) in whole cells, frame: the layer's hull, to the pieces of the hull that no geometry covers in the cell."""
    for t in whole_groups(batches, ["cx", "cy"], 5_000):
        cx, cy = t["cx"].to_numpy(), t["cy"].to_numpy()
        at = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
        ends = np.r_[at[1:], len(cx)]
        size = t["cell"].to_numpy()[at]
        x, y = cx[at] * size, cy[at] * size
        box = [[[[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]] for x, y, w in zip(x.tolist(), y.tolist(), size.tolist(), strict=True)]
        kind = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
        inside = planar.pieces(t["frame"].take(pa.array(at)).combine_chunks().cast(kind), pa.array(box, kind), "intersection")
        parts = t["parts"].to_pylist()
        lists = pa.array([[p for p in parts[i:j] if p is not None] for i, j in zip(at.tolist(), ends.tolist(), strict=True)], pa.list_(kind))
        left = planar.pieces(inside, planar.united_rows(lists), "difference").to_pylist()
        rows = [(int(cx[at[k]]), int(cy[at[k]]), i, [p], [x[k], y[k], size[k]]) for k, g in enumerate(left) for i, p in enumerate(g)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), kind, pa.list_(pa.float64())), strict=True)], names=["cx", "cy", "k", "parts", "cell"])


def void_pieces(parcels: DataFrame, cell: float = 120.0) -> DataFrame:
    """void, parts, area, x, y: the pieces, one cell each, of what the layer's hull has and no parcel covers, with their centres; void: the same for pieces that hang together across the edges of cells."""
    width = max(1, int(parcels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ring = F.transform(F.arrays_zip("x", "y"), lambda v: F.array(v["x"], v["y"]))
    some = finite(parcels)
    frame = hull(some).filter(F.size("x") > 2).select(F.array(F.array(ring)).alias("frame"))
    size = materialise(_cell_size(some, cell, whole=True))
    extent = some.agg(*[f(c).alias(n) for f, c, n in ((F.min, "x0", "x0"), (F.min, "y0", "y0"), (F.max, "x1", "x1"), (F.max, "y1", "y1"))]).join(F.broadcast(size))  # one row each
    at = lambda c: F.floor(F.col(c) / F.col("cell")).cast("long")
    every = extent.filter("x0 is not null").withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).repartition(width, "cx").withColumn("cy", F.explode(F.sequence(at("y0"), at("y1")))).select("cell", "cx", "cy", F.lit(None).cast(planar.PARTS).alias("parts"))
    met = every.unionByName(_in_cells(parcels, size).dropDuplicates(["cx", "cy", "h1", "h2"]).drop("h1", "h2")).join(F.broadcast(frame))  # the hull: one row
    pieces = met.select("cell", "cx", "cy", F.col("frame").cast(planar.PARTS).alias("frame"), "parts").repartition(width, "cx", "cy").sortWithinPartitions("cx", "cy")
    pieces = pieces.mapInArrow(_voids, f"cx long, cy long, k int, parts {planar.PARTS}, cell array<double>")
    own = planar.area(F.col("parts"))
    pieces = materialise(pieces.withColumn("area", own).filter("area > 1e-6").withColumn("id", F.unhex(F.md5(F.concat_ws(",", "cx", "cy", "k")))))
    # Where pieces lie on an edge of their cell: stretches of that edge, named by the cell behind it.
    x0, y0, w = (F.get("cell", F.lit(k)) for k in range(3))
    v = lambda p, k: F.get(p, F.lit(k))
    sides = F.flatten(F.transform(F.flatten("parts"), geo.edges_of))
    on = lambda k, value: F.filter(sides, lambda s: (F.abs(v(s["a"], k) - value) < 1e-7) & (F.abs(v(s["b"], k) - value) < 1e-7))
    stretch = lambda k, value, kind, c, d: F.transform(on(k, value), lambda s: F.struct(F.lit(kind).alias("kind"), c.alias("c"), d.alias("d"), F.least(v(s["a"], 1 - k), v(s["b"], 1 - k)).alias("lo"), F.greatest(v(s["a"], 1 - k), v(s["b"], 1 - k)).alias("hi")))
    cx, cy = F.col("cx"), F.col("cy")
    low = pieces.select("id", F.explode(F.concat(stretch(0, x0, "x", cx, cy), stretch(1, y0, "y", cx, cy))).alias("s")).select("id", "s.*")
    high = pieces.select(F.col("id").alias("b"), F.explode(F.concat(stretch(0, x0 + w, "x", cx + 1, cy), stretch(1, y0 + w, "y", cx, cy + 1))).alias("s")).select("b", "s.kind", "s.c", "s.d", F.col("s.lo").alias("lo2"), F.col("s.hi").alias("hi2"))
    links = low.join(high, ["kind", "c", "d"]).filter(F.least("hi", "hi2") - F.greatest("lo", "lo2") > 1e-6).select(F.col("id").alias("a"), "b")
    of = connected(links.unionByName(pieces.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    mx, my = planar.centre(F.col("parts"))
    return pieces.join(of, "id").select(F.hex("root").alias("void"), "parts", "area", mx.alias("x"), my.alias("y"))


@tidy
def voids(parcels: DataFrame, cell: float = 120.0) -> DataFrame:
    """One row for each void of the layer: void, area, x, y (its centre, that of its pieces weighed by their areas)."""
    mean = lambda c: (F.sum(F.col(c) * F.col("area")) / F.sum("area")).alias(c)
    return void_pieces(parcels, cell).groupBy("void").agg(mean("x"), mean("y"), F.sum("area").alias("area"))


def hull(parcels: DataFrame) -> DataFrame:
    """One row: x, y, the vertices of the layer's convex hull, and area_hull. Tasks reduce their vertices to hulls, and the hull of these few is the layer's."""
    parts = finite(with_parts(parcels)).select(F.col("parts").cast(planar.PARTS).alias("parts")).mapInArrow(_hulls, "x array<double>, y array<double>")
    ring = F.transform(F.arrays_zip("x", "y"), lambda v: F.array(v["x"], v["y"]))
    again = parts.filter(F.size("x") > 0).select(F.array(F.array(ring)).alias("parts")).coalesce(1).mapInArrow(_hulls, "x array<double>, y array<double>")
    closed = F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
    return again.select("x", "y", F.when(F.size("x") > 2, geo.ring_area(closed)).otherwise(0.0).alias("area_hull"))


def gap(parcels: DataFrame, cell: float = 120.0) -> DataFrame:
    """One row: area_hull, area_union, gap (what the hull has and no parcel covers) and its severity: high over 100 square metres, medium over 1, else null."""
    both = hull(parcels).select("area_hull").join(F.broadcast(union_area(parcels, cell)))  # one row each
    size = F.col("area_hull") - F.col("area_union")
    return both.withColumn("gap", size).withColumn("severity", F.when(size > 100, "high").when(size > 1, "medium"))


def gap_neighbours(parcels: DataFrame, gaps: DataFrame, within: float = 200.0, first: int | None = None) -> DataFrame:
    """For each gap (void, x, y: its own centre) the features whose mean vertex lies nearer than ``within`` metres: void, feature_idx, nicad, distance. first: only that many features of the layer, in their order, as a report has it."""
    rows = trimmed(with_parts(parcels))
    rows = rows.orderBy("feature_idx").limit(first) if first else rows
    x, y = geo.open_mean(outline(rows))
    means = rows.select("feature_idx", _named(F.col("nicad"), F.col("feature_idx")).alias("nicad"), x.alias("mx"), y.alias("my")).select("*", F.col("mx").alias("x0"), F.col("my").alias("y0"), F.col("mx").alias("x1"), F.col("my").alias("y1"))
    around = gaps.select("void", "x", "y", *[(F.col(c[0]) + d).alias(c) for c, d in zip(BOX, (-within, -within, within, within), strict=True)])
    pairs = box_join(around, means, within)
    distance = F.sqrt(F.pow(F.col("r_mx") - F.col("l_x"), 2) + F.pow(F.col("r_my") - F.col("l_y"), 2))
    return pairs.select(F.col("l_void").alias("void"), F.col("r_feature_idx").alias("feature_idx"), F.col("r_nicad").alias("nicad"), distance.alias("distance")).filter(F.col("distance") < within)


def gap_errors(parcels: DataFrame) -> DataFrame:
    rows = gap(parcels).filter("severity is not null").withColumn("feature_idx", F.lit(None).cast("long"))
    return _error(rows, "gap", F.col("severity"), F.lit("gap"), None, F.col("gap"), 0.9)


def row_errors(parcels: DataFrame) -> DataFrame:
    """The errors that a row shows by itself, from one scan: identifiers that are missing, slivers, invalid geometries."""
    rows = slivers(trimmed(parcels))
    name = _named(F.col("nicad"), F.col("feature_idx"))
    none = F.lit(None)
    fault = lambda kind, severity, nicad1, area, confidence: F.struct(F.lit(kind).alias("error_type"), F.lit(severity).alias("severity"), "feature_idx", nicad1.cast("string").alias("nicad1"), none.cast("string").alias("nicad2"), area.cast("double").alias("area"), F.lit(confidence).alias("confidence"))
    found = F.array(
        F.when(F.col("missing") | (F.length("nicad") < 8), fault("missing_nicad", "critical", none, none, 1.0)),
        F.when(F.col("is_sliver") & is_valid(rows), fault("sliver", "medium", name, F.col("area"), 0.9)),
        F.when(~is_valid(rows), fault("invalid_geom", "high", name, none, 1.0)),
    )
    return rows.select(F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("e.*")


def errors(parcels: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """The table of errors of a layer: by row, duplicates, overlaps, the gap, and with a boundary the parcels that leave it."""
    out = row_errors(parcels)
    for more in (duplicate_errors(parcels), overlap_errors(parcels), gap_errors(parcels), *([boundary_errors(parcels, boundary)] if boundary is not None else [])):
        out = out.unionByName(more)
    return out


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type", "severity").agg(F.count("*").alias("n"))


def score(critical: Column, high: Column, medium: Column, features: Column) -> Column:
    """Of 100, less ten times the weighted errors per feature; between 0 and 100, one decimal."""
    penalty = (critical * 10 + high * 5 + medium * 2) / F.greatest(features, F.lit(1)) * 10
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - penalty)), 1)


def conformity(parcels: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """One row: features, errors by severity and the score."""
    counts = errors(parcels, boundary).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    total = parcels.agg(F.count("*").alias("features"))
    both = total.join(F.broadcast(counts))  # one row each
    return both.withColumn("score", score(F.col("critical"), F.col("high"), F.col("medium"), F.col("features")))
