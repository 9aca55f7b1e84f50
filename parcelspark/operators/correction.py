"""Guided corrections of a layer: each takes features (feature_idx, nicad, and a box x0, y0, x1, y1 or a geometry parts) and returns what changes.

Corrections of many errors at once are joins; an action is allowed for its kind of error only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import geometry as geo
from parcelspark.functions import planar
from parcelspark.operators.spatial import BOX, box_join, outline, overlap_area, own_area

#: Actions by kind of error (fixed values).
ACTIONS = {
    "OVERLAP": ["clip_first", "clip_second", "ignore"],
    "SLIVER": ["merge_neighbor", "delete", "ignore"],
    "GAP": ["assign_to_neighbor", "ignore"],
    "BOUNDARY_CROSS": ["truncate", "ignore"],
    "INVALID_GEOM": ["delete", "ignore"],
    "DUPLICATE": ["delete", "ignore"],
    "MISSING_NICAD": ["assign_nicad", "ignore"],
}


def allowed(error_type, action):
    """Whether an action may be taken for a kind of error, as a column."""
    out = F.lit(False)
    for kind, actions in ACTIONS.items():
        out = out | ((F.upper(error_type) == kind) & action.isin(actions))
    return out


def with_parts(parcels: DataFrame) -> DataFrame:
    return parcels if "parts" in parcels.columns else parcels.withColumn("parts", F.array(F.array(outline(parcels))))


def clip(pairs: DataFrame, first: bool = True) -> DataFrame:
    """pairs (i, j, a, b: geometries): what stays of one of each pair when the other is taken away: left_area, parts and deleted, true where the other covers all of it."""
    mine, other = ("a", "b") if first else ("b", "a")
    own = planar.area(F.col(mine))
    left = own - planar.shared_area(F.col("a"), F.col("b"))
    # What a rounding leaves of a covered geometry is nothing.
    left = F.when(left > 1e-9 * own, left).otherwise(0.0)
    return pairs.withColumn("left_area", left).withColumn("parts", planar.overlay_parts(F.col(mine), F.col(other), "difference")).withColumn("deleted", F.col("left_area") <= 0)


def truncate(features: DataFrame, boundary: DataFrame) -> DataFrame:
    """The parts of features inside a boundary: the geometry b of its first row by k; of the others none is read."""
    first = boundary.orderBy("k").limit(1).select("b")
    both = with_parts(features).join(F.broadcast(first))
    return both.withColumn("left_area", planar.shared_area(F.col("parts"), F.col("b"))).withColumn("parts", planar.overlay_parts(F.col("parts"), F.col("b"), "intersection"))


def best_neighbours(features: DataFrame, size: float = 60.0, tolerance: float = 5.0) -> DataFrame:
    """For each sliver the neighbour to merge it with: the one along which the longest stretch of its outlines runs, within the tolerance, else the largest that it touches; slivers are no neighbours. All rings of all parts count. features: with is_sliver and area. sliver_idx, neighbour_idx, shared."""
    slim = with_parts(features).select("feature_idx", *BOX, "parts", "area", "is_sliver")
    pairs = box_join(slim.filter("is_sliver"), slim.filter("not is_sliver"), size, ids=("feature_idx", "feature_idx"))
    pairs = pairs.withColumn("c", planar.contact(F.col("l_parts"), F.col("r_parts"), tolerance)).filter("c.shared > 0 or c.touches")
    order = F.struct(-F.col("c.shared"), -F.col("r_area"), F.col("r_feature_idx"))
    return pairs.groupBy(F.col("l_feature_idx").alias("sliver_idx")).agg(F.min_by(F.struct(F.col("r_feature_idx").alias("neighbour_idx"), F.col("c.shared").alias("shared")), order).alias("n")).select("sliver_idx", "n.*")


def joined(targets: DataFrame, pieces: DataFrame) -> DataFrame:
    """targets (feature_idx, parts) united with the geometries of pieces (target_idx, parts), which may overlap each other: feature_idx, parts, area, taken (how many pieces). Only targets that get a piece come back."""
    got = pieces.groupBy(F.col("target_idx").alias("feature_idx")).agg(F.collect_list("parts").alias("more"), F.count("*").alias("taken"))
    out = targets.select("feature_idx", "parts").join(got, "feature_idx").select("feature_idx", planar.united_parts(F.concat(F.array("parts"), "more")).alias("parts"), "taken")
    return out.select("feature_idx", "parts", planar.area(F.col("parts")).alias("area"), "taken")


def merge_slivers(features: DataFrame, size: float = 60.0) -> DataFrame:
    """The layer after every sliver with a neighbour has been merged into it: slivers that were merged are gone, their neighbours have their geometry. feature_idx, parts, area, merged (how many slivers it took)."""
    f = with_parts(features)
    best = best_neighbours(f, size)
    shapes = f.select("feature_idx", "parts")
    pieces = shapes.withColumnRenamed("feature_idx", "sliver_idx").join(best, "sliver_idx").select(F.col("neighbour_idx").alias("target_idx"), "parts")
    grown = joined(shapes, pieces).withColumnRenamed("taken", "merged")
    touched = best.select(F.explode(F.array("sliver_idx", "neighbour_idx")).alias("feature_idx")).distinct()
    rest = f.withColumn("own", own_area(f)).select("feature_idx", "parts", F.col("own").alias("area")).join(touched, "feature_idx", "left_anti")
    return rest.withColumn("merged", F.lit(0).cast("long")).unionByName(grown)


def delete(features: DataFrame, errors: DataFrame) -> DataFrame:
    """features without those that an error (feature_idx, error_type, action) may delete and does."""
    gone = errors.filter(allowed(F.col("error_type"), F.col("action")) & (F.col("action") == "delete")).select("feature_idx").distinct()
    return features.join(gone, "feature_idx", "left_anti")


def assign_gaps(features: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps (gap_idx, parts, target_idx) become part of their targets: feature_idx, parts, area of the features that grow."""
    return joined(with_parts(features), gaps).drop("taken")


def committed(errors: DataFrame, requests: DataFrame) -> DataFrame:
    """errors (error_id, error_type, corrected) after requests (error_id, action): those with an allowed action, or ignored, are marked; refused says why a request was not carried out."""
    asked = requests.groupBy("error_id").agg(F.min("action").alias("action"))
    rows = errors.join(asked, "error_id", "left")
    may = allowed(F.col("error_type"), F.col("action"))
    refused = F.when(F.col("action").isNotNull() & F.col("corrected"), "already corrected").when(F.col("action").isNotNull() & ~may, "action not allowed")
    return rows.select("error_id", "error_type", "action", (F.col("corrected") | F.coalesce(may, F.lit(False))).alias("corrected"), refused.alias("refused"))


def _sharing(features: DataFrame, size: float) -> DataFrame:
    """l_feature_idx, r_feature_idx, area of features that share an area, in both directions. A pair meets and is measured once, and only where the boxes' interiors meet; only what that needs goes to the cells."""
    slim = features.select("feature_idx", *BOX, *[c for c in ("parts",) if c in features.columns])
    pairs = box_join(slim, slim, size, touching=False, self_join_on="feature_idx", ids=("feature_idx", "feature_idx"))
    pairs = pairs.select("l_feature_idx", "r_feature_idx", overlap_area(pairs).alias("area")).filter("area > 0")
    way = lambda a, b: F.struct(F.col(a).alias("l_feature_idx"), F.col(b).alias("r_feature_idx"))
    return pairs.select(F.explode(F.array(way("l_feature_idx", "r_feature_idx"), way("r_feature_idx", "l_feature_idx"))).alias("p"), "area").select("p.*", "area")


def overlap_partners(features: DataFrame, size: float = 60.0) -> DataFrame:
    """For each feature the one that it shares the most area with; the lower id of equals."""
    pairs = _sharing(features, size)
    best = F.min_by(F.struct(F.col("r_feature_idx").alias("partner_idx"), F.col("area").alias("shared_area")), F.struct(-F.col("area"), F.col("r_feature_idx")))
    return pairs.groupBy(F.col("l_feature_idx").alias("feature_idx")).agg(best.alias("b")).select("feature_idx", "b.*")


def top_partners(features: DataFrame, most: int, size: float = 60.0) -> DataFrame:
    """For each feature the ``most`` that it shares the most area with, in order: partner_idx, place. A feature's own neighbours meet, no more."""
    pairs = _sharing(features, size)
    place = F.row_number().over(Window.partitionBy("l_feature_idx").orderBy(F.desc("area"), "r_feature_idx"))
    return pairs.select(F.col("l_feature_idx").alias("feature_idx"), F.col("r_feature_idx").alias("partner_idx"), place.cast("bigint").alias("place")).filter(F.col("place") <= most)


def _corner_keys(x: Column, y: Column, step: float) -> Column:
    """The keys of a corner's cell and, where it lies within a hundredth of a cell of its edges, of the cells beyond them."""
    near = lambda v: F.array_distinct(F.array(F.floor((v - 0.01 * step) / step), F.floor((v + 0.01 * step) / step)))
    return F.flatten(F.transform(near(x), lambda i: F.transform(near(y), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def equal_rings(features: DataFrame, targets: DataFrame, sought: str, digits: int = 7, how: str = "inner") -> DataFrame:
    """features (ring) joined to targets whose ring, in the column ``sought``, equals theirs within 10**-digits, vertex by vertex. They meet by the cell of their first corner; a target near a cell's edge is sought in the cells beyond it too, so no rounding parts two that are equal."""
    step = 10.0 ** (3 - digits) * 100
    corner = lambda ring, k: F.get(F.get(F.col(ring), F.lit(0)), F.lit(k))
    t = targets.withColumn("__key", F.explode(_corner_keys(corner(sought, 0), corner(sought, 1), step)))
    close = (F.size("ring") == F.size(sought)) & F.forall(F.zip_with("ring", sought, lambda a, b: F.forall(F.zip_with(a, b, lambda u, v: F.abs(u - v) < 10.0**-digits), lambda x: x)), lambda x: x)
    own = F.struct(F.floor(corner("ring", 0) / step).alias("i"), F.floor(corner("ring", 1) / step).alias("j"))
    return features.withColumn("__k", own).join(t, (F.col("__k") == F.col("__key")) & close, how).drop("__k", "__key")


def delete_matching(features: DataFrame, targets: DataFrame, digits: int = 7) -> DataFrame:
    """features (ring) without those whose ring equals a target's within 10**-digits."""
    return equal_rings(features, targets.select(F.col("ring").alias("__ring")), "__ring", digits, "left_anti")


def assign_auto(features: DataFrame, prefix: str = "AUTO_") -> DataFrame:
    """Features without identifier get AUTO_ and six digits, after the largest such number there is, in the order of feature_idx."""
    used = features.agg(F.coalesce(F.max(F.regexp_extract("nicad", rf"^{prefix}(\d+)$", 1).try_cast("bigint")), F.lit(0)).alias("used"))
    lacking = features.filter("missing")
    # Ranges of ids are counted, then added up, so that no task numbers all rows.
    from_range = lacking.groupBy(F.floor(F.col("feature_idx") / 4096).alias("range")).agg(F.count("*").alias("n"))
    starts = from_range.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "start")
    placed = lacking.withColumn("range", F.floor(F.col("feature_idx") / 4096)).join(starts, "range")
    place = F.row_number().over(Window.partitionBy("range").orderBy("feature_idx"))
    number = (F.col("used") + F.col("start") + place).cast("string")
    name = F.concat(F.lit(prefix), F.when(F.length(number) >= 6, number).otherwise(F.lpad(number, 6, "0")))
    return placed.join(F.broadcast(used)).select("feature_idx", name.alias("nicad"))
