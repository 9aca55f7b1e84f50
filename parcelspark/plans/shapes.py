"""Queries over parcels and communes that are no rectangles: cut corners, holes, two parts, triangles.

The SQL twins have closed forms. A shape that is a box less a box within it shares with another what their boxes share, less what each one's cut takes of the other's box, and what both cuts take once more. Triangles only meet boxes and two-part shapes beside them, in a band at one end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions import geometry as geo
from parcelspark.functions import planar
from parcelspark.operators import correction, correspondence, quality
from parcelspark.operators.spatial import nearest_area, points_in, with_box
from parcelspark.plans.registry import query
from parcelspark.plans.spatial import SITES, _sites


def _box(a: str, pa: str, b: str, pb: str) -> str:
    side = lambda c: f"greatest(0.0, least({a}.{pa}{c}1, {b}.{pb}{c}1) - greatest({a}.{pa}{c}0, {b}.{pb}{c}0))"
    return f"{side('x')} * {side('y')}"


def _less(a: str, b: str) -> str:
    return f"{_box(a, '', b, '')} - {_box(a, 'h', b, '')} - {_box(a, '', b, 'h')} + {_box(a, 'h', b, 'h')}"


OWN = "CASE WHEN {0}.kind = 4 THEN ({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0) / 2 ELSE ({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0) - ({0}.hx1 - {0}.hx0) * ({0}.hy1 - {0}.hy0) END"
# A triangle on the left, of which a box takes the thin end; and one on the right, of which it takes the tall one. m: the band's width, s: the slope.
_THIN = "CASE WHEN sa * m <= hb THEN sa * m * m / 2 ELSE hb * m - hb * hb / (2 * sa) END"
_TALL = "CASE WHEN ha <= hb - sb * m THEN ha * m ELSE hb * m - sb * m * m / 2 END"
LAPS = f"""V AS (SELECT a.feature_idx AS i, b.feature_idx AS j, a.kind AS ka, b.kind AS kb, a.x1 - b.x0 AS m, a.y1 - a.y0 AS ha, b.y1 - b.y0 AS hb, (a.y1 - a.y0) / (a.x1 - a.x0) AS sa, (b.y1 - b.y0) / (b.x1 - b.x0) AS sb, {_less('a', 'b')} AS plain, least({OWN.format('a')}, {OWN.format('b')}) AS smaller
  FROM W a JOIN W b ON a.feature_idx < b.feature_idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
A AS (SELECT i, j, CASE WHEN ka = 4 THEN {_THIN} WHEN kb = 4 THEN {_TALL} ELSE plain END AS area, smaller FROM V),
T AS (SELECT i, j, area, area / smaller * 100 AS percent FROM A WHERE area >= 0.01)"""


@query("SELECT i, j, round(area, 6) AS area, round(percent, 6) AS percent, CASE WHEN percent > 50 THEN 'critical' WHEN percent > 20 THEN 'high' WHEN percent > 5 THEN 'medium' ELSE 'low' END AS severity FROM T", "W", LAPS)
def shape_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by the polygons' own intersection."""
    return quality.overlaps(fx.shaped(spark, sf_dir)).select("i", "j", F.round("area", 6).alias("area"), F.round("percent", 6).alias("percent"), "severity")


@query("SELECT count(*) AS n FROM A WHERE area > 0", "W", LAPS)
def shape_boolean_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose interiors meet where neither holds the other; no shape of the table holds another."""
    return quality.partial_overlaps(fx.shaped(spark, sf_dir)).agg(F.count("*").alias("n"))


_IN = "x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 AND NOT (kind < 4 AND x > hx0 AND x < hx1 AND y > hy0 AND y < hy1) AND NOT (kind = 4 AND (x - x0) * (y1 - y0) + (y - y0) * (x1 - x0) > (x1 - x0) * (y1 - y0))"


@query(f"SELECT L.label_idx, feature_idx FROM L LEFT JOIN (SELECT label_idx, min(feature_idx) AS feature_idx FROM L JOIN W ON {_IN} GROUP BY label_idx) h ON h.label_idx = L.label_idx", "L W")
def shape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first parcel whose polygons hold a label."""
    shapes = fx.shaped(spark, sf_dir).select("feature_idx", "x0", "y0", "x1", "y1", "parts")
    return points_in(fx.labels(spark, sf_dir), shapes, 60.0, "label_idx", "feature_idx").select("label_idx", F.col("b_feature_idx").alias("feature_idx"))


@query(f"SELECT s13, s26, round(share, 9) AS share FROM (SELECT a.syscol AS s13, b.syscol AS s26, ({_less('a', 'b')}) / ({OWN.format('a')}) AS share FROM W13 a JOIN W26 b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) WHERE share > 0", "W13 W26")
def shape_commune_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of old communes in new ones, both with cut corners and holes."""
    found = correspondence.overlay(fx.shaped_communes(spark, sf_dir, 2013), fx.shaped_communes(spark, sf_dir, 2026))
    return found.select("s13", "s26", F.round("share", 9).alias("share"))


@query(f"SELECT i, j, round({OWN.format('a')} - area, 6) AS left_area FROM A JOIN W a ON a.feature_idx = i WHERE area > 0", "W", LAPS)
def shape_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of the first of two overlapping parcels, measured on the geometry that is made."""
    pairs = quality.overlaps(fx.shaped(spark, sf_dir), least=1e-9).select("i", "j")
    shapes = fx.shaped(spark, sf_dir).select("feature_idx", "parts")
    pairs = pairs.join(shapes.select(F.col("feature_idx").alias("i"), F.col("parts").alias("a")), "i").join(shapes.select(F.col("feature_idx").alias("j"), F.col("parts").alias("b")), "j")
    return correction.clip(pairs).select("i", "j", F.round(planar.area(F.col("parts")), 6).alias("left_area"))


@query(f"SELECT (SELECT round(sum({OWN.format('W')}), 4) FROM W) - (SELECT round(sum(area), 4) FROM A) AS area_union", "W", LAPS)
def shape_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all shaped parcels cover together; no three of them overlap."""
    return quality.union_area(fx.shaped(spark, sf_dir)).select(F.round("area_union", 4).alias("area_union"))


@query(f"SELECT feature_idx, round({OWN.format('W')}, 6) AS area, CAST(CASE kind WHEN 3 THEN 2 ELSE 1 END AS INT) AS n_parts, x0 AS min_x, y1 AS max_y, CASE WHEN kind = 2 THEN (x1 - x0) * (y1 - y0) ELSE round({OWN.format('W')}, 6) END AS outer_area FROM W", "W")
def shape_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with and without holes, numbers of parts and bounds from the geometries alone."""
    p = with_box(fx.shaped(spark, sf_dir).drop("x0", "y0", "x1", "y1"))
    outer = F.aggregate(F.transform("parts", lambda g: geo.ring_area(F.get(g, F.lit(0)))), F.lit(0.0), lambda a, v: a + v)
    return p.select("feature_idx", F.round(planar.area(F.col("parts")), 6).alias("area"), F.size("parts").alias("n_parts"), F.col("x0").alias("min_x"), F.col("y1").alias("max_y"), F.round(outer, 6).alias("outer_area"))


@query("SELECT feature_idx, feature_idx % 6 NOT IN (2, 3) AS valid, feature_idx % 6 IN (0, 4) AS simple FROM P", "P")
def geometry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of geometry: a box, two parts of which one is no ring, none, an outer ring of three vertices, a closed box, an outline that crosses itself."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    at = lambda *corners: F.array(*[F.array(x, y) for x, y in corners])
    box = geo.rectangle(x0, y0, x1, y1)
    kinds = [F.array(F.array(box)), F.array(F.array(box), F.array(at((x0, y0), (x1, y1)))), F.lit(None).cast(planar.PARTS), F.array(F.array(at((x0, y0), (x1, y0), (x1, y1)))), F.array(F.array(at((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))), F.array(F.array(at((x0, y0), (x1, y1), (x1, y0), (x0, y1), (x0, y0))))]
    parts = kinds[0]
    for k, made in enumerate(kinds):
        parts = F.when(F.col("feature_idx") % 6 == k, made).otherwise(parts)
    p = fx.parcels(spark, sf_dir).withColumn("parts", parts)
    return p.select("feature_idx", quality.is_valid(p).alias("valid"), quality.is_simple(p).alias("simple"))


def _off(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"CASE WHEN {x1} > {x0} AND {y1} > {y0} THEN sqrt(pow(greatest({x0} - x, 0.0, x - ({x1})), 2) + pow(greatest({y0} - y, 0.0, y - ({y1})), 2)) ELSE 1e9 END"


# A box less a cut is what lies left, right, below and above the cut; a whole one's cut is empty at its lower left corner.
_OFF = f"least({_off('x0', 'y0', 'hx0', 'y1')}, {_off('hx1', 'y0', 'x1', 'y1')}, {_off('x0', 'y0', 'x1', 'hy0')}, {_off('x0', 'hy1', 'x1', 'y1')})"


@query(f"SELECT c_custkey, syscol, round(d, 6) AS distance, d > 0 AS approx FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, syscol) AS place FROM (SELECT c_custkey, syscol, {_OFF} AS d FROM Q JOIN W26 ON x >= x0 - 50 AND x <= x1 + 50 AND y >= y0 - 50 AND y <= y1 + 50) WHERE d <= 50) WHERE place = 1", "W26", f"Q AS ({SITES})")
def shape_point_to_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commune that holds a point, else the nearest within 50 m: points in holes and cut corners lie outside."""
    areas = fx.shaped_communes(spark, sf_dir, 2026).select("syscol", "x0", "y0", "x1", "y1", "parts")
    return nearest_area(_sites(spark, sf_dir), areas, 1000.0, 50.0, "c_custkey", "syscol").withColumn("distance", F.round("distance", 6))


@query(f"SELECT feature_idx, min(syscol) AS syscol FROM (SELECT feature_idx, (x0 + x1) / 2 + 0.3 AS x, (y0 + y1) / 2 + 0.1 AS y FROM P) p JOIN (SELECT syscol, kind, x0, y0, x1, y1, hx0, hy0, hx1, hy1 FROM W13) w ON {_IN} GROUP BY feature_idx", "P W13")
def shape_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels in communes with cut corners and holes, by a point of theirs."""
    points = fx.parcels(spark, sf_dir).select("feature_idx", ((F.col("x0") + F.col("x1")) / 2 + 0.3).alias("x"), ((F.col("y0") + F.col("y1")) / 2 + 0.1).alias("y"))
    areas = fx.shaped_communes(spark, sf_dir, 2013).select("syscol", "x0", "y0", "x1", "y1", "parts")
    return points_in(points, areas, 900.0, "feature_idx", "syscol").filter("b_syscol is not null").select("feature_idx", F.col("b_syscol").alias("syscol"))


@query(f"SELECT feature_idx, count(*) AS pools, sum(area) AS area FROM (SELECT label_idx, CAST(label_idx % 40 AS DOUBLE) / 2 AS area, min(feature_idx) AS feature_idx FROM L JOIN W ON {_IN} GROUP BY label_idx) GROUP BY feature_idx", "L W")
def shape_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools by the parcel whose polygons hold them."""
    pools = fx.labels(spark, sf_dir).withColumn("area", (F.col("label_idx") % 40).cast("double") / 2)
    hit = points_in(pools, fx.shaped(spark, sf_dir).select("feature_idx", "x0", "y0", "x1", "y1", "parts"), 60.0, "label_idx", "feature_idx").filter("b_feature_idx is not null")
    return hit.groupBy(F.col("b_feature_idx").alias("feature_idx")).agg(F.count("*").alias("pools"), F.sum("area").alias("area"))


@query("SELECT feature_idx, partner_idx, round(area, 6) AS shared_area FROM (SELECT *, row_number() OVER (PARTITION BY feature_idx ORDER BY round(area, 6) DESC, partner_idx) AS place FROM (SELECT i AS feature_idx, j AS partner_idx, area FROM A WHERE area > 0 UNION ALL SELECT j, i, area FROM A WHERE area > 0)) WHERE place = 1", "W", LAPS)
def shape_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour that each parcel shares the most area with."""
    return correction.overlap_partners(fx.shaped(spark, sf_dir)).select("feature_idx", "partner_idx", F.round("shared_area", 6).alias("shared_area"))
