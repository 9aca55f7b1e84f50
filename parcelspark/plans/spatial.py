"""Queries over geometry and spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions import geometry as geo
from parcelspark.functions import planar
from parcelspark.functions.text import half_up
from parcelspark.operators import batch, cad, correction, network, quality
from parcelspark.operators.spatial import box_join, nearest_area, nearest_in_degrees, points_in
from parcelspark.plans.registry import query, table

BOX = ("x0", "y0", "x1", "y1")
#: Plausible extent in degrees (fixed values).
DEGREES = (-17.6, 12.2, -11.3, 16.8)


def _ring():
    return geo.rectangle(*[F.col(c) for c in BOX])


@query("SELECT feature_idx, (x1 - x0) * (y1 - y0) AS area, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) ELSE 0.0 END AS aspect, ((x1 - x0) * (y1 - y0) < 1 OR greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) > 50) AS is_sliver FROM P", "P")
def sliver_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.slivers(fx.parcels(spark, sf_dir)).select("feature_idx", "area", "aspect", "is_sliver")


@query("SELECT feature_idx, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y, (3 * x0 + 2 * x1) / 5 AS mean_x, (3 * y0 + 2 * y1) / 5 AS mean_y FROM P", "P")
def bbox_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.mean_vertex(F.col("ring"))
    return fx.parcels(spark, sf_dir).withColumn("ring", _ring()).select("feature_idx", *[c.alias(k) for k, c in geo.bbox(F.col("ring")).items()], x.alias("mean_x"), y.alias("mean_y"))


@query("SELECT feature_idx, greatest(0.0, (x1 - x0) * (y1 - y0) - 4 * 2) AS area FROM P", "P")
def polygon_area_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = geo.rectangle(F.col("x0") + 1, F.col("y0"), F.col("x0") + 5, F.col("y0") + 2)
    return fx.parcels(spark, sf_dir).select("feature_idx", geo.polygon_area(F.array(_ring(), hole)).alias("area"))


@query("SELECT feature_idx, (feature_idx % 7) * 0.02 <= 0.05 AS closes FROM P", "P")
def ring_close_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"), F.array(F.col("x0") + (F.col("feature_idx") % 7) * 0.02, F.col("y0")))
    return fx.parcels(spark, sf_dir).select("feature_idx", geo.closed_ring(ends).isNotNull().alias("closes"))


@query("SELECT hash, count(*) AS n FROM (SELECT sha256('[[' || a || ',' || b || '],[' || c || ',' || b || '],[' || c || ',' || d || '],[' || a || ',' || d || '],[' || a || ',' || b || ']]') AS hash FROM (SELECT CAST(CAST((x0 - 250000) * 1000 AS BIGINT) AS VARCHAR) AS a, CAST(0 AS VARCHAR) AS b, CAST(CAST((x1 - 250000) * 1000 AS BIGINT) AS VARCHAR) AS c, CAST(CAST((y1 - y0) * 1000 AS BIGINT) AS VARCHAR) AS d FROM P)) GROUP BY hash HAVING count(*) > 1", "P")
def geom_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that occur more than once when rows are laid on each other."""
    ring = geo.rectangle(F.col("x0") - 250000, F.lit(0.0), F.col("x1") - 250000, F.col("y1") - F.col("y0"))
    return fx.parcels(spark, sf_dir).groupBy(geo.fingerprint(ring).alias("hash")).agg(F.count("*").alias("n")).filter("n > 1")


def _wgs84_sql() -> str:
    """Longitude and latitude of (x0, y0) in SQL, from the series' coefficients."""
    radius, beta, delta = geo.series()
    num = lambda v: repr(v) if "e" in repr(v) else f"{v!r}e0"  # noqa: E731  doubles, not decimals
    xi, eta = f"(y0 / {num(geo.SCALE * radius)})", f"((x0 - {num(geo.FALSE_EAST)}) / {num(geo.SCALE * radius)})"
    cosh, sinh = (lambda v: f"((exp({v}) + exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) - exp(-({v}))) / 2)")
    xp = xi + "".join(f" - ({num(b)}) * sin({2 * k} * {xi}) * {cosh(f'{2 * k} * {eta}')}" for k, b in enumerate(beta, 1))
    ep = eta + "".join(f" - ({num(b)}) * cos({2 * k} * {xi}) * {sinh(f'{2 * k} * {eta}')}" for k, b in enumerate(beta, 1))
    lat = "chi" + "".join(f" + ({num(d)}) * sin({2 * k} * chi)" for k, d in enumerate(delta, 1))
    return f"T AS (SELECT feature_idx, {xp} AS xp, {ep} AS ep FROM P), U AS (SELECT *, asin(sin(xp) / {cosh('ep')}) AS chi FROM T), G AS (SELECT feature_idx, degrees(radians({num(geo.CENTRAL)}) + atan2({sinh('ep')}, cos(xp))) AS lon, degrees({lat}) AS lat FROM U)"


@query("SELECT feature_idx, floor(lon * 1e7 + 0.5) / 1e7 AS lon, floor(lat * 1e7 + 0.5) / 1e7 AS lat FROM G", "P", _wgs84_sql())
def utm_to_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.to_wgs84(F.col("x0"), F.col("y0"))
    return fx.parcels(spark, sf_dir).select("feature_idx", half_up(lon, 7).alias("lon"), half_up(lat, 7).alias("lat"))


POINTS = "SELECT c_custkey, -18.0 + (c_custkey % 700) * 0.01 AS lon, 12.0 + (c_custkey % 490) * 0.01 AS lat FROM customer"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(-18.0 + (c_custkey % 700) * 0.01 AS DOUBLE) AS lon", "CAST(12.0 + (c_custkey % 490) * 0.01 AS DOUBLE) AS lat")


Q = f"Q AS (SELECT c_custkey, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM ({POINTS}))"


@query("SELECT c_custkey, floor(2 * 6371008.8 * atan2(sqrt(a), sqrt(1 - a)) * 1000 + 0.5) / 1000 AS metres FROM (SELECT c_custkey, pow(sin(radians(14.7 - lat) / 2), 2) + pow(sin(radians(-17.45 - lon) / 2), 2) * cos(radians(lat)) * cos(radians(14.7)) AS a FROM Q)", "", Q)
def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("c_custkey", half_up(geo.haversine(F.col("lon"), F.col("lat"), F.lit(-17.45), F.lit(14.7)), 3).alias("metres"))


@query("SELECT c_custkey, floor(pow(6371008.8, 2) * radians(0.01) * abs(sin(radians(lat + 0.01)) - sin(radians(lat))) + 0.5) AS area FROM Q", "", Q)
def spherical_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.lit(geo.EARTH_RADIUS**2) * F.radians(F.lit(0.01)) * F.abs(F.sin(F.radians(F.col("lat") + 0.01)) - F.sin(F.radians(F.col("lat"))))
    return _points(spark, sf_dir).select("c_custkey", F.floor(area + 0.5).cast("double").alias("area"))


@query("SELECT c_custkey, lon >= -17.6 AND lon <= -11.3 AND lat >= 12.2 AND lat <= 16.8 AS kept FROM Q", "", Q)
def kept_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of the filter by extent, told apart."""
    inside = F.col("lon").between(DEGREES[0], DEGREES[2]) & F.col("lat").between(DEGREES[1], DEGREES[3])
    return _points(spark, sf_dir).select("c_custkey", inside.alias("kept"))


@query("SELECT feature_idx FROM P WHERE x0 >= 250100 AND x1 <= 254000 AND y0 >= 1600100 AND y1 <= 1602000", "P")
def utm_extent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.forall("ring", lambda p: F.get(p, F.lit(0)).between(250100, 254000) & F.get(p, F.lit(1)).between(1600100, 1602000))
    return fx.parcels(spark, sf_dir).withColumn("ring", _ring()).filter(inside).select("feature_idx")


OVERLAP = """O AS (SELECT a.feature_idx AS i, b.feature_idx AS j, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area,
 least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS smaller FROM P a JOIN P b ON a.feature_idx < b.feature_idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
S AS (SELECT i, j, area, area / smaller * 100 AS percent, CASE WHEN area / smaller * 100 > 50 THEN 'critical' WHEN area / smaller * 100 > 20 THEN 'high' WHEN area / smaller * 100 > 5 THEN 'medium' ELSE 'low' END AS severity FROM O WHERE area >= 0.01)"""


@query("SELECT i, j, area, percent, severity FROM S", "P", OVERLAP)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overlaps(fx.parcels(spark, sf_dir)).select("i", "j", "area", "percent", "severity")


@query("SELECT severity, count(*) AS n, sum(area) AS area FROM S GROUP BY severity", "P", OVERLAP)
def overlap_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overlaps(fx.parcels(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("SELECT i, j, area, severity FROM S WHERE i < 500 AND j < 500 ORDER BY i, j LIMIT 200", "P", OVERLAP)
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's form: its caps are the feature."""
    return quality.overlaps(fx.parcels(spark, sf_dir), first=500, most=200).select("i", "j", "area", "severity")


@query("SELECT count(*) AS n FROM O JOIN P a ON a.feature_idx = i JOIN P b ON b.feature_idx = j WHERE area > 0 AND NOT (a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1) AND NOT (b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1)", "P", OVERLAP)
def boolean_overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.partial_overlaps(fx.parcels(spark, sf_dir)).agg(F.count("*").alias("n"))


GAP = """H AS (SELECT (max(x1) - min(x0)) * (max(y1) - min(y0)) AS area_hull, sum((x1 - x0) * (y1 - y0)) - (SELECT sum(area) FROM O) AS area_union FROM P),
G AS (SELECT area_hull, area_union, area_hull - area_union AS gap, CASE WHEN area_hull - area_union > 100 THEN 'high' WHEN area_hull - area_union > 1 THEN 'medium' END AS severity FROM H)"""


ERRORS = """R AS (SELECT 'missing_nicad' AS error_type, 'critical' AS severity FROM P WHERE nicad_raw IN ('N/A', '') OR length(nicad_raw) < 8
 UNION ALL SELECT 'duplicate', 'critical' FROM (SELECT count(*) OVER (PARTITION BY nicad_raw) AS n FROM P WHERE length(nicad_raw) >= 8) WHERE n > 1
 UNION ALL SELECT 'sliver', 'medium' FROM P WHERE (x1 - x0) * (y1 - y0) < 1 OR greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) > 50
 UNION ALL SELECT 'overlap', severity FROM S
 UNION ALL SELECT 'gap', severity FROM G WHERE severity IS NOT NULL
 UNION ALL SELECT 'boundary_cross', 'high' FROM P WHERE x0 < 250000 OR y0 < 1600000 OR x1 > 250900 OR y1 > 1600900)"""


@query("SELECT error_type, severity, count(*) AS n FROM R GROUP BY error_type, severity", "P", f"{OVERLAP}, {GAP}, {ERRORS}")
def error_counts_by_type_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.error_counts(quality.errors(fx.parcels(spark, sf_dir), fx.communes_2013(spark, sf_dir)))


@query("SELECT features, critical, high, medium, low, floor(greatest(0.0, least(100.0, 100.0 - CAST(critical * 10 + high * 5 + medium * 2 AS DOUBLE) / greatest(features, 1) * 10)) * 10 + 0.5) / 10 AS score FROM (SELECT (SELECT count(*) FROM P) AS features, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM R)", "P", f"{OVERLAP}, {GAP}, {ERRORS}")
def conformity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.conformity(fx.parcels(spark, sf_dir), fx.communes_2013(spark, sf_dir))


@query("SELECT label_idx, min(feature_idx) AS feature_idx FROM L LEFT JOIN P ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY label_idx", "P L")
def pip_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.parcels(spark, sf_dir).select("feature_idx", *BOX)
    return points_in(fx.labels(spark, sf_dir), boxes, 60.0, "label_idx", "feature_idx").select("label_idx", F.col("b_feature_idx").alias("feature_idx"))


SECTIONS = "SELECT r_regionkey * 7 + i AS section_idx, CAST(250000 + i * 643 AS DOUBLE) AS x0, CAST(1600000 + r_regionkey * 900 AS DOUBLE) AS y0, CAST(250000 + i * 643 + 643 AS DOUBLE) AS x1, CAST(1600000 + r_regionkey * 900 + 900 AS DOUBLE) AS y1 FROM region CROSS JOIN (SELECT unnest(range(0, 7)) AS i)"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    x, y = (250000 + F.col("i") * 643).cast("double"), (1600000 + F.col("r") * 900).cast("double")
    return r.select((F.col("r") * 7 + F.col("i")).alias("section_idx"), x.alias("x0"), y.alias("y0"), (x + 643).alias("x1"), (y + 900).alias("y1"))


@query("SELECT feature_idx, min(section_idx) AS section_idx FROM (SELECT feature_idx, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM P) p LEFT JOIN N ON x >= N.x0 AND x <= N.x1 AND y >= N.y0 AND y <= N.y1 GROUP BY feature_idx", "P", f"N AS ({SECTIONS})")
def section_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.parcels(spark, sf_dir).select("feature_idx", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return points_in(points, _sections(spark, sf_dir), 900.0, "feature_idx", "section_idx").select("feature_idx", F.col("b_section_idx").alias("section_idx"))


@query("SELECT feature_idx, count(*) AS pools, sum(area) AS area FROM (SELECT label_idx, CAST(label_idx % 40 AS DOUBLE) / 2 AS area, min(feature_idx) AS feature_idx FROM L JOIN P ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY label_idx) GROUP BY feature_idx", "P L")
def pool_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = fx.labels(spark, sf_dir).withColumn("area", (F.col("label_idx") % 40).cast("double") / 2)
    hit = points_in(pools, fx.parcels(spark, sf_dir).select("feature_idx", *BOX), 60.0, "label_idx", "feature_idx").filter("b_feature_idx is not null")
    return hit.groupBy(F.col("b_feature_idx").alias("feature_idx")).agg(F.count("*").alias("pools"), F.sum("area").alias("area"))


SITES = "SELECT c_custkey, CAST(249900 + (c_custkey * 31) % 4800 AS DOUBLE) AS x, CAST(1599900 + (c_custkey * 17) % 4800 AS DOUBLE) AS y FROM customer"
NEAR = "sqrt(pow(greatest(x0 - x, 0.0, x - x1), 2) + pow(greatest(y0 - y, 0.0, y - y1), 2))"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SITES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


@query(f"SELECT c_custkey, arg_min(syscol, (d, syscol)) AS syscol, min(d) > 0 AS approx FROM (SELECT c_custkey, syscol, CASE WHEN syscol IS NOT NULL THEN {NEAR} END AS d FROM T LEFT JOIN C26 ON {NEAR} <= 50) GROUP BY c_custkey", "C26", f"T AS ({SITES})")
def point_to_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commune that holds a point, else the nearest within 50 m; ties by code."""
    sites = _sites(spark, sf_dir)
    best = nearest_area(sites, fx.communes_2026(spark, sf_dir).select("syscol", *BOX), 1000.0, 50.0, "c_custkey", "syscol")
    return sites.select("c_custkey").join(best.drop("distance"), "c_custkey", "left")


@query(f"SELECT c_custkey, arg_min(syscol, (d, syscol)) AS syscol, min(d) > 0 AS approx FROM (SELECT c_custkey, syscol, CASE WHEN syscol IS NOT NULL THEN {NEAR} END AS d FROM T LEFT JOIN C26 ON {NEAR} <= 50.015) GROUP BY c_custkey", "C26", f"T AS ({SITES})")
def point_to_commune_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from points and communes in degrees: 50 m on the ellipsoid, where the projection has 50.018 m."""
    sites = _sites(spark, sf_dir)
    lon, lat = geo.to_wgs84(F.col("x"), F.col("y"))
    corner = lambda x, y: F.array(*geo.to_wgs84(F.col(x), F.col(y)))
    areas = fx.communes_2026(spark, sf_dir).select("syscol", F.array(F.array(F.array(*[corner(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]))).alias("parts"))
    best = nearest_in_degrees(sites.select("c_custkey", lon.alias("lon"), lat.alias("lat")), areas, 1000.0, 50.0, "c_custkey", "syscol")
    return sites.select("c_custkey").join(best.drop("distance"), "c_custkey", "left")


@query("SELECT feature_idx, x0, y0 FROM P", "P")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners to degrees and back."""
    x, y = geo.to_utm(*geo.to_wgs84(F.col("x0"), F.col("y0")))
    return fx.parcels(spark, sf_dir).select("feature_idx", F.round(x, 6).alias("x0"), F.round(y, 6).alias("y0"))


@query("SELECT feature_idx, feature_idx % 4 IN (1, 2) AS faulty, CASE feature_idx % 4 WHEN 1 THEN (x1 - x0) * (y1 - y0) / 2 WHEN 3 THEN (x1 - x0) * (y1 - y0) * 0.75 ELSE (x1 - x0) * (y1 - y0) END AS area, CASE WHEN feature_idx % 4 IN (1, 2) THEN 2 ELSE 1 END AS n_parts FROM P", "P")
def geometry_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, bow-ties, boxes with a hole that leaves its shell, and boxes with a hole inside, made valid."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    at = lambda u, v: F.array(x0 + (x1 - x0) * u, y0 + (y1 - y0) * v)
    ring = lambda *corners: F.array(*[at(u, v) for u, v in corners])
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d), (a, b))
    k = F.col("feature_idx") % 4
    parts = F.when(k == 0, F.array(F.array(box(0, 0, 1, 1)))).when(k == 1, F.array(F.array(ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))))).when(k == 2, F.array(F.array(box(0, 0, 1, 1), box(0.75, 0.25, 1.25, 0.75)))).otherwise(F.array(F.array(box(0, 0, 1, 1), box(0.25, 0.25, 0.75, 0.75))))
    p = quality.repaired(fx.parcels(spark, sf_dir).withColumn("parts", parts))
    return p.select("feature_idx", "faulty", F.round(planar.area(F.col("parts")), 6).alias("area"), F.size("parts").alias("n_parts"))


@query("SELECT feature_idx, d FROM (SELECT feature_idx, sqrt(pow(x0 - 251003, 2) + pow(y0 - 1600207, 2)) AS d FROM P WHERE x0 BETWEEN 250503 AND 251503 AND y0 BETWEEN 1599707 AND 1600707) ORDER BY d, feature_idx LIMIT 1", "P")
def knn_parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest parcel within a box around a point; one row is the feature."""
    near = fx.parcels(spark, sf_dir).filter(F.col("x0").between(250503, 251503) & F.col("y0").between(1599707, 1600707))
    d = F.sqrt(F.pow(F.col("x0") - 251003, 2) + F.pow(F.col("y0") - 1600207, 2))
    return near.select("feature_idx", d.alias("d")).orderBy("d", "feature_idx").limit(1)


@query("SELECT feature_idx FROM P WHERE x0 < 250000 OR y0 < 1600000 OR x1 > 250900 OR y1 > 1600900", "P")
def boundary_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.boundary_errors(fx.parcels(spark, sf_dir), fx.communes_2013(spark, sf_dir)).select("feature_idx")


@query("SELECT a.syscol AS s13, b.syscol AS s26, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share FROM C13 a JOIN C26 b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1", "C13 C26")
def commune_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.operators.correspondence import overlay

    return overlay(fx.communes_2013(spark, sf_dir), fx.communes_2026(spark, sf_dir)).select("s13", "s26", "share")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping neighbours with their polygons."""
    # The geometries are made before the join, so that they are columns after it and not expressions that every use repeats.
    p = correction.with_parts(fx.parcels(spark, sf_dir).select("feature_idx", *BOX))
    pairs = box_join(p, p, 60.0, touching=False, self_join_on="feature_idx", ids=("feature_idx", "feature_idx"))
    return pairs.select(F.col("l_feature_idx").alias("i"), F.col("r_feature_idx").alias("j"), F.col("l_parts").alias("a"), F.col("r_parts").alias("b"))


@query("SELECT i, j, (a.x1 - a.x0) * (a.y1 - a.y0) - area AS left_area, (a.x1 - a.x0) * (a.y1 - a.y0) - area <= 0 AS deleted FROM O JOIN P a ON a.feature_idx = i", "P", OVERLAP)
def clip_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.clip(_pairs(spark, sf_dir), first=True).select("i", "j", "left_area", "deleted")


@query("SELECT i, j, (b.x1 - b.x0) * (b.y1 - b.y0) - area AS left_area, (b.x1 - b.x0) * (b.y1 - b.y0) - area <= 0 AS deleted FROM O JOIN P b ON b.feature_idx = j", "P", OVERLAP)
def clip_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.clip(_pairs(spark, sf_dir), first=False).select("i", "j", "left_area", "deleted")


@query("SELECT i, j, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - area AS area FROM O JOIN P a ON a.feature_idx = i JOIN P b ON b.feature_idx = j", "P", OVERLAP)
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("i", "j", (planar.area(F.col("a")) + planar.area(F.col("b")) - planar.shared_area(F.col("a"), F.col("b"))).alias("area"))


@query("SELECT feature_idx, greatest(0.0, least(x1, 250900.0) - greatest(x0, 250000.0)) * greatest(0.0, least(y1, 1600900.0) - greatest(y0, 1600000.0)) AS left_area FROM P WHERE x1 > 250900 OR y1 > 1600900", "P")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    boundary = fx.communes_2013(spark, sf_dir).select("k", F.array(F.array(_ring())).alias("b"))
    p = fx.parcels(spark, sf_dir)
    outside = p.join(quality.boundary_errors(p, fx.communes_2013(spark, sf_dir)).select("feature_idx"), "feature_idx")
    return correction.truncate(outside, boundary).select("feature_idx", "left_area")


#: Each side of a sliver counts for its longest stretch beside a side of the neighbour that is at most 5 m off.
_BESIDE = "greatest(CASE WHEN abs({v} - n.{a}) <= 5 THEN greatest(0.0, least(s.{q}, n.{q}) - greatest(s.{p}, n.{p})) ELSE 0.0 END, CASE WHEN abs({v} - n.{b}) <= 5 THEN greatest(0.0, least(s.{q}, n.{q}) - greatest(s.{p}, n.{p})) ELSE 0.0 END)"
_SHARED = " + ".join(_BESIDE.format(v=f"s.{v}", a=a, b=b, p=p, q=q) for v, a, b, p, q in (("y0", "y0", "y1", "x0", "x1"), ("y1", "y0", "y1", "x0", "x1"), ("x0", "x0", "x1", "y0", "y1"), ("x1", "x0", "x1", "y0", "y1")))
# A side of at most 5 m is also within 5 m of the neighbour's sides across it, as far as those reach along it: not at all.
NEIGHBOUR = f"""Z AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, (x1 - x0) * (y1 - y0) < 1 OR greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) > 50 AS sl FROM P),
M AS (SELECT s.feature_idx AS sliver_idx, n.feature_idx AS neighbour_idx, n.area, s.area AS sliver_area, {_SHARED} AS shared,
  greatest(0.0, least(s.x1, n.x1) - greatest(s.x0, n.x0)) * greatest(0.0, least(s.y1, n.y1) - greatest(s.y0, n.y0)) AS lap
 FROM Z s JOIN Z n ON s.sl AND NOT n.sl AND s.x0 <= n.x1 AND n.x0 <= s.x1 AND s.y0 <= n.y1 AND n.y0 <= s.y1),
B AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sliver_idx ORDER BY shared DESC, area DESC, neighbour_idx) AS place FROM M) WHERE place = 1)"""


@query("SELECT sliver_idx, neighbour_idx, shared FROM B", "P", NEIGHBOUR)
def merge_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.best_neighbours(quality.slivers(fx.parcels(spark, sf_dir))).select("sliver_idx", "neighbour_idx", "shared")


@query("SELECT Z.feature_idx, Z.area + coalesce(more, 0.0) AS area, coalesce(n, 0) AS merged FROM Z LEFT JOIN (SELECT neighbour_idx, sum(sliver_area - lap) AS more, count(*) AS n FROM B GROUP BY neighbour_idx) g ON g.neighbour_idx = Z.feature_idx WHERE Z.feature_idx NOT IN (SELECT sliver_idx FROM B)", "P", NEIGHBOUR)
def merge_slivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer after all its slivers have been merged into their neighbours."""
    return correction.merge_slivers(quality.slivers(fx.parcels(spark, sf_dir))).select("feature_idx", "area", "merged")


@query("SELECT feature_idx FROM Z WHERE NOT (sl AND feature_idx % 2 = 0)", "P", NEIGHBOUR)
def delete_slivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slivers with even ids are asked to be deleted, and so is one parcel by an action that its kind of error does not allow."""
    rows = quality.slivers(fx.parcels(spark, sf_dir))
    asked = rows.filter("is_sliver and feature_idx % 2 = 0").select("feature_idx", F.lit("sliver").alias("error_type"), F.lit("delete").alias("action"))
    refused = rows.filter("feature_idx = 7").select("feature_idx", F.lit("overlap").alias("error_type"), F.lit("delete").alias("action"))
    return correction.delete(rows, asked.unionByName(refused)).select("feature_idx")


@query("SELECT syscol, (x1 - x0) * (y1 - y0) + 100 * (y1 - y0) - 50 * 400 AS area FROM C13 WHERE k % 5 <> 4", "C13")
def assign_to_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of 100 m beyond communes, with a hole, become part of them; half of each strip's width lies in the commune already."""
    c = fx.communes_2013(spark, sf_dir)
    strip = geo.rectangle(F.col("x1") - 50, F.col("y0"), F.col("x1") + 100, F.col("y1"))
    hole = geo.rectangle(F.col("x1") + 20, F.col("y0") + 100, F.col("x1") + 70, F.col("y0") + 500)
    gaps = c.filter("k % 5 <> 4").select(F.col("k").alias("gap_idx"), F.array(F.array(strip, hole)).alias("parts"), F.col("k").alias("target_idx"))
    grown = correction.assign_gaps(c.withColumn("feature_idx", F.col("k")), gaps)
    return grown.join(c.select(F.col("k").alias("feature_idx"), "syscol"), "feature_idx").select("syscol", "area")


@query("SELECT event_id, upper(event_type) AS error_type, CASE event_id % 4 WHEN 0 THEN 'ignore' WHEN 1 THEN 'delete' END AS action, event_id % 7 = 0 OR event_id % 4 = 0 OR (event_id % 4 = 1 AND event_id % 3 = 0) AS corrected, CASE WHEN event_id % 4 < 2 AND event_id % 7 = 0 THEN 'already corrected' WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN 'action not allowed' END AS refused FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sliver' WHEN 1 THEN 'overlap' ELSE 'gap' END AS event_type FROM events)")
def commit_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to ignore or delete, on errors of three kinds, some of them corrected before."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("error_id"))
    kind = F.when(F.col("error_id") % 3 == 0, "SLIVER").when(F.col("error_id") % 3 == 1, "OVERLAP").otherwise("GAP")
    errors = e.select("error_id", kind.alias("error_type"), (F.col("error_id") % 7 == 0).alias("corrected"))
    requests = e.filter("error_id % 4 < 2").select("error_id", F.when(F.col("error_id") % 4 == 0, "ignore").otherwise("delete").alias("action"))
    return correction.committed(errors, requests).withColumnRenamed("error_id", "event_id")


@query("SELECT feature_idx, partner_idx, area AS shared_area FROM (SELECT *, row_number() OVER (PARTITION BY feature_idx ORDER BY area DESC, partner_idx) AS place FROM (SELECT i AS feature_idx, j AS partner_idx, area FROM O UNION ALL SELECT j, i, area FROM O)) WHERE place = 1", "P", OVERLAP)
def overlap_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.overlap_partners(fx.parcels(spark, sf_dir).select("feature_idx", *BOX))


@query("SELECT feature_idx FROM P WHERE feature_idx % 10 <> 3", "P")
def delete_by_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.parcels(spark, sf_dir).select("feature_idx", _ring().alias("ring"))
    targets = p.filter("feature_idx % 10 = 3").select(F.transform("ring", lambda v: F.transform(v, lambda c: c + 1e-9)).alias("ring"))
    return correction.delete_matching(p, targets).select("feature_idx")


@query("SELECT feature_idx, 'AUTO_' || lpad(CAST(41 + row_number() OVER (ORDER BY feature_idx) AS VARCHAR), 6, '0') AS nicad FROM P WHERE nicad_raw IN ('N/A', '')", "P")
def assign_auto_nicad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quality.trimmed(fx.parcels(spark, sf_dir)).withColumn("nicad", F.when(F.col("feature_idx") == 1, "AUTO_000041").otherwise(F.col("nicad")))
    return correction.assign_auto(p)


@query("SELECT area_hull, area_union, gap, severity FROM G", "P", f"{OVERLAP}, {GAP}")
def gap_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole layer's hull less what its parcels cover; the corners of the tables' parcels make the hull a rectangle, and no three parcels overlap."""
    return quality.gap(fx.parcels(spark, sf_dir))


#: A parcel of half a metre's height leaves a void up to the next row, less what its left neighbour covers; at the right end the hull goes 4 m on.
VOIDS = "W AS (SELECT feature_idx AS k, CASE WHEN feature_idx % 100 > 0 THEN (feature_idx - 1) % 5 ELSE 0 END AS l, CASE WHEN feature_idx % 100 = 99 THEN 44 ELSE 40 END AS r, x0, y0 FROM P WHERE feature_idx % 29 = 0), O2 AS (SELECT CAST((r - l) * 29.5 AS DOUBLE) AS area, x0 + CAST(l + r AS DOUBLE) / 2 AS x, y0 + 15.25 AS y FROM W)"


@query("SELECT area, x, y FROM O2", "P", VOIDS)
def layer_voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each gap of the layer, with its own area and centre."""
    return quality.voids(fx.parcels(spark, sf_dir)).select(F.round("area", 3).alias("area"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT O2.x, O2.y, feature_idx, CASE WHEN trim(nicad_raw) <> '' THEN trim(nicad_raw) ELSE 'feature_' || feature_idx END AS nicad, round(sqrt(pow((x0 + x1) / 2 - O2.x, 2) + pow((y0 + y1) / 2 - O2.y, 2)), 3) AS distance FROM P JOIN O2 ON abs((x0 + x1) / 2 - O2.x) < 60 AND abs((y0 + y1) / 2 - O2.y) < 60 AND sqrt(pow((x0 + x1) / 2 - O2.x, 2) + pow((y0 + y1) / 2 - O2.y, 2)) < 60", "P", VOIDS)
def gap_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features within 60 m of each gap's own centre."""
    gaps = quality.voids(fx.parcels(spark, sf_dir))
    near = quality.gap_neighbours(fx.parcels(spark, sf_dir), gaps, 60.0)
    return near.join(gaps.drop("area"), "void").select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "feature_idx", "nicad", F.round("distance", 3).alias("distance"))


NET = "V AS (SELECT feature_idx AS k, CAST(250000 + 40 * (feature_idx % 100) AS DOUBLE) AS x, CAST(1600000 + 30 * (feature_idx // 100) AS DOUBLE) AS y FROM P), F AS (SELECT *, CASE WHEN k % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 20 ELSE 0 END AS gone, 1 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS n FROM V)"


@query("SELECT x, y, CAST(CASE WHEN k % 3 = 0 THEN 600 ELSE 1200 END - gone AS DOUBLE) AS area, n AS rings, CASE WHEN k % 3 = 0 THEN 4 ELSE 5 END AS points FROM F UNION ALL SELECT x, y, 600.0, 1, 4 FROM F WHERE k % 3 = 0 UNION ALL SELECT x + 33, y + 2, 20.0, 1, 5 FROM F WHERE k % 11 = 0", "P", NET)
def polygonize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faces of one drawing: the sides of all cells as loose lines, which neighbours repeat, and lines along whole rows; diagonals, lines that end in a cell, and islands, of which the smaller ones are under the limit and leave a hole only."""
    k = F.col("feature_idx")
    x, y = (250000 + 40 * (k % 100)).cast("double"), (1600000 + 30 * F.floor(k / 100)).cast("double")
    line = lambda *at: F.array(*[F.array(x + dx, y + dy) for dx, dy in at])
    ring = lambda x0, y0, x1, y1: line((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    lines = F.array(line((0, 0), (40, 0)), line((40, 0), (40, 30)), line((40, 30), (0, 30)), line((0, 30), (0, 0)), F.when(k % 3 == 0, line((0, 0), (40, 30))), F.when(k % 5 == 0, line((0, 30), (3, 27))), F.when(k % 7 == 0, ring(30, 3, 32, 5)), F.when(k % 11 == 0, ring(33, 2, 37, 7)), F.when(k % 100 == 0, line((0, 0), (4000, 0))))
    drawing = fx.parcels(spark, sf_dir).select(F.lit("drawing").alias("net"), F.explode(lines).alias("points")).filter("points is not null")
    outer = F.get("rings", F.lit(0))
    least = lambda c: F.array_min(F.transform(outer, lambda p: F.round(F.get(p, F.lit(c)), 3)))
    return network.polygonize(drawing, least=cad.LEAST_AREA).select(least(0).alias("x"), least(1).alias("y"), F.round("area", 6).alias("area"), F.size("rings").alias("rings"), F.size(outer).alias("points"))


#: Heights and widths of boxes, the overlap of a box with its right neighbour, and what is asked for: chains of requests on one feature (1: two clips, 4 and 5: a clip, a deletion, a clip of what is gone; 7: a gap and a boundary), a merge, and requests that are refused or ignored.
BATCH = """H AS (SELECT feature_idx AS k, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h, lead(y1 - y0) OVER (ORDER BY feature_idx) AS h2, lead((x1 - x0) * (y1 - y0)) OVER (ORDER BY feature_idx) AS area2 FROM P),
I AS (SELECT *, (k % 5) * least(h, h2) AS lap, greatest(0.0, least(x1 + 1, 250900.0) - x0) * greatest(0.0, least(y1, 1600900.0) - y0) AS inner_area FROM H),
N AS (SELECT k AS feature_idx, w * h - lap AS area FROM I WHERE k % 10 = 1 UNION ALL SELECT k, NULL FROM I WHERE k % 10 = 5
 UNION ALL SELECT k, CASE WHEN inner_area > 0 THEN inner_area ELSE (w + 1) * h END FROM I WHERE k % 10 = 7
 UNION ALL SELECT k, NULL FROM I WHERE k % 290 = 232 UNION ALL SELECT k + 1, w * h + area2 - lap FROM I WHERE k % 290 = 232),
R AS (SELECT 10 * k + 1 AS request_id, NULL AS refused FROM I WHERE k % 10 = 1 UNION ALL SELECT 10 * k + 2, NULL FROM I WHERE k % 10 = 1 UNION ALL SELECT 10 * k + 3, NULL FROM I WHERE k % 10 = 4
 UNION ALL SELECT 10 * k + 4, NULL FROM I WHERE k % 10 = 5 UNION ALL SELECT 10 * k + 5, 'not found' FROM I WHERE k % 10 = 5 UNION ALL SELECT 10 * k + 6, NULL FROM I WHERE k % 10 = 7
 UNION ALL SELECT 10 * k + 7, CASE WHEN inner_area > 0 THEN NULL ELSE 'no intersection' END FROM I WHERE k % 10 = 7 UNION ALL SELECT 10 * k + 8, 'action not allowed' FROM I WHERE k % 10 = 8
 UNION ALL SELECT 10 * k + 9, NULL FROM I WHERE k % 10 = 9 UNION ALL SELECT 10 * k, NULL FROM I WHERE k % 290 = 232)"""


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    layer = correction.with_parts(fx.parcels(spark, sf_dir).select("feature_idx", *BOX))
    k = F.col("feature_idx")
    strip = F.array(F.array(geo.rectangle(F.col("x1"), F.col("y0"), F.col("x1") + 1, F.col("y1"))))
    ask = lambda when, id_, kind, action, of=k, other=None, gap=None: F.when(when, F.struct((10 * k + id_).alias("request_id"), F.lit(kind).alias("error_type"), F.lit(action).alias("action"), of.alias("feature_idx"), (F.lit(None) if other is None else other).cast("bigint").alias("other_idx"), (F.lit(None) if gap is None else gap).cast(planar.PARTS).alias("gap")))
    t = k % 10
    asked = [
        ask(t == 1, 1, "OVERLAP", "clip_first", other=k + 1), ask(t == 1, 2, "OVERLAP", "clip_first", of=k + 1, other=k), ask(t == 4, 3, "OVERLAP", "clip_second", other=k + 1), ask(t == 5, 4, "INVALID_GEOM", "delete"), ask(t == 5, 5, "OVERLAP", "clip_first", other=k + 1),
        ask(t == 7, 6, "GAP", "assign_to_neighbor", gap=strip), ask(t == 7, 7, "BOUNDARY_CROSS", "truncate"), ask(t == 8, 8, "SLIVER", "clip_first"), ask(t == 9, 9, "OVERLAP", "ignore"), ask(k % 290 == 232, 0, "SLIVER", "merge_neighbor", other=k + 1),
    ]
    requests = layer.select(F.explode(F.filter(F.array(*asked), lambda r: r.isNotNull())).alias("r")).select("r.*")
    boundary = fx.communes_2013(spark, sf_dir).select("k", F.array(F.array(_ring())).alias("b"))
    return batch.apply(layer, requests, boundary)


@query("SELECT P.feature_idx, CASE WHEN N.feature_idx IS NULL THEN (x1 - x0) * (y1 - y0) ELSE N.area END AS area FROM P LEFT JOIN N USING (feature_idx) WHERE N.feature_idx IS NULL OR N.area IS NOT NULL", "P", BATCH)
def correction_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer after a batch of corrections that depend on each other."""
    return _batch(spark, sf_dir)[0].select("feature_idx", F.round(planar.area(F.col("parts")), 6).alias("area"))


@query("SELECT request_id, refused IS NULL AS corrected, refused FROM R", "P", BATCH)
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each request."""
    return _batch(spark, sf_dir)[1]
