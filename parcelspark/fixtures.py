"""The cadastral projection of the test tables: parcels from orders, communes of two vintages from nation and region, labels from events.

The texts run unchanged in Spark SQL and in other engines; coordinates are multiples of 0.5, so that areas are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARCELS = """
SELECT feature_idx, syscol, section, parcelle,
  CASE WHEN feature_idx % 11 = 0 THEN 'N/A'
       WHEN feature_idx % 13 = 0 THEN ''
       WHEN feature_idx % 17 = 0 THEN substr(full_nicad, 1, 6)
       WHEN feature_idx % 19 = 0 THEN full_nicad || '9'
       WHEN feature_idx % 23 = 0 THEN syscol || '-' || section || '-' || parcelle
       ELSE full_nicad END AS nicad_raw,
  CAST(250000 + 40 * (feature_idx % 100) AS DOUBLE) AS x0,
  CAST(1600000 + 30 * CAST(floor(feature_idx / 100) AS BIGINT) AS DOUBLE) AS y0,
  CAST(250000 + 40 * (feature_idx % 100) + 40 + feature_idx % 5 AS DOUBLE) AS x1,
  CAST(1600000 + 30 * CAST(floor(feature_idx / 100) AS BIGINT)
       + CASE WHEN feature_idx % 29 = 0 THEN 0.5 ELSE 30 END AS DOUBLE) AS y1
FROM (SELECT p0.*, syscol || section || parcelle AS full_nicad FROM (
  SELECT o_orderkey AS feature_idx,
         lpad(CAST(1430100 + o_custkey % 25 AS STRING), 8, '0') AS syscol,
         lpad(CAST(o_orderkey % 7 AS STRING), 3, '0') AS section,
         lpad(CAST(o_orderkey % 997 AS STRING), 5, '0') AS parcelle
  FROM orders) p0) p1"""

COMMUNES_2013 = """
SELECT n_nationkey AS k, lpad(CAST(1430100 + n_nationkey AS STRING), 8, '0') AS syscol, n_name AS nom,
 r_name AS region, 'D' || CAST(n_nationkey % 4 AS STRING) AS dept,
 CAST(250000 + (n_nationkey % 5) * 900 AS DOUBLE) AS x0,
 CAST(1600000 + CAST(floor(n_nationkey / 5) AS BIGINT) * 900 AS DOUBLE) AS y0,
 CAST(250000 + (n_nationkey % 5) * 900 + 900 AS DOUBLE) AS x1,
 CAST(1600000 + CAST(floor(n_nationkey / 5) AS BIGINT) * 900 + 900 AS DOUBLE) AS y1
FROM nation JOIN region ON n_regionkey = r_regionkey"""

COMMUNES_2026 = f"""
SELECT k, lpad(CAST(1430200 + k AS STRING), 8, '0') AS syscol,
 CASE WHEN k % 7 = 3 THEN nom || ' NORD' ELSE nom END AS nom, region,
 CASE WHEN k % 8 = 5 THEN 'D9' ELSE dept END AS dept,
 x0 + CASE WHEN k % 3 = 0 THEN 300 ELSE 0 END AS x0, y0,
 x1 + CASE WHEN k % 9 = 2 THEN 900 WHEN k % 3 = 0 THEN 300 ELSE 0 END AS x1, y1
FROM ({COMMUNES_2013}) c13 WHERE k % 10 <> 4 AND k % 9 <> 3"""

#: Parcels of five shapes, as what is cut out of their boxes (hx0 .. hy1): nothing, the upper right corner, a hole, a strip that leaves two parts; and right triangles (kind 4). Slivers stay boxes.
SHAPED = f"""
SELECT feature_idx, nicad_raw, kind, x0, y0, x1, y1,
 CASE kind WHEN 1 THEN x0 + 20 WHEN 2 THEN x0 + 0.5 WHEN 3 THEN x0 + 15 ELSE x0 END AS hx0, CASE kind WHEN 1 THEN y0 + 15 WHEN 2 THEN y0 + 5 ELSE y0 END AS hy0,
 CASE kind WHEN 1 THEN x1 WHEN 2 THEN x0 + 1 WHEN 3 THEN x0 + 25 ELSE x0 END AS hx1, CASE kind WHEN 1 THEN y1 WHEN 2 THEN y0 + 10 WHEN 3 THEN y1 ELSE y0 END AS hy1
FROM (SELECT *, CASE WHEN feature_idx % 29 = 0 THEN 0 ELSE feature_idx % 5 END AS kind FROM ({PARCELS}) p) q"""

#: Old and new communes of three shapes, in the same way: whole, without a corner, with a hole.
_CUT = "CASE k % 3 WHEN 1 THEN x0 + 450 WHEN 2 THEN x0 + 100 ELSE x0 END AS hx0, CASE k % 3 WHEN 1 THEN y0 + 450 WHEN 2 THEN y0 + 100 ELSE y0 END AS hy0, CASE k % 3 WHEN 1 THEN x1 WHEN 2 THEN x0 + 300 ELSE x0 END AS hx1, CASE k % 3 WHEN 1 THEN y1 WHEN 2 THEN y0 + 500 ELSE y0 END AS hy1"
SHAPED_2013 = f"SELECT *, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 3 END AS kind, {_CUT} FROM ({COMMUNES_2013}) c"
SHAPED_2026 = f"SELECT *, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 3 END AS kind, {_CUT} FROM ({COMMUNES_2026}) c"

#: Texts placed as points inside the parcels' grid.
LABELS = """
SELECT event_id AS label_idx, CAST(250000 + (event_id * 37) % 4000 + 0.5 AS DOUBLE) AS x,
 CAST(1600000 + (event_id * 53) % 3000 + 0.25 AS DOUBLE) AS y,
 CASE event_id % 7 WHEN 0 THEN 'TF ' || CAST(event_id % 1000 AS STRING) WHEN 1 THEN CAST(event_id % 99999 AS STRING)
   WHEN 2 THEN 'Lot No ' || CAST(event_id % 50 AS STRING) WHEN 3 THEN 'Villa ' || event_type WHEN 4 THEN '  '
   WHEN 5 THEN 'bloc ' || CAST(event_id % 300 AS STRING) || 'A' ELSE event_type END AS label
FROM events"""

#: CAD entities: layer names and geometry types over the documents' ids, a number as text.
LAYERS = """
SELECT doc_id AS feature_idx,
 CASE doc_id % 16 WHEN 0 THEN 'Limites-Parcelles' WHEN 1 THEN 'NUMERO_PARCELLE' WHEN 2 THEN 'Limites_Sections' WHEN 3 THEN 'numero section'
  WHEN 4 THEN 'LIMITES_TF' WHEN 5 THEN 'Numero_TF' WHEN 6 THEN 'BATIMENT' WHEN 7 THEN 'PICINES' WHEN 8 THEN 'Numero de Lot' WHEN 9 THEN 'num_bati'
  WHEN 10 THEN 'NB_ETAGE' WHEN 11 THEN 'Titre Parcelle' WHEN 12 THEN 'PROPRIETAIRE MAJ' WHEN 13 THEN 'Voirie' WHEN 14 THEN 'niveau' ELSE 'divers' END AS layer,
 CASE doc_id % 3 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' ELSE 'Point' END AS geom_type,
 CAST(doc_id % 900 AS STRING) AS label
FROM documents"""


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    for t in tables:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PARCELS, "orders")


def with_parts(df: DataFrame) -> DataFrame:
    """The geometry of rows of SHAPED, SHAPED_2013 or SHAPED_2026 as an array of polygons."""
    ring = lambda *corners: F.array(*[F.array(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y) for x, y in (*corners, corners[0])])
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    shape = {
        1: F.array(F.array(ring(("x0", "y0"), ("x1", "y0"), ("x1", "hy0"), ("hx0", "hy0"), ("hx0", "y1"), ("x0", "y1")))),
        2: F.array(F.array(box("x0", "y0", "x1", "y1"), box("hx0", "hy0", "hx1", "hy1"))),
        3: F.array(F.array(box("x0", "y0", "hx0", "y1")), F.array(box("hx1", "y0", "x1", "y1"))),
        4: F.array(F.array(ring(("x0", "y0"), ("x1", "y0"), ("x0", "y1")))),
    }
    parts = F.array(F.array(box("x0", "y0", "x1", "y1")))
    for kind, made in shape.items():
        parts = F.when(F.col("kind") == kind, made).otherwise(parts)
    return df.withColumn("parts", parts)


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(_sql(spark, sf_dir, SHAPED, "orders").withColumns({c: F.col(c).cast("double") for c in ("hx0", "hy0", "hx1", "hy1")}))


def shaped_communes(spark: SparkSession, sf_dir: str, vintage: int) -> DataFrame:
    rows = _sql(spark, sf_dir, SHAPED_2013 if vintage == 2013 else SHAPED_2026, "nation", "region")
    return with_parts(rows.withColumns({c: F.col(c).cast("double") for c in ("hx0", "hy0", "hx1", "hy1")}))


def communes_2013(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, COMMUNES_2013, "nation", "region")


def communes_2026(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, COMMUNES_2026, "nation", "region")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LABELS, "events")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LAYERS, "documents")
