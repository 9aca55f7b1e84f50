"""Queries over formats: GeoJSON, CSV points, KML, round trips through text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions import geometry as geo
from parcelspark.functions import nicad as nic
from parcelspark.plans.registry import query, table
from parcelspark.sources import geojson, tables


@query("SELECT feature_idx AS doc, 'Polygon' AS geom_type, nicad_raw AS nicad, CAST(feature_idx AS VARCHAR) AS object_id, (x1 - x0) * (y1 - y0) AS area FROM P", "P")
def geojson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parcel as a document of its own, written to GeoJSON and read back."""
    ring = geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    props = F.create_map(F.lit("NICAD"), F.concat(F.lit(" "), "nicad_raw"), F.lit("FID"), F.col("feature_idx").cast("string"))
    documents = fx.parcels(spark, sf_dir).select(F.col("feature_idx").alias("doc"), geojson.feature_text(F.lit("Polygon"), F.array(ring), props).alias("value"))
    rows = geojson.features(documents)
    return rows.select("doc", "geom_type", nic.from_properties(F.col("props")).alias("nicad"), nic.object_id(F.col("props"), F.col("feature_idx")).alias("object_id"), geo.polygon_area(F.col("rings")).alias("area"))


@query("SELECT syscol, CAST(count(*) AS BIGINT) AS n, sum(feature_idx) AS total FROM P GROUP BY syscol", "P")
def geojson_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of features, a document for each section of a commune, flattened again; null features are dropped."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x0", "y0").alias("coordinates")).alias("geometry"), F.create_map(F.lit("id"), F.col("feature_idx").cast("string")).alias("properties")))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[null,'), F.array_join(F.collect_list(feature), ","), F.lit("]}"))
    # Documents are kept small: a section's parcels in groups of 64.
    groups = fx.parcels(spark, sf_dir).groupBy("syscol", "section", F.floor(F.col("feature_idx") / 4096).alias("part")).agg(text.alias("value"))
    rows = geojson.features(groups)
    return rows.groupBy("syscol").agg(F.count("*").alias("n"), F.sum(F.try_element_at("props", F.lit("id")).cast("bigint")).alias("total"))


@query("SELECT c_custkey, CAST(c_custkey AS DOUBLE) / 2 AS x, CAST(c_custkey % 90 AS DOUBLE) AS y FROM customer WHERE c_custkey % 5 <> 0")
def csv_points_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of points, some of them without a number."""
    lat = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise((F.col("c_custkey") % 90).cast("string"))
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('a,"'), (F.col("c_custkey") / 2).cast("string"), F.lit('",'), lat, F.lit("abc")).alias("value"))
    return tables.csv_points(lines, 'name,"LNG",Latitude').select("c_custkey", "x", "y")


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS code, c_name AS nom, '' AS rest FROM customer")
def csv_records_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a separator found in the header; a missing value is empty."""
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" '"), F.col("c_custkey").cast("string"), F.lit("' ; \""), "c_name", F.lit('"')).alias("value"))
    rows = tables.records(lines, "code;nom;rest")
    return rows.select("c_custkey", *[F.col("record")[k].alias(k) for k in ("code", "nom", "rest")])


@query("SELECT n_nationkey, n_name AS name, CAST(5 AS INTEGER) AS points, CAST(n_nationkey + 1 AS DOUBLE) AS max_x FROM nation WHERE n_nationkey % 4 <> 0")
def kml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks with open rings, closed on reading; those of two points are dropped."""
    k = F.col("n_nationkey").cast("string")
    next_ = (F.col("n_nationkey") + 1).cast("string")
    ring = F.concat(k, F.lit(",0,1 "), next_, F.lit(",0 \n"), next_, F.lit(",1 "), k, F.lit(",1"))
    short = F.concat(k, F.lit(",0 "), next_, F.lit(",1"))
    text = F.concat(F.lit("<kml><Placemark id='1'><name> "), "n_name", F.lit(" </name><Polygon><coordinates>"), F.when(F.col("n_nationkey") % 4 == 0, short).otherwise(ring), F.lit("</coordinates></Polygon></Placemark></kml>"))
    rows = tables.placemarks(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("value")))
    return rows.select("n_nationkey", "name", F.size("ring").alias("points"), geo.bbox(F.col("ring"))["max_x"].alias("max_x"))
