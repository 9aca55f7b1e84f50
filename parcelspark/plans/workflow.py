"""Queries over the registry's workflow: upserts, checks, deletions, searches, imports, texts of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions import geometry as geo
from parcelspark.functions import nicad as nic
from parcelspark.functions.text import area_text, score_band, score_text, table_cells
from parcelspark.operators import correction, listing, registry
from parcelspark.operators import correspondence as co
from parcelspark.plans.correspondence import RECOMPUTED, REGISTRY, _recomputed, _registry
from parcelspark.plans.identifiers import V
from parcelspark.plans.listings import BOTH, _errors
from parcelspark.plans.registry import query, table
from parcelspark.plans.spatial import OVERLAP


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A table, and two changes in turn to keys of which some are in it."""
    p = fx.parcels(spark, sf_dir).select("feature_idx")
    turns = F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("provisoire").alias("statut")), F.struct(F.lit(2).alias("pos"), F.lit("bascule").alias("statut"))))
    return p.filter("feature_idx % 2 = 0").withColumn("statut", F.lit("actif")), p.filter("feature_idx % 3 = 0").select("feature_idx", turns.alias("t")).select("feature_idx", "t.*")


@query("SELECT feature_idx, CASE WHEN feature_idx % 3 = 0 THEN 'bascule' ELSE 'actif' END AS statut FROM P WHERE feature_idx % 2 = 0 OR feature_idx % 3 = 0", "P")
def update_or_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.upsert(*_changes(spark, sf_dir), "feature_idx")


@query("SELECT feature_idx, CASE WHEN feature_idx % 2 = 0 THEN 'actif' ELSE 'bascule' END AS statut FROM P WHERE feature_idx % 2 = 0 OR feature_idx % 3 = 0", "P")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.upsert(*_changes(spark, sf_dir), "feature_idx", replace=False)


@query("SELECT nicad1, max(event_id) AS event_id, arg_max(error_type, event_id) AS error_type FROM X GROUP BY nicad1", "", BOTH)
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.last_wins(_errors(spark, sf_dir).select("nicad1", "event_id", "error_type"), "nicad1", "event_id")


@query("SELECT feature_idx, errors = '' AS valid, errors = '' AND n IS NOT NULL AS found FROM W LEFT JOIN K ON n = c", "P", V + ", K AS (SELECT DISTINCT syscol || section || parcelle AS n FROM P WHERE feature_idx % 4 = 0)")
def nicad_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.parcels(spark, sf_dir)
    existing = p.filter("feature_idx % 4 = 0").select(F.concat("syscol", "section", "parcelle").alias("nicad"))
    return registry.verified(p, existing).select("feature_idx", "valid", "found")


@query("SELECT feature_idx, CASE WHEN length(s) NOT BETWEEN 7 AND 8 THEN 'syscol' WHEN length(c) NOT BETWEEN 1 AND 3 THEN 'section' WHEN length(nicad_raw) <> 16 THEN 'nicad' END AS reason FROM (SELECT *, substr(syscol, 1 + CAST(feature_idx % 3 AS INTEGER)) AS s, repeat('1', CAST(feature_idx % 5 AS INTEGER)) AS c FROM P)", "P")
def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with what it is rejected for."""
    requests = fx.parcels(spark, sf_dir).select("feature_idx", F.expr("substr(syscol, 1 + CAST(feature_idx % 3 AS INT))").alias("syscol"), F.expr("repeat('1', CAST(feature_idx % 5 AS INT))").alias("section"), F.col("nicad_raw").alias("nicad"))
    return registry.checked(requests).select("feature_idx", "reason")


@query("SELECT error_type, count(*) FILTER (analysis_id % 10 <> 0) AS kept, count(*) FILTER (analysis_id % 10 = 0) AS deleted FROM X GROUP BY error_type", "", BOTH)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that stay and go with the analyses that are deleted."""
    e = _errors(spark, sf_dir)
    kept, gone = registry.cascade(e.filter("analysis_id % 10 = 0"), e, "analysis_id")
    both = kept.select("error_type", F.lit(1).alias("k"), F.lit(0).alias("g")).unionByName(gone.select("error_type", F.lit(0).alias("k"), F.lit(1).alias("g")))
    return both.groupBy("error_type").agg(F.sum("k").alias("kept"), F.sum("g").alias("deleted"))


@query("SELECT count(nicad) AS nicads, count(nicad) FILTER (version = '2013') AS v2013, count(nicad) FILTER (version = '2026') AS v2026, count(*) FILTER (statut = 'archive') AS bascules, CAST(floor(count(*) FILTER (statut = 'archive') * 100 / count(nicad) + 0.5) AS BIGINT) AS taux, count(*) AS parcelles, count(DISTINCT syscol || section) AS sections, (SELECT count(*) FROM C13) AS communes_2013, (SELECT count(*) FROM C26) AS communes_2026 FROM G", "P C13 C26", REGISTRY)
def registry_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dashboard(_registry(spark, sf_dir), fx.communes_2013(spark, sf_dir), fx.communes_2026(spark, sf_dir))


@query("SELECT s13, s26, CASE WHEN statut = 'provisoire' AND s26 IS NOT NULL THEN 'confirme' ELSE statut END AS statut FROM R WHERE region = 'ASIA'", "C13 C26", RECOMPUTED)
def confirm_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.confirmed(co.search(_recomputed(spark, sf_dir), region="ASIA")).select("s13", "s26", "statut")


@query("SELECT feature_idx, partner_idx, place FROM (SELECT *, row_number() OVER (PARTITION BY feature_idx ORDER BY area DESC, partner_idx) AS place FROM (SELECT i AS feature_idx, j AS partner_idx, area FROM O UNION ALL SELECT j, i, area FROM O)) WHERE place <= 3", "P", OVERLAP)
def top_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partners for each; the number is the feature."""
    return correction.top_partners(fx.parcels(spark, sf_dir).select("feature_idx", "x0", "y0", "x1", "y1"), 3)


@query("SELECT feature_idx FROM P WHERE x0 BETWEEN 250500 AND 252500 AND y0 BETWEEN 1600100 AND 1600900 AND nicad_raw <> '' ORDER BY feature_idx LIMIT 500", "P")
def extent_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of a map's extent; the limit is the feature."""
    near = fx.parcels(spark, sf_dir).filter(F.col("x0").between(250500, 252500) & F.col("y0").between(1600100, 1600900) & (F.col("nicad_raw") != ""))
    return listing.page(near, [F.col("feature_idx")], 500).select("feature_idx")


NUMBER = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query("SELECT feature_idx, 'POLYGON((' || a || ' ' || b || ',' || c || ' ' || b || ',' || c || ' ' || d || ',' || a || ' ' || d || ',' || a || ' ' || b || '))' AS wkt FROM (SELECT feature_idx, " + ", ".join(f"{NUMBER.format(v)} AS {n}" for v, n in (("x0", "a"), ("y0", "b"), ("x1", "c"), ("y1", "d"))) + " FROM P)", "P")
def wkt_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.parcels(spark, sf_dir).select("feature_idx", geo.wkt(F.array(geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))).alias("wkt"))


@query("SELECT feature_idx, CASE WHEN feature_idx % 4 < 3 THEN syscol END AS syscol, CASE WHEN feature_idx % 4 = 3 THEN NULL WHEN feature_idx % 8 = 2 THEN '001' ELSE section END AS section, CASE WHEN feature_idx % 4 = 3 THEN NULL WHEN feature_idx % 4 = 0 THEN parcelle WHEN feature_idx % 3 > 0 THEN parcelle WHEN feature_idx + 1 > 99999 THEN CAST(feature_idx + 1 AS VARCHAR) ELSE lpad(CAST(feature_idx + 1 AS VARCHAR), 5, '0') END AS parcelle FROM P", "P")
def parcel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of imported parcels from whichever of their columns are there."""
    k = F.col("feature_idx")
    only = lambda r, c: F.when(k % 4 == r, c)
    key = nic.resolved(only(0, F.concat_ws("-", "syscol", "section", "parcelle")), only(1, F.concat("syscol", F.lit(" "), "section")), only(2, F.substring("syscol", 2, 7)), F.when(k % 8 != 2, F.col("section")), F.when(k % 3 > 0, (k % 997).cast("string")), k)
    return fx.parcels(spark, sf_dir).select("feature_idx", key.alias("key")).select("feature_idx", "key.syscol", "key.section", "key.parcelle")


@query("SELECT feature_idx, CASE WHEN a >= 10000 THEN format('{:.2f}', a / 10000) || ' ha' ELSE format('{:.2f}', a) || ' m²' END AS area, format('{:.1f}', CAST(feature_idx % 101 AS DOUBLE)) || '%' AS score, CASE WHEN feature_idx % 101 >= 90 THEN 'good' WHEN feature_idx % 101 >= 70 THEN 'fair' WHEN feature_idx % 101 >= 50 THEN 'weak' ELSE 'poor' END AS band FROM (SELECT feature_idx, (x1 - x0) * (y1 - y0) * 10 AS a FROM P)", "P")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, score = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 10, F.col("feature_idx") % 101
    return fx.parcels(spark, sf_dir).select("feature_idx", area_text(a).alias("area"), score_text(score).alias("score"), score_band(score).alias("band"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '/' || c_mktsegment END AS cells FROM customer")
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report: rows of a table, the line under its head, and plain text."""
    k = F.col("c_custkey") % 3
    line = F.when(k == 0, F.concat(F.lit(" | "), "c_name", F.lit("|  "), "c_mktsegment", F.lit(" |"))).when(k == 1, "|:---|---:|").otherwise(F.concat(F.lit("a | "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(table_cells(line), "/").alias("cells"))


@query("SELECT 'C' || CAST(c_custkey AS VARCHAR) AS code, c_name AS nom, c_mktsegment AS segment FROM customer UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of different columns as one; what a layer lacks is null."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("nom"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("nom"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT event_id, total FROM (SELECT *, count(*) OVER () AS total FROM X WHERE contains(lower(error_type), 'lap') OR contains(lower(nicad1), 'p49')) ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20", "", BOTH)
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the search with the number of all its hits; its limit is the feature."""
    found = _errors(spark, sf_dir).filter(listing.contains_any([F.col("error_type")], "LAP") | listing.contains_any([F.col("nicad1")], "p49"))
    total = found.agg(F.count("*").alias("total"))
    return listing.page(found, [F.desc("ts"), F.col("event_id")], 20, 20).join(F.broadcast(total)).select("event_id", "total")
