"""Queries for the records around an analysis: its run, its reports, its requests, and the tables that are copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions import nicad as nic
from parcelspark.functions import text
from parcelspark.operators import cad, quality, registry, reports
from parcelspark.operators.spatial import points_in
from parcelspark.plans.correspondence import REGISTRY, _registry
from parcelspark.plans.identifiers import _classes
from parcelspark.plans.listings import BOTH, _errors
from parcelspark.plans.registry import query, table
from parcelspark.plans.spatial import ERRORS, GAP, OVERLAP, SECTIONS, _sections

KINDS = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in cad.LABELS.items())


@query(f"SELECT feature_idx, cls, CASE cls {KINDS} END AS kind FROM K", "E", _classes())
def label_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the texts of each class are."""
    return cad.classified(fx.layers(spark, sf_dir)).select("feature_idx", "cls", cad.label_of_layer(F.col("cls")).alias("kind"))


@query("SELECT section_idx, arg_min(numero, label_idx) AS numero FROM (SELECT label_idx, min(section_idx) AS section_idx, max(lpad(right(regexp_replace(label, '[^0-9]', '', 'g'), 3), 3, '0')) AS numero FROM L JOIN N ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 WHERE regexp_matches(label, '[0-9]') GROUP BY label_idx) GROUP BY section_idx", "L", f"N AS ({SECTIONS})")
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text in each section that has a number."""
    rows = fx.labels(spark, sf_dir).withColumn("numero", F.when(F.col("label").rlike("[0-9]"), nic.section_number(text.digits(F.col("label"))))).filter("numero is not null")
    hit = points_in(rows, _sections(spark, sf_dir), 900.0, "label_idx", "section_idx").filter("b_section_idx is not null")
    return hit.groupBy(F.col("b_section_idx").alias("section_idx")).agg(F.min_by("numero", "label_idx").alias("numero"))


@query("SELECT (SELECT count(nicad) FROM G WHERE version = '2013') AS nicads_2013, (SELECT count(nicad) FROM G WHERE version = '2026') AS nicads_2026, (SELECT count(*) FROM G WHERE statut = 'archive') AS bascules, (SELECT count(*) FROM G WHERE statut = 'archive' AND nicad IS NOT NULL) AS historique, (SELECT count(*) FROM G) AS parcelles, (SELECT count(DISTINCT syscol || section) FROM G) AS sections, (SELECT count(*) FROM C13) AS communes_2013, (SELECT count(*) FROM C26) AS communes_2026, (SELECT count(*) FROM customer) AS operations, (SELECT string_agg(c_custkey, ',' ORDER BY c_custkey DESC) FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5)) AS recentes", "P C13 C26", REGISTRY)
def registry_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of the registry's dashboard, and its five latest operations, which are the feature."""
    r = _registry(spark, sf_dir)
    operations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("op_id"))
    return reports.counters(r, r.filter("statut = 'archive' and nicad is not null"), fx.communes_2013(spark, sf_dir), fx.communes_2026(spark, sf_dir), operations)


@query("SELECT event_id, severity FROM X ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, event_id LIMIT 5", "", BOTH)
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most severe errors; the number is the feature."""
    e = _errors(spark, sf_dir)
    return e.orderBy(quality.severity_rank(F.col("severity")), "event_id").limit(5).select("event_id", "severity")


@query("SELECT c_custkey AS report_id, 'Rapport ' || CASE c_custkey % 3 WHEN 0 THEN 'd''Expert' WHEN 1 THEN 'Détaillé' ELSE 'Résumé' END || ' — ' || c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'renewed ' || c_custkey ELSE 'Score: ' || c_custkey % 100 || '%' END AS content FROM customer WHERE c_custkey % 5 > 0")
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports after some were made again and some deleted."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    kind = F.when(k % 3 == 0, "EXPERT").when(k % 3 == 1, "DETAILED").otherwise("SUMMARY")
    made = reports.created(c.select(k.alias("report_id"), kind.alias("kind"), F.col("c_name").alias("name"), F.concat(F.lit("Score: "), (k % 100).cast("string"), F.lit("%")).alias("content")))
    renewed = c.filter("c_custkey % 2 = 0").select(k.alias("report_id"), F.concat(F.lit("renewed "), k.cast("string")).alias("content"), F.lit(1).alias("pos"))
    return reports.without(registry.update_fields(made, renewed, "report_id", ["content"]), c.filter("c_custkey % 5 = 0").select(k.alias("report_id")), "report_id")


@query("SELECT feature_idx, CASE WHEN feature_idx % 6 = 0 THEN 'archive' ELSE statut END AS statut, CASE WHEN feature_idx % 6 = 0 THEN 'N' || feature_idx ELSE nicad END AS nicad FROM G", "P", REGISTRY)
def point_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single rows get a new status and identifier."""
    r = _registry(spark, sf_dir).select("feature_idx", "statut", "nicad")
    changes = r.filter("feature_idx % 6 = 0").select("feature_idx", F.lit("archive").alias("statut"), F.concat(F.lit("N"), F.col("feature_idx").cast("string")).alias("nicad"), F.lit(1).alias("pos"))
    return registry.update_fields(r, changes, "feature_idx", ["statut", "nicad"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey AS BIGINT) END AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS nom, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS DOUBLE) / 4 END AS surface FROM customer")
def migrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another database, all of them texts, as typed columns; what cannot be read is null."""
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, "x").otherwise(k.cast("string")).alias("id"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("nom"), F.when(k % 5 == 0, "").otherwise((k / 4).cast("string")).alias("surface"))
    return reports.typed(raw, {"id": "bigint", "nom": "string", "surface": "double"})


@query("SELECT event_id, CASE WHEN NOT (event_id % 4 < 2) THEN 'version' WHEN event_id % 1100 > 1000 THEN 'items' WHEN event_id % 6 = 5 THEN 'statut' END AS reason FROM events")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enumerations and sizes of lists refuse."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, "2013").when(k % 4 == 1, "2026").otherwise("1999").alias("version"), (k % 1100).alias("items"), F.when(k % 6 == 5, "perdu").otherwise("confirme").alias("statut"))
    return reports.refused(rows, {"version": ["2013", "2026"]}, {"items": 1000}, {"statut": ["confirme", "provisoire", "sans_correspondance"]}).select("event_id", "reason")


@query("SELECT 'COMPLETED' AS status, features, n_errors, score FROM (SELECT (SELECT count(*) FROM P) AS features, count(*) AS n_errors, floor(greatest(0.0, least(100.0, 100.0 - CAST(count(*) FILTER (severity = 'critical') * 10 + count(*) FILTER (severity = 'high') * 5 + count(*) FILTER (severity = 'medium') * 2 AS DOUBLE) / (SELECT count(*) FROM P) * 10)) * 10 + 0.5) / 10 AS score FROM R)", "P", f"{OVERLAP}, {GAP}, {ERRORS}")
def analysis_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that an analysis ends with."""
    return reports.run(fx.parcels(spark, sf_dir), fx.communes_2013(spark, sf_dir))


@query("SELECT c_custkey, c_name || ';x' AS nom, 'a \"b\"' AS note, c_mktsegment AS statut FROM customer")
def quoted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quoted separators and doubled quotes."""
    from parcelspark.sources.tables import quoted_records

    q = F.lit('"')
    line = F.concat(q, "c_name", F.lit(';x";"a ""b""";'), "c_mktsegment")
    rows = quoted_records(table(spark, sf_dir, "customer").select("c_custkey", line.alias("value")), "nom string, note string, statut string")
    return rows.select("c_custkey", "record.*")


@query("SELECT feature_idx, coalesce(nicad, '') AS nicad, syscol, CAST(feature_idx % 2 = 0 AS VARCHAR) AS is_piscine FROM G", "P", REGISTRY)
def parcel_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn parcels as features with their fourteen properties, read again."""
    from parcelspark.functions import geometry as geo
    from parcelspark.sources import geojson

    r = _registry(spark, sf_dir)
    boxes = fx.parcels(spark, sf_dir).select("feature_idx", F.array(geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).alias("rings"))
    rows = r.join(boxes, "feature_idx").withColumn("is_piscine", F.col("feature_idx") % 2 == 0)
    made = rows.select("feature_idx", reports.parcel_feature(rows).alias("value"))
    read = geojson.features(made.withColumnRenamed("feature_idx", "doc"))
    return read.select(F.col("doc").alias("feature_idx"), *[F.try_element_at("props", F.lit(c)).alias(c) for c in ("nicad", "syscol", "is_piscine")])
