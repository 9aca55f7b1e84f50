"""Queries for lists, dashboards, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions.text import half_up
from parcelspark.operators import listing, quality
from parcelspark.plans.registry import query, table

# An analysis for each user, an error for each event; the last moment of the events is "now".
TYPES = "CASE event_id % 5 WHEN 0 THEN 'OVERLAP' WHEN 1 THEN 'SLIVER' WHEN 2 THEN 'GAP' WHEN 3 THEN 'DUPLICATE' ELSE 'MISSING_NICAD' END"
SEVERITIES = "CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"
ERRORS = f"X AS (SELECT event_id, user_id AS analysis_id, ts, {TYPES} AS error_type, {SEVERITIES} AS severity, 'P' || CAST(event_id % 50 AS VARCHAR) AS nicad1, 'P' || CAST(event_id % 7 AS VARCHAR) AS nicad2 FROM events)"
ANALYSES = "A AS (SELECT analysis_id, min(ts) AS created, count(*) AS errors, count(*) * 10 + analysis_id % 7 AS features, CAST(analysis_id % 101 AS DOUBLE) AS score FROM X GROUP BY analysis_id)"
BOTH = f"{ERRORS}, {ANALYSES}"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS analysis_id", "ts", f"{TYPES} AS error_type", f"{SEVERITIES} AS severity", "'P' || CAST(event_id % 50 AS STRING) AS nicad1", "'P' || CAST(event_id % 7 AS STRING) AS nicad2")


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return _errors(spark, sf_dir).groupBy("analysis_id").agg(F.min("ts").alias("created"), n.alias("errors"), (n * 10 + F.col("analysis_id") % 7).alias("features"), (F.col("analysis_id") % 101).cast("double").alias("score"))


@query("SELECT analysis_id, errors, features, score FROM A ORDER BY created DESC, analysis_id LIMIT 20 OFFSET 20", "", BOTH)
def analyses_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page; its limit is the feature."""
    return listing.page(_analyses(spark, sf_dir), [F.desc("created"), F.col("analysis_id")], 20, 20).select("analysis_id", "errors", "features", "score")


@query("SELECT analysis_id, sum(n) AS errors, string_agg(error_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY error_type) AS by_type FROM (SELECT analysis_id, error_type, count(*) AS n FROM X GROUP BY 1, 2) GROUP BY analysis_id", "", BOTH)
def errors_by_analysis_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.counts_by_type(_errors(spark, sf_dir), "analysis_id")


@query("SELECT count(*) AS analyses, coalesce(sum(features), 0) AS features, coalesce(sum(errors), 0) AS errors, coalesce(floor(avg(score) * 10 + 0.5) / 10, 0) AS mean_score FROM A", "", BOTH)
def global_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.kpis(_analyses(spark, sf_dir))


@query("SELECT p AS period, count(*) AS errors FROM X, (SELECT max(ts) AS now FROM events) n, (SELECT unnest(['TODAY', 'WEEK', 'MONTH', 'ALL']) AS p) WHERE CASE p WHEN 'TODAY' THEN ts >= date_trunc('day', now) WHEN 'WEEK' THEN ts >= now - INTERVAL 7 DAY WHEN 'MONTH' THEN ts >= CAST(CAST(now AS DATE) - INTERVAL 1 MONTH AS TIMESTAMP) ELSE TRUE END GROUP BY p", "", BOTH)
def dashboard_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for all periods; "now" is the last event."""
    now = _errors(spark, sf_dir).agg(F.max("ts").alias("now"))
    rows = _errors(spark, sf_dir).select("ts").join(F.broadcast(now))
    periods = ["TODAY", "WEEK", "MONTH", "ALL"]
    hits = F.array_compact(F.array(*[F.when(listing.in_period(F.col("ts"), p, F.col("now")), p) for p in periods]))
    return rows.select(F.explode(hits).alias("period")).groupBy("period").agg(F.count("*").alias("errors"))


@query("SELECT * FROM (SELECT analysis_id, score FROM A ORDER BY analysis_id DESC LIMIT 20) ORDER BY analysis_id", "", BOTH)
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.trend(_analyses(spark, sf_dir), "analysis_id").select("analysis_id", "score")


@query("SELECT event_id, severity FROM X ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, event_id LIMIT 100", "", BOTH)
def errors_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top of the list in the order of severities; its limit is the feature."""
    return listing.page(_errors(spark, sf_dir), [quality.severity_rank(F.col("severity")), F.col("event_id")], 100).select("event_id", "severity")


@query("SELECT error_type, count(DISTINCT nicad) AS n FROM (SELECT error_type, nicad1 AS nicad FROM X UNION ALL SELECT error_type, nicad2 FROM X) GROUP BY error_type", "", BOTH)
def nicads_by_error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _errors(spark, sf_dir).select("error_type", F.explode(F.array("nicad1", "nicad2")).alias("nicad"))
    return both.distinct().groupBy("error_type").agg(F.count("*").alias("n"))


@query("SELECT nicad, min(event_id) AS first_error FROM (SELECT nicad1 AS nicad, event_id FROM X UNION ALL SELECT nicad2, event_id FROM X) GROUP BY nicad", "", BOTH)
def first_error_of_parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each parcel its first error on either side: a union in place of a join by OR."""
    e = _errors(spark, sf_dir)
    return e.select(F.col("nicad1").alias("nicad"), "event_id").unionByName(e.select(F.col("nicad2").alias("nicad"), "event_id")).groupBy("nicad").agg(F.min("event_id").alias("first_error"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), 'build') ORDER BY c_custkey DESC LIMIT 20")
def customer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over several columns, newest first."""
    c = table(spark, sf_dir, "customer")
    return listing.page(c.filter(listing.contains_any([F.col("c_name"), F.col("c_mktsegment")], "00012") | listing.contains_any([F.col("c_mktsegment")], "Build")), [F.desc("c_custkey")]).select("c_custkey")


@query("SELECT syscol, count(*) AS n FROM P GROUP BY syscol", "P")
def parcels_by_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.parcels(spark, sf_dir).groupBy("syscol").agg(F.count("*").alias("n"))


@query("SELECT c.syscol || ';' || CASE WHEN contains(c.nom, ';') THEN '\"' || c.nom || '\"' ELSE c.nom END || ';' || CAST(coalesce(n, 0) AS VARCHAR) AS line FROM C13 c LEFT JOIN (SELECT syscol, count(*) AS n FROM P GROUP BY syscol) p ON p.syscol = c.syscol", "C13 P")
def communes_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the export of communes with their numbers of parcels, 0 where none."""
    n = fx.parcels(spark, sf_dir).groupBy("syscol").agg(F.count("*").alias("n"))
    rows = fx.communes_2013(spark, sf_dir).join(n, "syscol", "left")
    return rows.select(listing.csv_line([F.col("syscol"), F.col("nom"), F.coalesce("n", F.lit(0))]).alias("line"))


@query("SELECT feature_idx, rpad(left(nicad_raw, 16), 16, ' ') || rpad(syscol, 8, ' ') || rpad(section, 3, ' ') || rpad(parcelle, 5, ' ') AS record FROM P", "P")
def dbf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.parcels(spark, sf_dir).select("feature_idx", listing.dbf_record([(F.col("nicad_raw"), 16), (F.col("syscol"), 8), (F.col("section"), 3), (F.col("parcelle"), 5)]).alias("record"))


@query("SELECT '# Rapport' || chr(10) || chr(10) || '| type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || error_type || ' | ' || CAST(n AS VARCHAR) || ' |', chr(10) ORDER BY error_type) AS report FROM (SELECT error_type, count(*) AS n FROM X GROUP BY error_type)", "", BOTH)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.markdown_report(_errors(spark, sf_dir).groupBy("error_type").agg(F.count("*").alias("n")), "Rapport")


@query("SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y, sum((x1 - x0) * (y1 - y0)) AS area, floor(avg((x1 - x0) * (y1 - y0)) * 1000 + 0.5) / 1000 AS mean_area FROM P", "P")
def layer_extent_and_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return fx.parcels(spark, sf_dir).agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"), F.sum(area).alias("area"), half_up(F.avg(area), 3).alias("mean_area"))


@query("SELECT name, row_number() OVER (ORDER BY rank, name) AS position FROM (SELECT DISTINCT name, CASE name WHEN 'nicad' THEN 1 WHEN 'section' THEN 2 ELSE 3 END AS rank FROM (SELECT unnest(['nicad', 'section', CASE WHEN feature_idx % 2 = 0 THEN 'zone' ELSE 'bloc' END]) AS name FROM P WHERE feature_idx < 200))", "P")
def attribute_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the attribute table from the first 200 rows, as the feature is."""
    props = F.create_map(F.lit("nicad"), F.col("nicad_raw"), F.lit("section"), F.col("section"), F.lit("_row"), F.lit("1"), F.when(F.col("feature_idx") % 2 == 0, "zone").otherwise("bloc"), F.lit("x"))
    return listing.attribute_columns(fx.parcels(spark, sf_dir).withColumn("props", props), "props", ["nicad", "section"])


@query("SELECT feature_idx FROM P WHERE contains(lower(nicad_raw), '0143') AND (section = '003' OR contains(lower(nicad_raw), '99'))", "P")
def property_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("a"), F.col("nicad_raw"), F.lit("b"), F.lit(None).cast("string"))
    rows = fx.parcels(spark, sf_dir).withColumn("props", props)
    return rows.filter(listing.any_property_contains(F.col("props"), "0143") & ((F.col("section") == "003") | listing.any_property_contains(F.col("props"), "99"))).select("feature_idx")


@query("SELECT feature_idx, CASE WHEN nicad_raw = syscol || section || parcelle THEN '' ELSE 'nicad' END || CASE WHEN section = '001' THEN '' WHEN nicad_raw = syscol || section || parcelle THEN 'section' ELSE ',section' END AS changed FROM P", "P")
def attribute_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.create_map(F.lit("nicad"), F.col("nicad_raw"), F.lit("section"), F.col("section"))
    b = F.create_map(F.lit("nicad"), F.concat("syscol", "section", "parcelle"), F.lit("section"), F.lit("001"))
    return fx.parcels(spark, sf_dir).select("feature_idx", F.array_join(listing.attribute_diff(a, b), ",").alias("changed"))


@query("SELECT feature_idx, row_number() OVER (ORDER BY feature_idx) - 1 AS position FROM P WHERE feature_idx % 4 <> 2", "P")
def delete_and_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows less some positions, numbered anew by ranges, so that no task numbers all rows."""
    parcels = fx.parcels(spark, sf_dir)
    gone = parcels.filter("feature_idx % 4 = 2").select("feature_idx")
    return listing.renumbered(parcels.join(gone, "feature_idx", "left_anti"), "feature_idx").select("feature_idx", "position")


@query("SELECT name, count(*) AS n, place FROM customer JOIN (VALUES (0, 'zèbre', 9), (1, 'Zone', 10), (2, 'école', 7), (3, 'Ecole', 6), (4, 'ecole', 5), (5, 'Abbé', 2), (6, 'abbe', 1), (7, 'côte', 4), (8, 'cote', 3), (9, 'Été', 8)) AS v(k, name, place) ON k = c_custkey % 10 GROUP BY name, place")
def names_in_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with accents and in both cases, each with its place among them; their order of bytes would be another."""
    names = F.array(*map(F.lit, ["zèbre", "Zone", "école", "Ecole", "ecole", "Abbé", "abbe", "côte", "cote", "Été"]))
    rows = table(spark, sf_dir, "customer").groupBy(F.get(names, (F.col("c_custkey") % 10).cast("int")).alias("name")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(listing.locale_order(F.col("name")))))  # a few names
