"""Queries for keyed lookups and listings, filters of dashboards and maps, and the workflow around errors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions import geometry as geo
from parcelspark.functions import nicad as nic
from parcelspark.functions import text
from parcelspark.operators import correspondence as co
from parcelspark.operators import listing, lookups, registry
from parcelspark.plans.correspondence import RECOMPUTED, REGISTRY, _recomputed, _registry
from parcelspark.plans.listings import BOTH, _analyses, _errors
from parcelspark.plans.registry import query, table
from parcelspark.sources.tables import REGIONS, region_boxes

NAMED = "N AS (SELECT feature_idx, 'P' || CAST(feature_idx % 40 AS VARCHAR) AS nicad FROM P)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose identifiers are those that errors name, some of them several times."""
    return fx.parcels(spark, sf_dir).select("feature_idx", F.concat(F.lit("P"), (F.col("feature_idx") % 40).cast("string")).alias("nicad"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).withColumnRenamed("event_id", "error_id")


@query("SELECT feature_idx FROM G WHERE syscol = '01430103' AND section = '002' AND version = '2013'", "P", REGISTRY)
def parcels_of_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By unpadded keys."""
    return lookups.by_key(_registry(spark, sf_dir), "1430103", "2", version="2013").select("feature_idx")


@query("SELECT feature_idx, syscol FROM G WHERE syscol IN ('01430103', '01430107', '01430120')", "P", REGISTRY)
def parcels_of_communes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.of_communes(_registry(spark, sf_dir), ["1430103", "01430107", "1430120"]).select("feature_idx", "syscol")


@query("SELECT feature_idx FROM P WHERE feature_idx % 3 <> 0 ORDER BY syscol, feature_idx LIMIT 500", "P")
def parcels_with_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's limit is the feature."""
    rows = fx.parcels(spark, sf_dir).withColumn("geom", F.when(F.col("feature_idx") % 3 != 0, F.col("x0")))
    return lookups.with_geometry(rows, ["syscol", "feature_idx"]).select("feature_idx")


@query("SELECT DISTINCT region FROM C26", "C26")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.regions(fx.communes_2026(spark, sf_dir))


@query("SELECT syscol AS \"codSyscol\", nom, region, dept FROM C26 WHERE region = 'ASIA'", "C26")
def communes_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.light(lookups.of_region(fx.communes_2026(spark, sf_dir), "ASIA"))


@query("SELECT DISTINCT section FROM G WHERE syscol = '01430105' AND version = '2026'", "P", REGISTRY)
def sections_of_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.sections_of(_registry(spark, sf_dir), "1430105", "2026")


@query("SELECT feature_idx, nicad FROM G WHERE syscol = '01430111' AND nicad IS NOT NULL ORDER BY nicad, feature_idx LIMIT 50", "P", REGISTRY)
def nicads_of_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In natural order; the limit is the feature."""
    rows = lookups.by_key(_registry(spark, sf_dir), "1430111").filter("nicad is not null")
    return listing.page(rows, [F.col("nicad"), F.col("feature_idx")], 50).select("feature_idx", "nicad")


@query("SELECT DISTINCT syscol, section, EXISTS (SELECT 1 FROM P k WHERE k.feature_idx % 4 = 0 AND k.syscol = q.syscol AND k.section = q.section) AS found FROM P q", "P")
def section_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.parcels(spark, sf_dir)
    return lookups.exists(p.select("syscol", "section").distinct(), p.filter("feature_idx % 4 = 0"), ["syscol", "section"])


@query("SELECT code, s13 AS from_code, s26 AS to_code, type_changement, statut FROM (SELECT s26 AS code, *, row_number() OVER (PARTITION BY s26 ORDER BY s13 DESC) AS place FROM R WHERE s26 IS NOT NULL) WHERE place = 1", "C13 C26", RECOMPUTED)
def changes_by_new_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.changes_by_code(_recomputed(spark, sf_dir), "s26")


@query("SELECT s13 AS code, s13 AS from_code, s26 AS to_code, type_changement, statut FROM R", "C13 C26", RECOMPUTED)
def changes_by_old_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.changes_by_code(_recomputed(spark, sf_dir), "s13")


@query("SELECT type_changement, count(*) AS n FROM R GROUP BY type_changement", "C13 C26", RECOMPUTED)
def changes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent first."""
    return _recomputed(spark, sf_dir).groupBy("type_changement").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type_changement")


@query("SELECT count(*) AS communes, coalesce(sum(n), 0) AS parcels FROM (SELECT R.s13, count(*) AS n FROM R JOIN G ON G.syscol = R.s13 WHERE R.s26 IS NOT NULL AND R.statut <> 'sans_correspondance' AND G.version = '2013' AND G.statut = 'actif' GROUP BY R.s13)", "C13 C26 P", f"{RECOMPUTED}, {REGISTRY}")
def migration_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a migration would move."""
    found = co.preview(_recomputed(spark, sf_dir), _registry(spark, sf_dir))
    return found.agg(F.count("*").alias("communes"), F.coalesce(F.sum("n_parcels"), F.lit(0)).alias("parcels"))


@query("SELECT R.s13, R.s26, count(*) AS n_parcels FROM R JOIN G ON G.syscol = R.s13 WHERE R.s13 = '01430107' AND R.s26 IS NOT NULL AND R.statut <> 'sans_correspondance' AND G.version = '2013' AND G.statut = 'actif' GROUP BY R.s13, R.s26", "C13 C26 P", f"{RECOMPUTED}, {REGISTRY}")
def migration_preview_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commune's parcels, before they are moved."""
    return co.preview(_recomputed(spark, sf_dir), _registry(spark, sf_dir), "1430107").select("s13", "s26", "n_parcels")


@query("SELECT s13, nom13, s26 FROM R WHERE contains(lower(nom13), 'a') OR contains(s13, 'A') OR contains(lower(coalesce(nom26, '')), 'a') OR contains(coalesce(s26, ''), 'A') ORDER BY region NULLS LAST, nom13 LIMIT 10 OFFSET 2", "C13 C26", RECOMPUTED)
def correspondence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search with many hits; its limit is the feature."""
    found = co.search(_recomputed(spark, sf_dir), "A")
    return listing.page(found, [F.asc_nulls_last("region"), F.col("nom13")], 10, 2).select("s13", "nom13", "s26")


STATES = "CASE analysis_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'PROCESSING' END"


@query(f"SELECT analysis_id, score FROM (SELECT *, 'Fichier ' || analysis_id AS name, {STATES} AS status FROM A) WHERE contains(lower(name), 'er 1') AND status = 'COMPLETED' AND score >= 70", "", BOTH)
def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _analyses(spark, sf_dir).withColumns({"name": F.concat(F.lit("Fichier "), F.col("analysis_id").cast("string")), "status": F.expr(STATES)})
    return lookups.by_conformity(rows, "ER 1", "COMPLETED", "GOOD").select("analysis_id", "score")


@query("SELECT feature_idx FROM N WHERE nicad IN (SELECT nicad1 FROM X WHERE error_type = 'GAP') OR nicad IN (SELECT nicad2 FROM X WHERE error_type = 'GAP')", "P", f"{BOTH}, {NAMED}")
def features_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.with_errors(_named(spark, sf_dir), _errors(spark, sf_dir).filter("error_type = 'GAP'")).select("feature_idx")


@query("SELECT event_id FROM X WHERE error_type IN ('GAP', 'SLIVER', 'OVERLAP') AND error_type <> 'SLIVER'", "", BOTH)
def errors_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.of_types(_errors(spark, sf_dir), ["gap", "sliver", "overlap"], ["SLIVER"]).select("event_id")


@query("SELECT event_id AS error_id, a.idx AS first_idx, b.idx AS second_idx, coalesce(a.n, 0) + coalesce(b.n, 0) AS features FROM X LEFT JOIN (SELECT nicad, max(feature_idx) AS idx, count(*) AS n FROM N GROUP BY nicad) a ON a.nicad = nicad1 LEFT JOIN (SELECT nicad, max(feature_idx) AS idx, count(*) AS n FROM N GROUP BY nicad) b ON b.nicad = nicad2", "P", f"{BOTH}, {NAMED}")
def errors_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some errors name identifiers that no feature has."""
    return lookups.errors_with_features(_numbered(spark, sf_dir), _named(spark, sf_dir))


@query("SELECT analysis_id, score, (SELECT count(*) FROM X WHERE X.analysis_id = A.analysis_id AND severity = 'HIGH') AS n_children, (SELECT max(event_id) FROM X WHERE X.analysis_id = A.analysis_id AND severity = 'HIGH') AS last_child FROM A", "", BOTH)
def analyses_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = _errors(spark, sf_dir).filter("severity = 'HIGH'")
    return lookups.with_children(_analyses(spark, sf_dir).select("analysis_id", "score"), high, "analysis_id", "event_id")


@query("SELECT nicad1 AS nicad, CAST(count(*) AS INTEGER) AS n_errors, string_agg(error_type || ':' || severity, ',' ORDER BY event_id) AS errors FROM X GROUP BY nicad1", "", BOTH)
def error_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.error_index(_numbered(spark, sf_dir))


@query("SELECT error_type, count(DISTINCT nicad) AS parcels FROM (SELECT error_type, nicad1 AS nicad FROM X UNION ALL SELECT error_type, nicad2 FROM X) WHERE nicad IN (SELECT nicad FROM N) GROUP BY error_type", "P", f"{BOTH}, {NAMED}")
def parcels_by_error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.parcels_by_type(_errors(spark, sf_dir), _named(spark, sf_dir))


@query("SELECT 0 AS part, error_type || ' ' || severity || ' ' || count(*) AS line FROM X GROUP BY error_type, severity UNION ALL SELECT 1, line FROM (SELECT event_id || ' ' || error_type || ' ' || nicad1 AS line FROM X ORDER BY event_id LIMIT 50)", "", BOTH)
def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chat about a layer is told; its first fifty errors are the feature."""
    return lookups.chat_context(_numbered(spark, sf_dir))


@query("SELECT c_custkey AS analysis_id, CASE WHEN c_custkey % 5 = 0 THEN 'corrected' WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'inline' END AS layer, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'inline' END AS original FROM customer")
def stored_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers by key: corrected, stored under new or old names, or kept inline."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    name = k.cast("string")
    files = c.filter("c_custkey % 3 = 0").select(F.when(k % 2 == 0, F.concat(F.lit("geo/"), name)).otherwise(name).alias("path"), F.col("c_name").alias("content"))
    asked = c.select(k.alias("analysis_id"), F.when(k % 4 == 0, F.concat(F.lit("geo/"), name)).otherwise(name).alias("key"), F.when(k % 5 == 0, "corrected").alias("corrected"), F.when(k % 2 == 0, "inline").alias("inline"))
    return lookups.stored_layer(asked, files)


@query("SELECT e AS error_id, CASE WHEN k % 3 = 0 THEN (SELECT min(feature_idx) FROM N WHERE nicad = 'P' || k % 40) ELSE (SELECT min(feature_idx) FROM P WHERE x >= x0 AND x <= x1 AND y >= y0 AND y <= y1) END AS feature_idx FROM (SELECT label_idx AS e, label_idx AS k, x, y FROM L)", "P L", NAMED)
def found_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors find their features by identifier, or by place where they only have a number or an identifier that is gone."""
    k = F.col("label_idx")
    name = F.when(k % 3 == 0, F.concat(F.lit("P"), (k % 40).cast("string"))).when(k % 3 == 1, F.concat(F.lit("feature_"), k.cast("string"))).otherwise("gone")
    errors = fx.labels(spark, sf_dir).select(k.alias("error_id"), name.alias("nicad1"), "x", "y")
    features = fx.parcels(spark, sf_dir).select("feature_idx", "x0", "y0", "x1", "y1").join(_named(spark, sf_dir), "feature_idx")
    return lookups.found_features(errors, features)


@query("SELECT feature_idx AS error_id, CASE WHEN feature_idx % 3 > 0 THEN feature_idx END AS found_idx FROM P WHERE feature_idx % 10 < 5", "P")
def found_by_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors find the first feature of an equal outline: half of the parcels, two thirds of them with their own outline, the others a metre off; each outline is there twice."""
    k = F.col("feature_idx")
    rows = fx.parcels(spark, sf_dir).select("feature_idx", geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"))
    moved = F.transform("ring", lambda p: F.transform(p, lambda v: v + F.when(k % 3 == 0, 0.25).otherwise(1e-9)))
    errors = rows.filter("feature_idx % 10 < 5").select(k.alias("error_id"), moved.alias("ring"))
    copies = rows.unionByName(rows.withColumn("feature_idx", k + 10_000_000))
    return lookups.found_by_geometry(errors, copies).withColumnRenamed("feature_idx", "found_idx")


@query("SELECT feature_idx, lpad(syscol, 8, '0') || lpad(CAST(feature_idx % 100 AS VARCHAR), 3, '0') AS prefix, CASE WHEN length(nicad_raw) = 16 THEN substr(nicad_raw, 1, 8) WHEN length(nicad_raw) = 18 THEN substr(nicad_raw, 1, 8) END AS syscol, CASE WHEN length(nicad_raw) = 16 THEN substr(nicad_raw, 12, 5) WHEN length(nicad_raw) = 18 THEN substr(nicad_raw, 14, 5) END AS num_parcelle FROM P", "P")
def identifier_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that a card shows, and a section's prefix."""
    rows = lookups.card(fx.parcels(spark, sf_dir), "nicad_raw")
    return rows.select("feature_idx", nic.section_prefix(F.col("syscol"), (F.col("feature_idx") % 100).cast("string")).alias("prefix"), "card.syscol", "card.num_parcelle")


@query("SELECT feature_idx, rpad(substr(syscol, 1, CAST(feature_idx % 9 AS INTEGER)), 8, '0') AS prefix, CASE WHEN feature_idx % 4 > 0 THEN rpad(substr(syscol, 1, CAST(feature_idx % 9 AS INTEGER)), 8, '0') || CASE WHEN feature_idx % 5 = 0 THEN '000' ELSE section END || parcelle END AS nicad FROM P", "P")
def nicad_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of any length, missing sections, and parcels without a number."""
    k = F.col("feature_idx")
    prefix = nic.prefix_of(F.substring("syscol", F.lit(1), (k % 9).cast("int")))
    return fx.parcels(spark, sf_dir).select("feature_idx", prefix.alias("prefix"), nic.built(prefix, F.when(k % 5 != 0, F.col("section")), F.when(k % 4 > 0, F.col("parcelle"))).alias("nicad"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'nic' WHEN 2 THEN '' ELSE '' END AS map_nicad, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'nic' ELSE '' END AS leaflet_nicad, CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE '' END AS section, CASE WHEN c_custkey % 4 = 3 THEN 'r' ELSE '' END AS region, CASE WHEN c_custkey % 4 = 3 THEN 'd2' ELSE '' END AS departement, CASE WHEN c_custkey % 4 = 3 THEN 'r' ELSE '' END AS commune_region, CASE c_custkey % 4 WHEN 0 THEN '12.5' ELSE '' END AS superficie, CASE c_custkey % 4 WHEN 1 THEN c_name ELSE '' END AS proprietaire, CASE c_custkey % 4 WHEN 1 THEN 'q' ELSE '' END AS quartier FROM customer")
def import_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of sections, communes and parcels under the first of their names that a file has."""
    k = F.col("c_custkey")
    entry = lambda *pairs: F.create_map(*[F.lit(v) if isinstance(v, str) else v for p in pairs for v in p])
    name = F.col("c_name")
    props = F.when(k % 4 == 0, entry(("nicad", "later"), ("NICAD", name), ("superficie", "7"), ("SupReelle", "12.5"))).when(k % 4 == 1, entry(("Nicad", "last"), ("NIC", "nic"), ("nomProprietaire", "later"), ("Occupant", name), ("quartier", "q"))).when(k % 4 == 2, entry(("CODIF", "other"))).otherwise(entry(("NUMSECT", name), ("region", "r"), ("departement", "d1"), ("DEPARTEMEN", "d2")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", props.alias("props"))
    section, commune, parcel = (nic.attributes(F.col("props"), names) for names in (nic.SECTION, nic.COMMUNE_2026, nic.PARCEL))
    return rows.select("c_custkey", nic.first_of(F.col("props"), nic.MAP_NICAD).alias("map_nicad"), nic.first_of(F.col("props"), nic.LEAFLET_NICAD).alias("leaflet_nicad"), section["numero"].alias("section"), section["region"], commune["departement"], commune["region"].alias("commune_region"), parcel["superficie"], parcel["proprietaire"], parcel["quartier"])


@query("SELECT c_custkey, 'a_b_' || c_custkey || '.zip' AS file, 'COMMUNE_N__' || c_custkey AS folder, CASE WHEN c_custkey % 2 = 0 THEN 'u1' ELSE 'anon' END || '_1704067200123_x_' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.geojson' WHEN c_custkey % 3 = 1 THEN '.geojson' ELSE '.kml.geojson' END AS stored FROM customer")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made safe for disks."""
    k = F.col("c_custkey")
    number = k.cast("string")
    ending = F.when(k % 3 == 0, ".ZIP").when(k % 3 == 1, ".geojson").otherwise(".kml")
    at = F.timestamp_millis(F.lit(1704067200123))
    return table(spark, sf_dir, "customer").select("c_custkey", text.file_name(F.concat(F.lit("/tmp/x/a b_"), number, F.lit(".zip"))).alias("file"), text.folder_name(F.concat(F.lit("Commune n° "), number)).alias("folder"), text.stored_name(F.when(k % 2 == 0, "u1"), at, F.concat(F.lit("x "), number, ending)).alias("stored"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Rapport d''Expert — ' WHEN 1 THEN 'Rapport Détaillé — ' ELSE 'Rapport Résumé — ' END || event_type AS title, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(date_part('millisecond', ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, strftime(ts, '%Y%m%d') AS stamp, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000 AS ms FROM events")
def report_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by kind of report, and time stamps in the forms that files and lists have."""
    kind = F.when(F.col("event_id") % 3 == 0, "EXPERT").when(F.col("event_id") % 3 == 1, "DETAILED").otherwise("SUMMARY")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", text.report_title(kind, F.col("event_type")).alias("title"), text.iso(ts).alias("iso"), F.date_format(ts, "yyyyMMdd").alias("stamp"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.unix_millis(ts).alias("ms"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS a, c_mktsegment AS b, CASE WHEN c_custkey % 3 = 0 THEN 'true' END AS auto, 'é' || c_name AS decoded FROM customer")
def property_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties with others laid over them, and a text that came in base64."""
    k = F.col("c_custkey")
    props = F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.col("c_mktsegment"))
    more = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("auto"), F.lit("true")))
    coded = F.concat(F.when(k % 2 == 0, "data:text/plain;base64,").otherwise(""), F.base64(F.encode(F.concat(F.lit("é"), "c_name"), "UTF-8")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.overridden(props, more).alias("p"), text.from_base64(coded).alias("decoded"))
    return rows.select("c_custkey", *[F.try_element_at("p", F.lit(c)).alias(c) for c in ("a", "b", "auto")], "decoded")


@query("SELECT c_custkey AS request_id, lpad(CAST(1430100 + c_custkey % 30 AS VARCHAR), 8, '0') AS syscol, lpad(CAST(c_custkey % 9 AS VARCHAR), 3, '0') AS section, CASE WHEN c_custkey % 30 >= 25 THEN 'commune' WHEN EXISTS (SELECT 1 FROM P WHERE P.syscol = lpad(CAST(1430100 + c_custkey % 30 AS VARCHAR), 8, '0') AND P.section = lpad(CAST(c_custkey % 9 AS VARCHAR), 3, '0')) OR c_custkey > min(c_custkey) OVER (PARTITION BY c_custkey % 30, c_custkey % 9) THEN 'exists' ELSE 'ok' END AS status FROM customer", "P")
def create_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(k.alias("request_id"), (1430100 + k % 30).cast("string").alias("syscol"), (k % 9).cast("string").alias("section"))
    return registry.new_sections(requests, fx.communes_2013(spark, sf_dir), fx.parcels(spark, sf_dir))


@query("SELECT c_custkey AS op_id, c_mktsegment AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'en_cours' WHEN c_custkey % 3 = 0 THEN 'echec' ELSE 'succes' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey * 2 END AS ok, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 = 0 THEN 1 ELSE 0 END AS failed FROM customer")
def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    turns = F.explode(F.array(F.lit(1), F.lit(2)))
    closed = c.filter("c_custkey % 4 > 0").select(k.alias("op_id"), turns.alias("pos"), k.alias("k")).select("op_id", "pos", (F.col("k") * F.col("pos")).alias("ok"), F.when(F.col("k") % 3 == 0, F.col("pos") - 1).otherwise(0).cast("bigint").alias("failed"))
    return registry.operation_log(c.select(k.alias("op_id"), F.col("c_mktsegment").alias("kind")), closed)


@query("SELECT s13, CASE WHEN s13 = '99999999' THEN '' ELSE nom13 END AS nom13, CASE WHEN k THEN 'X' ELSE s26 END AS s26, region, CASE WHEN s13 = '99999999' THEN 'provisoire' WHEN k THEN 'confirme' ELSE statut END AS statut FROM (SELECT s13, nom13, s26, region, statut, s13 LIKE '%5' AS k FROM R UNION ALL SELECT '99999999', NULL, 'X', NULL, NULL, TRUE)", "C13 C26", RECOMPUTED)
def correspondence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that exist only target, its name, status and notes change; a new row comes whole, with what it lacks by default."""
    rows = _recomputed(spark, sf_dir).select("s13", "nom13", "s26", "nom26", "region", "statut", "notes")
    changes = rows.filter("s13 like '%5'").select("s13", F.lit("Y").alias("nom13"), F.lit("X").alias("s26"), F.lit("N").alias("nom26"), F.lit("Z").alias("region"), F.lit("confirme").alias("statut"), F.lit(None).cast("string").alias("notes"), F.lit(1).alias("pos"))
    new = rows.limit(1).select(F.lit("99999999").alias("s13"), F.lit(None).cast("string").alias("nom13"), F.lit("X").alias("s26"), F.lit(None).cast("string").alias("nom26"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("statut"), F.lit(None).cast("string").alias("notes"), F.lit(1).alias("pos"))
    out = registry.update_fields(rows, changes.unionByName(new), "s13", ["s26", "nom26", "statut", "notes"], {"nom13": F.lit(""), "statut": F.lit("provisoire")})
    return out.select("s13", "nom13", "s26", "region", "statut")


@query("SELECT event_id, error_type, confidence, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 100) + 1 AS BIGINT) AS batch FROM (SELECT event_id, error_type, CASE WHEN event_id % 2 = 0 THEN '0.9' ELSE '1.0' END AS confidence FROM X WHERE event_id % 3 <> 1)", "", BOTH)
def error_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as they are inserted, a hundred at a time."""
    rows = _errors(spark, sf_dir).filter("event_id % 3 <> 1").select("event_id", F.upper(F.lower("error_type")).alias("error_type"), F.when(F.col("event_id") % 2 == 0, 0.9).otherwise(1.0).cast("string").alias("confidence"))
    return registry.batches(rows, "event_id", 100).select("event_id", "error_type", "confidence", "batch")


@query("SELECT analysis_id, (SELECT count(*) FROM X WHERE X.analysis_id = A.analysis_id AND event_id % 2 = 0) AS errors, (SELECT count(*) FROM X WHERE X.analysis_id = A.analysis_id AND event_id % 5 = 0) AS reports, (SELECT count(*) FROM X WHERE X.analysis_id = A.analysis_id AND event_id % 7 = 0) AS chats, (SELECT count(*) FROM X WHERE X.analysis_id = A.analysis_id AND event_id % 11 = 0) AS overlaps, (SELECT count(*) FROM X WHERE X.analysis_id = A.analysis_id AND event_id % 13 = 0) AS results, (SELECT count(*) FROM X WHERE X.analysis_id = A.analysis_id AND event_id % 17 = 0) AS operations FROM A", "", BOTH)
def dependent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six child tables that a deletion would take along."""
    e = _errors(spark, sf_dir)
    return registry.dependents(_analyses(spark, sf_dir), {name: e.filter(F.col("event_id") % n == 0) for name, n in (("errors", 2), ("reports", 5), ("chats", 7), ("overlaps", 11), ("results", 13), ("operations", 17))}, "analysis_id")


@query("SELECT CAST(place AS VARCHAR) || ',' || nicad || ',' || CAST(feature_idx AS VARCHAR) AS line FROM (SELECT *, row_number() OVER (ORDER BY feature_idx) AS place FROM N WHERE nicad IN (SELECT nicad1 FROM X WHERE error_type = 'GAP'))", "P", f"{BOTH}, {NAMED}")
def filtered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the attribute table as filtered, with the number of the row."""
    rows = _named(spark, sf_dir).join(_errors(spark, sf_dir).filter("error_type = 'GAP'").select(F.col("nicad1").alias("nicad")).distinct(), "nicad", "left_semi")
    number = (F.col("position") + 1).cast("string")
    return listing.renumbered(rows, "feature_idx").select(listing.csv_line([number, F.col("nicad"), F.col("feature_idx").cast("string")], ",").alias("line"))


@query("SELECT analysis_id FROM A ORDER BY analysis_id LIMIT 100 OFFSET (SELECT greatest(0, least(50, CAST(ceil(count(*) / 100.0) AS BIGINT) - 1)) * 100 FROM A)", "", BOTH)
def last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond the last one is the last one."""
    return listing.clamped_page(_analyses(spark, sf_dir).select("analysis_id"), [F.col("analysis_id")], 100, 50)


_BOXES = ", ".join(f"('{name}', '{code}', {x0}, {x1}, {y0}, {y1})" for name, code, x0, x1, y0, y1 in REGIONS)


@query(f"SELECT code, name, count(lon) AS n, CAST(coalesce(sum(c_custkey), 0) AS BIGINT) AS ids FROM (VALUES {_BOXES}) AS r(name, code, x0, x1, y0, y1) LEFT JOIN (SELECT c_custkey, CAST(-18.0 + (c_custkey % 700) * 0.01 AS DOUBLE) AS lon, CAST(12.0 + (c_custkey % 490) * 0.01 AS DOUBLE) AS lat FROM customer) AS c ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY code, name")
def static_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points lie in the box of each of the fourteen regions; boxes overlap, and some may have none."""
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(-18.0 + (c_custkey % 700) * 0.01 AS DOUBLE) AS lon", "CAST(12.0 + (c_custkey % 490) * 0.01 AS DOUBLE) AS lat")
    boxes = region_boxes(spark)  # fourteen rows
    inside = F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    found = points.join(F.broadcast(boxes), inside).groupBy("code").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"))
    zero = F.lit(0).cast("bigint")
    return boxes.join(found, "code", "left").select("code", "name", F.coalesce("n", zero).alias("n"), F.coalesce("ids", zero).alias("ids"))
