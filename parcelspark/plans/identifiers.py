"""Queries over identifiers, numbering and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.functions import nicad as nic
from parcelspark.functions.text import MARKED, PLAIN, label_kind, layer_text, name_key, text_lines
from parcelspark.operators import cad, quality, registry
from parcelspark.plans.registry import query, table

# The cleaned identifier and what is wrong with it, in SQL.
CLEAN = r"regexp_replace(nicad_raw, '[\s\-_·]', '', 'g')"
V = rf"""V AS (SELECT *, {CLEAN} AS c FROM P), W AS (SELECT *, CASE WHEN c = '' THEN 'empty'
 WHEN NOT regexp_full_match(c, '[0-9]+') OR length(c) <> 16 THEN concat_ws(',', CASE WHEN NOT regexp_full_match(c, '[0-9]+') THEN 'not_numeric' END, CASE WHEN length(c) <> 16 THEN 'length' END)
 ELSE concat_ws(',', CASE WHEN substr(c, 1, 8) = '00000000' THEN 'syscol_zero' END, CASE WHEN substr(c, 9, 3) = '000' THEN 'section_zero' END) END AS errors FROM V)"""
MISSING = "(lower(trim(nicad_raw)) IN (" + ", ".join(f"'{m}'" for m in nic.MISSING) + "))"


@query("SELECT feature_idx, errors = '' AS valid, errors, CASE WHEN regexp_full_match(c, '[0-9]{11}00000') THEN 'parcel_zero' END AS warning FROM W", "P", V)
def nicad_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("nicad_raw")
    return fx.parcels(spark, sf_dir).select("feature_idx", nic.is_valid(raw).alias("valid"), F.array_join(nic.errors(raw), ",").alias("errors"), nic.warning(raw).alias("warning"))


@query("SELECT feature_idx, substr(c, 1, 8) AS syscol, substr(c, 9, 3) AS section, substr(c, 12, 5) AS parcelle FROM W WHERE errors = ''", "P", V)
def nicad_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("nicad_raw")
    return fx.parcels(spark, sf_dir).filter(nic.is_valid(raw)).select("feature_idx", nic.syscol_of(raw).alias("syscol"), nic.section_of(raw).alias("section"), nic.parcel_of(raw).alias("parcelle"))


@query("SELECT feature_idx, CASE WHEN length(nicad_raw) = 16 THEN substr(nicad_raw, 1, 8) || ' · ' || substr(nicad_raw, 9, 3) || ' · ' || substr(nicad_raw, 12, 5) ELSE nicad_raw END AS display, CASE WHEN length(nicad_raw) = 16 THEN substr(nicad_raw, 1, 8) || '-' || substr(nicad_raw, 9, 3) || '-' || substr(nicad_raw, 12, 5) ELSE nicad_raw END AS hyphened FROM P", "P")
def nicad_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("nicad_raw")
    return fx.parcels(spark, sf_dir).select("feature_idx", nic.joined(raw, " · ").alias("display"), nic.joined(raw, "-").alias("hyphened"))


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT {MISSING} AND length(trim(nicad_raw)) >= 8) AS with_nicad, count(*) FILTER ({MISSING} OR length(trim(nicad_raw)) < 8) AS without_nicad, count(*) FILTER (NOT {MISSING} AND length(trim(nicad_raw)) BETWEEN 1 AND 7) AS short_nicad, count(*) FILTER (NOT {MISSING} AND length(trim(nicad_raw)) = 16) AS valid_16, count(*) FILTER (NOT {MISSING} AND length(trim(nicad_raw)) > 0 AND length(trim(nicad_raw)) <> 16) AS invalid_length FROM P", "P")
def nicad_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.nicad_counters(fx.parcels(spark, sf_dir))


@query(f"SELECT feature_idx, 'missing_nicad' AS error_type, 'critical' AS severity FROM P WHERE {MISSING} OR length(trim(nicad_raw)) < 8", "P")
def nicad_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_nicad(fx.parcels(spark, sf_dir)).select("feature_idx", "error_type", "severity")


DUPLICATES = f"G AS (SELECT feature_idx, trim(nicad_raw) AS nicad, count(*) OVER (PARTITION BY trim(nicad_raw)) AS occurrences, min(feature_idx) OVER (PARTITION BY trim(nicad_raw)) AS first_idx FROM P WHERE NOT {MISSING} AND length(trim(nicad_raw)) >= 8)"


@query("SELECT feature_idx, nicad, occurrences, first_idx FROM G WHERE occurrences > 1", "P", DUPLICATES)
def nicad_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(fx.parcels(spark, sf_dir)).select("feature_idx", "nicad", "occurrences", "first_idx")


@query("SELECT nicad, count(*) AS occurrences, string_agg(CAST(feature_idx AS VARCHAR), ', ' ORDER BY feature_idx) AS object_ids FROM G WHERE occurrences > 1 GROUP BY nicad", "P", DUPLICATES)
def nicad_duplicate_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_listing(fx.parcels(spark, sf_dir))


EXPECTED = """A AS (SELECT feature_idx, errors, CASE WHEN errors <> '' THEN errors ELSE concat_ws(',',
 CASE WHEN substr(c, 1, 8) <> CASE WHEN feature_idx % 3 = 0 THEN '01430199' ELSE syscol END THEN 'syscol_mismatch' END,
 CASE WHEN substr(c, 9, 3) <> CASE WHEN feature_idx % 5 = 0 THEN '009' ELSE section END THEN 'section_mismatch' END,
 CASE WHEN substr(c, 12, 5) <> parcelle THEN 'parcel_mismatch' END) END AS anomalies FROM W)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("feature_idx")
    syscol = F.when(idx % 3 == 0, "1430199").otherwise(F.col("syscol"))
    section = F.when(idx % 5 == 0, "9").otherwise(F.col("section"))
    return fx.parcels(spark, sf_dir).select("feature_idx", registry.anomalies(F.col("nicad_raw"), syscol, section, F.col("parcelle")).alias("anomalies"))


@query("SELECT feature_idx, anomalies = '' AS valid, anomalies FROM A", "P", f"{V}, {EXPECTED}")
def nicad_coherence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("feature_idx", (F.size("anomalies") == 0).alias("valid"), F.array_join("anomalies", ",").alias("anomalies"))


@query("SELECT anomaly, count(*) AS n FROM (SELECT unnest(string_split(anomalies, ',')) AS anomaly FROM A WHERE anomalies <> '') GROUP BY anomaly", "P", f"{V}, {EXPECTED}")
def nicad_audit_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select(F.explode("anomalies").alias("anomaly")).groupBy("anomaly").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (errors = '') AS valid, count(*) FILTER (errors <> '') AS invalid FROM W", "P", V)
def nicad_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = nic.is_valid(F.col("nicad_raw"))
    return fx.parcels(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))


REQUESTS = "SELECT c_custkey AS request_id, lpad(CAST(1430100 + c_custkey % 25 AS STRING), 8, '0') AS syscol, lpad(CAST(c_custkey % 7 AS STRING), 3, '0') AS section FROM customer"


@query("SELECT request_id, syscol, section, CAST(number AS BIGINT) AS number, syscol || section || lpad(CAST(number AS VARCHAR), 5, '0') AS nicad FROM (SELECT R.*, coalesce(m, 0) + row_number() OVER (PARTITION BY R.syscol, R.section ORDER BY request_id) AS number FROM R LEFT JOIN (SELECT syscol, section, max(CAST(parcelle AS BIGINT)) AS m FROM P GROUP BY 1, 2) u ON u.syscol = R.syscol AND u.section = R.section)", "P", f"R AS ({REQUESTS})")
def nicad_generate_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.sql(REQUESTS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return registry.next_numbers(requests, fx.parcels(spark, sf_dir))


LINES = "SELECT lpad(CAST(1430100 + l_suppkey % 25 AS STRING), 8, '0') AS syscol, lpad(CAST(l_orderkey % 7 AS STRING), 3, '0') AS section, lpad(CAST(l_orderkey % 991 + l_linenumber AS STRING), 5, '0') AS parcelle FROM lineitem"


@query("SELECT syscol, section, max(n) AS last_number FROM (SELECT syscol, section, CAST(max(parcelle) AS BIGINT) AS n FROM P GROUP BY 1, 2 UNION ALL SELECT syscol, section, CAST(max(parcelle) AS BIGINT) FROM R GROUP BY 1, 2) GROUP BY 1, 2", "P", f"R AS ({LINES})")
def last_num_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(LINES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return registry.largest_by_text(fx.parcels(spark, sf_dir), lines)


NEW_SYSCOL = "lpad(CAST(1430200 + feature_idx % 25 AS STRING), 8, '0')"


@query(f"SELECT feature_idx, CASE WHEN errors = '' THEN {NEW_SYSCOL} || substr(c, 9) END AS nicad_new FROM W", "P", V)
def basculement_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.parcels(spark, sf_dir).select("feature_idx", nic.switched(F.col("nicad_raw"), F.expr(NEW_SYSCOL)).alias("nicad_new"))


@query(f"SELECT feature_idx, CASE WHEN errors = '' THEN {NEW_SYSCOL} || '005' || lpad(CAST(feature_idx % 99999 AS VARCHAR), 5, '0') END AS nicad_new FROM W", "P", V)
def basculement_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.parcels(spark, sf_dir).select("feature_idx", nic.switched(F.col("nicad_raw"), F.expr(NEW_SYSCOL), F.lit(5), F.col("feature_idx") % 99999).alias("nicad_new"))


@query("SELECT request_id, nicad, nicad_new, CASE WHEN nicad_new IS NULL THEN 'invalid' WHEN nicad_new IN (SELECT nicad FROM X) OR place > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM (SELECT feature_idx AS request_id, nicad_raw AS nicad, nicad_new, row_number() OVER (PARTITION BY nicad_new ORDER BY feature_idx) AS place FROM (SELECT *, CASE WHEN errors = '' THEN lpad(CAST(1430200 + feature_idx % 3 AS VARCHAR), 8, '0') || substr(c, 9) END AS nicad_new FROM W))", "P", V + ", X AS (SELECT '01430200' || section || parcelle AS nicad FROM P WHERE feature_idx % 50 = 1)")
def basculement_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.parcels(spark, sf_dir)
    requests = p.select(F.col("feature_idx").alias("request_id"), F.col("nicad_raw").alias("nicad"), (1430200 + F.col("feature_idx") % 3).cast("string").alias("syscol_new"))
    existing = p.filter("feature_idx % 50 = 1").select(F.concat(F.lit("01430200"), "section", "parcelle").alias("nicad"))
    return registry.switch_batch(requests, existing)


RAW = "CASE l_linenumber % 5 WHEN 0 THEN 'Lot ' || CAST(l_partkey AS STRING) WHEN 1 THEN CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) WHEN 2 THEN 'sans' WHEN 3 THEN '' ELSE CAST(l_suppkey AS STRING) END"
KEYS = "l_orderkey, CAST(l_linenumber AS BIGINT) AS line"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS line", f"{RAW} AS raw")


D = f"D AS (SELECT {KEYS}, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM (SELECT *, {RAW} AS raw FROM lineitem))"


@query("SELECT l_orderkey, line, CASE WHEN d = '' THEN NULL WHEN length(d) <= 5 THEN lpad(d, 5, '0') ELSE right(d, 5) END AS number, CASE WHEN d = '' THEN 'none' WHEN length(d) = 5 THEN 'ok' WHEN length(d) < 5 THEN 'padded' ELSE 'truncated' END AS status FROM D", "", D)
def numero_parcelle_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, status = nic.parcel_number(F.col("raw"))
    return _lines(spark, sf_dir).select("l_orderkey", "line", number.alias("number"), status.alias("status"))


@query("SELECT l_orderkey, line, CASE WHEN d = '' THEN NULL ELSE lpad(right(d, 3), 3, '0') END AS section FROM D", "", D)
def section_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "line", nic.section_number(F.col("raw")).alias("section"))


@query("SELECT l_orderkey, line, CASE WHEN raw = '' THEN '' WHEN length(d) >= 8 THEN d ELSE lpad(d, 8, '0') END AS syscol, CASE WHEN d = '' THEN '' WHEN length(d) >= 8 THEN d ELSE lpad(d, 8, '0') END AS syscol_blank FROM D", "", D)
def syscol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "line", nic.syscol_number(F.col("raw")).alias("syscol"), nic.syscol_number(F.col("raw"), blank=True).alias("syscol_blank"))


UNMARKED = rf"regexp_replace(translate(translate(%s, '{MARKED}', '{PLAIN}'), '{MARKED.upper()}', '{PLAIN.upper()}'), '[\x{{0300}}-\x{{036F}}]', '', 'g')"


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace({UNMARKED % "lower(coalesce(text, ''))"}, '[^a-z0-9_\- ]', '_', 'g'), ' +', ' ', 'g')) AS normalized FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", layer_text(F.col("text")).alias("normalized"))


@query(f"SELECT syscol, upper(trim(regexp_replace({UNMARKED % "nom"}, '[^A-Za-z0-9]+', ' ', 'g'))) AS key FROM (SELECT syscol, 'Éva-' || nom || '  (Ñ)' AS nom FROM C26)", "C26")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.communes_2026(spark, sf_dir).select("syscol", name_key(F.concat(F.lit("Éva-"), "nom", F.lit("  (Ñ)"))).alias("key"))


def _classes() -> str:
    """The classification in SQL."""
    hay = f"trim(regexp_replace(regexp_replace({UNMARKED % "lower(layer)"}, '[^a-z0-9_\\- ]', '_', 'g'), ' +', ' ', 'g')) || ' ' || label"
    words = lambda names: "|".join(sorted({n.replace("â", "a") for n in names}))
    types = lambda c: "(" + ", ".join(f"'{t}'" for t in (cad.TEXT_TYPES if c in cad.TEXTS else cad.OUTLINE_TYPES)) + ")"
    fitting = " ".join(f"WHEN regexp_matches(hay, '{words(n)}') AND geom_type IN {types(c)} THEN '{c}'" for c, n in cad.NAMES.items())
    named = " ".join(f"WHEN regexp_matches(hay, '{words(n)}') THEN '{c}'" for c, n in cad.NAMES.items())
    fits = " OR ".join(f"(cls = '{c}' AND geom_type IN {types(c)})" for c in cad.NAMES)
    return f"H AS (SELECT *, {hay} AS hay FROM E), K AS (SELECT * FROM (SELECT *, CASE WHEN regexp_matches(hay, '{'|'.join(cad.EXCLUDED)}') THEN NULL {fitting} {named} END AS cls FROM H) WHERE {fits})"


@query("SELECT feature_idx, cls FROM K", "E", _classes())
def layer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cad.classified(fx.layers(spark, sf_dir)).select("feature_idx", "cls")


@query("SELECT cls, count(*) AS n FROM K GROUP BY cls", "E", _classes())
def layer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cad.audit(fx.layers(spark, sf_dir))


@query(f"SELECT feature_idx, cls FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY feature_idx) AS place FROM K) WHERE cls IN ({', '.join(repr(c) for c in cad.OUTLINES)}) OR place <= 20", "E", _classes())
def layer_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caps are the feature here."""
    return cad.capped(fx.layers(spark, sf_dir), 20, 20).select("feature_idx", "cls")


@query(f"SELECT feature_idx, '{cad.FALLBACK}' AS cls FROM E", "E")
def layer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers without a readable name are all kept."""
    rows = fx.layers(spark, sf_dir).withColumn("layer", F.lit("x1"))
    return cad.selected_or_all(rows).select("feature_idx", "cls")


KIND = r"CASE WHEN trim(label) = '' THEN 'denomination' WHEN regexp_matches(trim(label), '(?i)^(lot|tf|titre\s*foncier|parcelle|n)[°ºo.\s_-]*\d') THEN 'numero' WHEN len(regexp_extract_all(trim(label), '\d')) > 0 AND len(regexp_extract_all(trim(label), '\d')) >= len(regexp_extract_all(trim(label), '[a-zA-Z]')) THEN 'numero' ELSE 'denomination' END"


@query(f"SELECT label_idx, label, {KIND} AS kind FROM L", "L")
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.labels(spark, sf_dir).select("label_idx", "label", label_kind(F.col("label")).alias("kind"))


@query(r"SELECT label_idx, CAST(row_number() OVER (PARTITION BY label_idx ORDER BY pos) AS BIGINT) AS pos, trim(line) AS line FROM (SELECT label_idx, unnest(string_split(t, '\P')) AS line, generate_subscripts(string_split(t, '\P'), 1) AS pos FROM (SELECT label_idx, label || '\P \P' || CAST(label_idx AS VARCHAR) AS t FROM L)) WHERE trim(line) <> ''", "L")
def mtext_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.labels(spark, sf_dir).select("label_idx", text_lines(F.concat("label", F.lit(r"\P \P"), F.col("label_idx").cast("string"))).alias("lines"))
    return rows.select("label_idx", F.posexplode("lines").alias("p", "line")).select("label_idx", (F.col("p") + 1).cast("bigint").alias("pos"), "line")


@query(f"SELECT feature_idx, max(CASE WHEN kind = 'numero' AND place = 1 THEN label END) AS numero, max(CASE WHEN kind = 'denomination' AND place = 1 THEN label END) AS denomination, coalesce(string_agg(CASE WHEN place > 1 THEN label END, ' | ' ORDER BY label_idx), '') AS autres, count(*) AS n_labels FROM (SELECT *, row_number() OVER (PARTITION BY feature_idx, kind ORDER BY label_idx) AS place FROM (SELECT label_idx, trim(label) AS label, {KIND} AS kind, min(feature_idx) AS feature_idx FROM L JOIN P ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 WHERE trim(label) <> '' GROUP BY label_idx, label)) GROUP BY feature_idx", "P L")
def label_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cad.labelled_parcels(fx.labels(spark, sf_dir), fx.parcels(spark, sf_dir))
