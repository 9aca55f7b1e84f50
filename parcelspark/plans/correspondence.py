"""Queries over the correspondence of two vintages of communes, and the migration along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import fixtures as fx
from parcelspark.operators import correspondence as co
from parcelspark.plans.registry import query

KEY = r"upper(trim(regexp_replace(translate(lower({0}), 'éèêàâç', 'eeeaac'), '[^a-z0-9]+', ' ', 'g')))"
#: The recomputed correspondence in SQL.
RECOMPUTED = f"""V AS (SELECT a.syscol AS s13, b.syscol AS s26, b.nom AS nom26, b.dept AS dept26,
 (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share
 FROM C13 a JOIN C26 b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
B AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s13 ORDER BY share DESC, s26) AS place FROM V) WHERE place = 1),
N AS (SELECT s13, count(*) FILTER (share >= 0.15) AS n_targets, string_agg(s26 || ':' || nom26 || ' (' || CAST(CAST(floor(share * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%)', ' | ' ORDER BY share DESC, s26) FILTER (share >= 0.15) AS targets FROM V GROUP BY s13),
M AS (SELECT s26, count(*) AS n_sources FROM B GROUP BY s26),
J AS (SELECT c.syscol AS s13, c.nom AS nom13, B.s26, B.nom26, c.region, c.dept AS dept13, B.dept26, coalesce(B.share, 0) AS share, coalesce(N.n_targets, 0) AS n_targets, coalesce(M.n_sources, 0) AS n_sources, N.targets,
 coalesce({KEY.format('c.nom')} <> '' AND {KEY.format('c.nom')} = {KEY.format('B.nom26')}, FALSE) AS same_name,
 coalesce({KEY.format('B.dept26')} <> '' AND {KEY.format('c.dept')} <> {KEY.format('B.dept26')}, FALSE) AS moved
 FROM C13 c LEFT JOIN B ON B.s13 = c.syscol LEFT JOIN M ON M.s26 = B.s26 LEFT JOIN N ON N.s13 = c.syscol),
R AS (SELECT s13, nom13, s26, nom26, region, dept13, dept26,
 CASE WHEN share >= 0.5 AND same_name THEN 'confirme' WHEN share >= 0.1 THEN 'provisoire' ELSE 'sans_correspondance' END AS statut,
 CASE WHEN share < 0.1 THEN 'disparue' WHEN n_targets >= 2 THEN 'decoupe' WHEN n_sources >= 2 THEN 'fusion' WHEN moved THEN 'rattachement_departement' WHEN NOT same_name THEN 'renomme' ELSE 'inchange' END AS type_changement,
 n_targets, n_sources, targets,
 'recouvrement=' || CAST(CAST(floor(share * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% / nom=' || CASE WHEN same_name THEN 'identique' ELSE 'different' END || ' / dept=' || CASE WHEN moved THEN 'change' ELSE 'idem' END AS notes FROM J)"""


def _recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.recompute(fx.communes_2013(spark, sf_dir), fx.communes_2026(spark, sf_dir))


@query("SELECT * FROM R", "C13 C26", RECOMPUTED)
def correspondence_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recomputed(spark, sf_dir)


@query("SELECT statut, type_changement, count(*) AS n FROM R GROUP BY 1, 2", "C13 C26", RECOMPUTED)
def correspondence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recomputed(spark, sf_dir).groupBy("statut", "type_changement").agg(F.count("*").alias("n"))


@query("SELECT s26, min(s13) AS first_source, count(*) AS n FROM R WHERE statut = 'confirme' GROUP BY s26", "C13 C26", RECOMPUTED)
def confirmed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets with a confirmed correspondence."""
    return _recomputed(spark, sf_dir).filter("statut = 'confirme'").groupBy("s26").agg(F.min("s13").alias("first_source"), F.count("*").alias("n"))


@query("SELECT c.syscol AS s26, CASE WHEN min(R.s13) IS NULL THEN 'nouvelle' ELSE min_by(R.type_changement, R.s13) END AS style FROM C26 c LEFT JOIN R ON R.s26 = c.syscol GROUP BY c.syscol", "C13 C26", RECOMPUTED)
def change_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a new commune is drawn: by its first antecedent's change, or as new."""
    r = _recomputed(spark, sf_dir).groupBy("s26").agg(F.min_by("type_changement", "s13").alias("style"))
    return fx.communes_2026(spark, sf_dir).select(F.col("syscol").alias("s26")).join(r, "s26", "left").select("s26", F.coalesce("style", F.lit("nouvelle")).alias("style"))


@query("SELECT a.syscol AS s13, a.nom AS nom13, b.syscol AS s26, b.nom AS nom26, a.region, a.dept, CASE WHEN b.syscol IS NULL THEN 'sans_correspondance' ELSE 'provisoire' END AS statut FROM C13 a LEFT JOIN (SELECT upper(trim(nom)) AS k, min(syscol) AS syscol, min_by(nom, syscol) AS nom FROM C26 GROUP BY 1) b ON b.k = upper(trim(a.nom)) WHERE a.k % 6 <> 0", "C13 C26")
def correspondence_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.communes_2013(spark, sf_dir)
    return co.by_name(old, fx.communes_2026(spark, sf_dir), old.filter("k % 6 = 0").select(F.col("syscol").alias("s13")))


#: Parcels as the registry holds them.
REGISTRY = "G AS (SELECT feature_idx, syscol, section, parcelle, CASE WHEN feature_idx % 8 = 0 THEN NULL ELSE syscol || section || parcelle END AS nicad, CASE WHEN feature_idx % 9 = 4 THEN '2026' ELSE '2013' END AS version, CASE WHEN feature_idx % 10 = 3 THEN 'archive' ELSE 'actif' END AS statut FROM P)"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("feature_idx")
    nicad = F.when(idx % 8 != 0, F.concat("syscol", "section", "parcelle"))
    return fx.parcels(spark, sf_dir).select("feature_idx", "syscol", "section", "parcelle", nicad.alias("nicad"), F.when(idx % 9 == 4, "2026").otherwise("2013").alias("version"), F.when(idx % 10 == 3, "archive").otherwise("actif").alias("statut"))


@query("SELECT R.s13, R.s26, nom13, nom26, R.statut, count(*) AS n_parcels FROM R JOIN G ON G.syscol = R.s13 WHERE R.s26 IS NOT NULL AND R.statut <> 'sans_correspondance' AND G.version = '2013' AND G.statut = 'actif' GROUP BY ALL", "C13 C26 P", f"{RECOMPUTED}, {REGISTRY}")
def migration_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.preview(_recomputed(spark, sf_dir), _registry(spark, sf_dir))


MOVED = f"{RECOMPUTED}, {REGISTRY}, U AS (SELECT s13, s26 FROM R WHERE s26 IS NOT NULL AND statut <> 'sans_correspondance'), H AS (SELECT G.*, U.s26, U.s26 IS NOT NULL AND version = '2013' AND statut = 'actif' AS moves FROM G LEFT JOIN U ON U.s13 = G.syscol)"


@query("SELECT feature_idx, CASE WHEN moves THEN s26 ELSE syscol END AS syscol, section, parcelle, CASE WHEN moves THEN s26 || section || parcelle ELSE nicad END AS nicad, CASE WHEN moves THEN '2026' ELSE version END AS version, CASE WHEN moves THEN 'bascule' ELSE statut END AS statut FROM H", "C13 C26 P", MOVED)
def migration_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.migrate(_recomputed(spark, sf_dir), _registry(spark, sf_dir))[0]


@query("SELECT feature_idx, coalesce(nicad, syscol || section || parcelle) AS nicad_old, s26 || section || parcelle AS nicad_new, syscol AS syscol_old, s26 AS syscol_new, 'Migration en masse Syscol ' || syscol || ' -> ' || s26 AS motif FROM H WHERE moves", "C13 C26 P", MOVED)
def migration_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.migrate(_recomputed(spark, sf_dir), _registry(spark, sf_dir))[1]
