"""Records of analyses and reports, checks of requests, counters of the registry, copies of foreign tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.text import report_title
from parcelspark.operators import quality


def counters(registry: DataFrame, history: DataFrame, communes_2013: DataFrame, communes_2026: DataFrame, operations: DataFrame, recent: int = 5) -> DataFrame:
    """One row: identifiers by version, switches, history, parcels, sections, communes of both vintages, operations and the ids of the latest ones."""
    has = F.col("nicad").isNotNull()
    out = registry.agg(F.count_if(has & (F.col("version") == "2013")).alias("nicads_2013"), F.count_if(has & (F.col("version") == "2026")).alias("nicads_2026"), F.count_if(F.col("statut") == "archive").alias("bascules"), F.count("*").alias("parcelles"), F.count_distinct("syscol", "section").alias("sections"))
    for name, df in (("historique", history), ("communes_2013", communes_2013), ("communes_2026", communes_2026), ("operations", operations)):
        out = out.join(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    last = operations.orderBy(F.desc("op_id")).limit(recent).agg(F.array_join(F.transform(F.sort_array(F.collect_list("op_id"), asc=False), lambda i: i.cast("string")), ",").alias("recentes"))
    return out.join(F.broadcast(last))


def created(requests: DataFrame) -> DataFrame:
    """Reports (report_id, title, content) from requests (report_id, kind, name, content)."""
    return requests.select("report_id", report_title(F.col("kind"), F.col("name")).alias("title"), "content")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Texts as the given types, trimmed; empty ones and those that cannot be read are null."""
    value = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return rows.withColumns({c: value(F.col(c)).try_cast(t) for c, t in types.items()})


def refused(rows: DataFrame, first: dict[str, list[str]], sizes: dict[str, int], then: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with ``reason``, the first column whose value is not among the allowed ones or over its size; null for those that are accepted."""
    tests: list[tuple[str, Column]] = [(c, ~F.coalesce(F.col(c).isin(v), F.lit(False))) for c, v in first.items()]
    tests += [(c, F.col(c) > n) for c, n in sizes.items()]
    tests += [(c, ~F.coalesce(F.col(c).isin(v), F.lit(False))) for c, v in (then or {}).items()]
    reason = F.coalesce(*[F.when(bad, c) for c, bad in tests])
    return rows.withColumn("reason", reason)


def run(parcels: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """The record of a finished analysis: status, features, n_errors and score."""
    counts = quality.errors(parcels, boundary).agg(F.count("*").alias("n_errors"), *[F.count_if(F.col("severity") == s).alias(s) for s in quality.SEVERITIES])
    both = parcels.agg(F.count("*").alias("features")).join(F.broadcast(counts))  # one row each
    return both.select(F.lit("COMPLETED").alias("status"), "features", "n_errors", quality.score(F.col("critical"), F.col("high"), F.col("medium"), F.col("features")).alias("score"))


#: Properties of a drawn parcel's feature (fixed values): its name, and the column that holds it.
PROPERTIES = {
    "nicad": "nicad",
    "syscol": "syscol",
    "commune_2026": "commune",
    "numero": "numero",
    "numero_parcelle": "parcelle",
    "numero_lot": "lot",
    "numero_section": "section",
    "proprietaire": "proprietaire",
    "denomination": "denomination",
    "autres_textes": "autres",
    "is_piscine": "is_piscine",
    "piscine_surface": "piscine_surface",
    "surface_m2": "surface",
    "geom_hash": "geom_hash",
}


def parcel_feature(rows: DataFrame) -> Column:
    """A drawn parcel (rings, and whichever columns of PROPERTIES rows have) as a feature in JSON; a missing identifier or commune is an empty text."""
    value = lambda name, c: (F.coalesce(F.col(c), F.lit("")) if name in ("nicad", "syscol") else F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    props = F.struct(*[value(n, c).alias(n) for n, c in PROPERTIES.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"), props.alias("properties")))
