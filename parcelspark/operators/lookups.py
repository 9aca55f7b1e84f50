"""Keyed lookups and listings of the registry, filters of lists and maps, and reports.

A key is padded before it is compared: 8 digits for a commune, 3 for a section, 5 for a parcel. Limits are parameters of the listing that has them, and null for the whole list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import nicad as nic
from parcelspark.functions.text import pad_left

#: Rows of listings that have a limit (fixed values).
GEOMETRY_LIMIT, NEWEST = 500, 20


def equals(column: str, value: str, width: int) -> Column:
    return F.col(column) == pad_left(F.lit(value), width)


def by_key(df: DataFrame, syscol: str | None = None, section: str | None = None, parcelle: str | None = None, version: str | None = None) -> DataFrame:
    """Rows of a commune, a section or a parcel; a part that is not given is not looked at."""
    for column, value, width in (("syscol", syscol, 8), ("section", section, 3), ("parcelle", parcelle, 5)):
        if value is not None:
            df = df.filter(equals(column, value, width))
    return df.filter(F.col("version") == version) if version is not None else df


def of_communes(df: DataFrame, syscols: list[str]) -> DataFrame:
    """Rows of several communes."""
    return df.filter(F.col("syscol").isin([s.rjust(8, "0") for s in syscols]))


def with_geometry(df: DataFrame, order: list[str], limit: int | None = GEOMETRY_LIMIT, column: str = "geom") -> DataFrame:
    """Rows that have a geometry, the first in order."""
    out = df.filter(F.col(column).isNotNull()).orderBy(*order)
    return out if limit is None else out.limit(limit)


def regions(communes: DataFrame) -> DataFrame:
    """Names of regions, each once, in order."""
    return communes.filter("region is not null").select("region").distinct().orderBy("region")


def of_region(communes: DataFrame, region: str | None) -> DataFrame:
    """Communes by name, of one region if it is given."""
    return (communes if region is None else communes.filter(F.col("region") == region)).orderBy("nom", "syscol")


def light(communes: DataFrame) -> DataFrame:
    """What lists of communes show."""
    return communes.select(F.col("syscol").alias("codSyscol"), "nom", "region", "dept")


def sections_of(parcels: DataFrame, syscol: str, version: str | None = None) -> DataFrame:
    return by_key(parcels, syscol, version=version).select("section").distinct().orderBy("section")


def exists(wanted: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """wanted with found: whether known has its key."""
    keys = known.select(*on).distinct().withColumn("found", F.lit(True))
    return wanted.join(keys, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def changes_by_code(correspondence: DataFrame, code: str) -> DataFrame:
    """The change of each commune by its old (s13) or new (s26) code; of several rows of a code the last one in the order of the old codes."""
    last = F.max_by(F.struct("s13", "s26", "type_changement", "statut"), F.struct("s13", "s26"))
    rows = correspondence.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(last.alias("c"))
    return rows.select("code", F.col("c.s13").alias("from_code"), F.col("c.s26").alias("to_code"), "c.type_changement", "c.statut")


def by_conformity(analyses: DataFrame, term: str = "", status: str | None = None, conformity: str | None = None) -> DataFrame:
    """A dashboard's filter: a text in the name, a status, GOOD (a score of 70 and more) or BAD."""
    from parcelspark.operators.listing import contains_any

    out = analyses.filter(contains_any([F.col("name")], term))
    if status is not None:
        out = out.filter(F.col("status") == status)
    return {"GOOD": out.filter("score >= 70"), "BAD": out.filter("score < 70")}.get(conformity, out)


def with_errors(features: DataFrame, errors: DataFrame) -> DataFrame:
    """Features that an error names, as first or second."""
    named = errors.select(F.explode(F.array("nicad1", "nicad2")).alias("nicad")).filter("nicad is not null").distinct()
    return features.join(named, "nicad", "left_semi")


def of_types(errors: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    out = errors if include is None else errors.filter(F.upper("error_type").isin([t.upper() for t in include]))
    return out.filter(~F.upper("error_type").isin([t.upper() for t in exclude])) if exclude else out


def errors_with_features(errors: DataFrame, features: DataFrame) -> DataFrame:
    """Errors (error_id, nicad1, nicad2) with the last feature of each of their names: first_idx, second_idx, and how many features both names have."""
    names = features.groupBy("nicad").agg(F.max("feature_idx").alias("idx"), F.count("*").alias("n"))
    side = lambda k: names.select(F.col("nicad").alias(f"nicad{k}"), F.col("idx").alias(f"idx{k}"), F.col("n").alias(f"n{k}"))
    out = errors.join(side(1), "nicad1", "left").join(side(2), "nicad2", "left")
    zero = F.lit(0)
    return out.select("error_id", F.col("idx1").alias("first_idx"), F.col("idx2").alias("second_idx"), (F.coalesce("n1", zero) + F.coalesce("n2", zero)).alias("features"))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str) -> DataFrame:
    """Parents with the number of their children and the last one by ``order``."""
    last = children.groupBy(key).agg(F.count("*").alias("n_children"), F.max_by(order, F.col(order)).alias("last_child"))
    return parents.join(last, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def error_index(errors: DataFrame) -> DataFrame:
    """For each parcel its errors, as a list of types and severities in the order of their ids."""
    item = F.struct("error_id", "error_type", "severity")
    rows = errors.groupBy(F.col("nicad1").alias("nicad")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("nicad", F.size("items").alias("n_errors"), F.array_join(F.transform("items", lambda e: F.concat(e["error_type"], F.lit(":"), e["severity"])), ",").alias("errors"))


def parcels_by_type(errors: DataFrame, features: DataFrame) -> DataFrame:
    """For each type of error how many parcels of the layer it touches, each once."""
    named = errors.select("error_type", F.explode(F.array("nicad1", "nicad2")).alias("nicad")).filter("nicad is not null").distinct()
    return named.join(features.select("nicad").distinct(), "nicad", "left_semi").groupBy("error_type").agg(F.count("*").alias("parcels"))


def chat_context(errors: DataFrame, first: int = 50) -> DataFrame:
    """Counts by type and severity and the first errors, as lines of text in order."""
    counts = errors.groupBy("error_type", "severity").agg(F.count("*").alias("n"))
    lines = counts.select(F.lit(0).alias("part"), F.concat_ws(" ", "error_type", "severity", F.col("n").cast("string")).alias("line"))
    some = errors.orderBy("error_id").limit(first)
    return lines.unionByName(some.select(F.lit(1).alias("part"), F.concat_ws(" ", F.col("error_id").cast("string"), "error_type", "nicad1").alias("line")))


def stored_layer(asked: DataFrame, files: DataFrame, prefix: str = "geo/") -> DataFrame:
    """asked (analysis_id, key, corrected, inline) with the layer that is read: the corrected one, else the stored one of its key, with or without the prefix that older keys lack, else the one kept inline; and the layer for reports, which leaves corrections out."""
    name = lambda c: F.regexp_replace(c, f"^{prefix}", "")
    stored = files.select(name(F.col("path")).alias("__name"), F.col("content").alias("__stored")).groupBy("__name").agg(F.min("__stored").alias("__stored"))
    rows = asked.withColumn("__name", name(F.col("key"))).join(stored, "__name", "left")
    return rows.select("analysis_id", F.coalesce("corrected", "__stored", "inline").alias("layer"), F.coalesce("__stored", "inline").alias("original"))


def found_features(errors: DataFrame, features: DataFrame) -> DataFrame:
    """The feature that each error (error_id, nicad1, x, y) means: the first one of a real identifier, else (feature_N, or an identifier that is gone) the first whose box holds the error's place."""
    from parcelspark.operators.spatial import points_in

    real = F.col("nicad1").isNotNull() & ~F.startswith("nicad1", F.lit("feature_"))
    first = features.groupBy("nicad").agg(F.min("feature_idx").alias("by_name"))
    rows = errors.withColumn("nicad", F.when(real, F.col("nicad1"))).join(first, "nicad", "left")
    places = points_in(rows.filter("by_name is null").select("error_id", "x", "y"), features.select("feature_idx", "x0", "y0", "x1", "y1"), 60.0, "error_id", "feature_idx")
    return rows.join(places.select("error_id", F.col("b_feature_idx").alias("by_place")), "error_id", "left").select("error_id", F.coalesce("by_name", "by_place").alias("feature_idx"))


def found_by_geometry(errors: DataFrame, features: DataFrame, digits: int = 7) -> DataFrame:
    """error_id and feature_idx of the first feature whose outline (ring) equals the error's within 10**-digits, vertex by vertex; null if there is none. They meet by the cell of their first corner."""
    from parcelspark.operators.correction import equal_rings

    e = errors.select("error_id", F.col("ring").alias("sought"))
    hit = equal_rings(features.select("feature_idx", "ring"), e, "sought", digits).groupBy("error_id").agg(F.min("feature_idx").alias("feature_idx"))
    return errors.select("error_id").join(hit, "error_id", "left")


def card(df: DataFrame, nicad: str = "nicad") -> DataFrame:
    """The parts of an identifier, as cards show them."""
    return df.withColumn("card", nic.parts(F.col(nicad)))
