"""Correspondence of two vintages of communes, and the migration of identifiers along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions.text import half_up, name_key
from parcelspark.operators.lookups import equals
from parcelspark.operators.spatial import BOX, box_join, overlap_area, own_area

#: Least share of the old commune's area for a status, and for a fragment (fixed values).
CONFIRMED, PROVISIONAL, FRAGMENT = 0.5, 0.1, 0.15


def overlay(old: DataFrame, new: DataFrame, size: float = 1000.0) -> DataFrame:
    """Pairs of old and new communes that overlap: s13, s26, nom26, dept26 and the share of the old one's area."""
    shape = [c for c in (*BOX, "parts") if c in old.columns and c in new.columns]
    pairs = box_join(old.select("syscol", *shape), new.select("syscol", "nom", "dept", *shape), size)
    pairs = pairs.withColumn("shared", overlap_area(pairs)).filter("shared > 0")
    whole = own_area(pairs, "l_")
    return pairs.select(F.col("l_syscol").alias("s13"), F.col("r_syscol").alias("s26"), F.col("r_nom").alias("nom26"), F.col("r_dept").alias("dept26"), F.when(whole > 0, F.col("shared") / whole).alias("share"))


def recompute(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per old commune: its best target, status and kind of change. Equal shares are decided by the target's code."""
    pairs = overlay(old, new)
    best = pairs.groupBy("s13").agg(F.min_by(F.struct("s26", "nom26", "dept26", "share"), F.struct(-F.col("share"), F.col("s26"))).alias("b"), F.count_if(F.col("share") >= FRAGMENT).alias("n_targets")).select("s13", "b.*", "n_targets")
    sources = best.groupBy("s26").agg(F.count("*").alias("n_sources"))
    part = F.concat("s26", F.lit(":"), "nom26", F.lit(" ("), half_up(F.col("share") * 100).cast("bigint").cast("string"), F.lit("%)"))
    place = F.row_number().over(Window.partitionBy("s13").orderBy(F.desc("share"), "s26"))
    texts = pairs.filter(F.col("share") >= FRAGMENT).withColumn("place", place).withColumn("part", part)
    texts = texts.groupBy("s13").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda s: s["part"]), " | ").alias("targets"))
    c = old.select(F.col("syscol").alias("s13"), F.col("nom").alias("nom13"), F.col("dept").alias("dept13"), "region").join(best, "s13", "left").join(sources, "s26", "left").join(texts, "s13", "left")
    share = F.coalesce("share", F.lit(0.0))
    same_name = (name_key(F.col("nom13")) != "") & (name_key(F.col("nom13")) == name_key(F.col("nom26")))
    moved = (name_key(F.col("dept26")) != "") & (name_key(F.col("dept13")) != name_key(F.col("dept26")))
    status = F.when((share >= CONFIRMED) & same_name, "confirme").when(share >= PROVISIONAL, "provisoire").otherwise("sans_correspondance")
    kind = F.when(share < PROVISIONAL, "disparue").when(F.coalesce("n_targets", F.lit(0)) >= 2, "decoupe").when(F.coalesce("n_sources", F.lit(0)) >= 2, "fusion").when(moved, "rattachement_departement").when(~same_name, "renomme").otherwise("inchange")
    notes = F.concat(F.lit("recouvrement="), half_up(share * 100).cast("bigint").cast("string"), F.lit("% / nom="), F.when(same_name, "identique").otherwise("different"), F.lit(" / dept="), F.when(moved, "change").otherwise("idem"))
    zero = F.lit(0).cast("bigint")
    return c.select("s13", "nom13", "s26", "nom26", "region", "dept13", "dept26", status.alias("statut"), kind.alias("type_changement"), F.coalesce("n_targets", zero).alias("n_targets"), F.coalesce("n_sources", zero).alias("n_sources"), "targets", notes.alias("notes"))


def by_name(old: DataFrame, new: DataFrame, present: DataFrame) -> DataFrame:
    """Rows for old communes that are not in ``present`` (s13): the new commune of the same name (the lowest code), trimmed and in upper case."""
    key = F.upper(F.trim("nom"))
    first = new.groupBy(key.alias("key")).agg(F.min_by(F.struct(F.col("syscol").alias("s26"), F.col("nom").alias("nom26")), F.col("syscol")).alias("m")).select("key", "m.*")
    fresh = old.join(present.select(F.col("s13").alias("syscol")), "syscol", "left_anti").withColumn("key", key)
    status = F.when(F.col("s26").isNotNull(), "provisoire").otherwise("sans_correspondance")
    return fresh.join(first, "key", "left").select(F.col("syscol").alias("s13"), F.col("nom").alias("nom13"), "s26", "nom26", "region", "dept", status.alias("statut"))


def preview(correspondence: DataFrame, parcels: DataFrame, commune: str | None = None) -> DataFrame:
    """Active parcels of the old vintage for each commune that has a target, or for one old commune, whose code may lack leading zeros."""
    usable = correspondence.filter("s26 is not null and statut <> 'sans_correspondance'")
    if commune is not None:
        usable, parcels = usable.filter(equals("s13", commune, 8)), parcels.filter(equals("syscol", commune, 8))
    counts = parcels.filter("version = '2013' and statut = 'actif'").groupBy(F.col("syscol").alias("s13")).agg(F.count("*").alias("n_parcels"))
    return usable.join(counts, "s13").select("s13", "s26", "nom13", "nom26", "statut", "n_parcels")


def migrate(correspondence: DataFrame, parcels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parcels after the migration, history of the identifiers that changed), by one join instead of a loop over communes."""
    usable = correspondence.filter("s26 is not null and statut <> 'sans_correspondance'").select(F.col("s13").alias("syscol"), F.col("s26").alias("target"))
    rows = parcels.join(usable, "syscol", "left")
    moves = F.col("target").isNotNull() & (F.col("version") == "2013") & (F.col("statut") == "actif")
    fresh = F.concat("target", "section", "parcelle")
    old_nicad = F.coalesce("nicad", F.concat("syscol", "section", "parcelle"))
    history = rows.filter(moves).select("feature_idx", old_nicad.alias("nicad_old"), fresh.alias("nicad_new"), F.col("syscol").alias("syscol_old"), F.col("target").alias("syscol_new"), F.concat(F.lit("Migration en masse Syscol "), "syscol", F.lit(" -> "), "target").alias("motif"))
    after = rows.select("feature_idx", F.when(moves, F.col("target")).otherwise(F.col("syscol")).alias("syscol"), "section", "parcelle", F.when(moves, fresh).otherwise(F.col("nicad")).alias("nicad"), F.when(moves, "2026").otherwise(F.col("version")).alias("version"), F.when(moves, "bascule").otherwise(F.col("statut")).alias("statut"))
    return after, history


def search(correspondence: DataFrame, term: str = "", **equal: str) -> DataFrame:
    """Rows whose columns equal the given values and whose names (in any case) or codes contain the term; a blank term matches all."""
    out = correspondence
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    if not term.strip():
        return out
    has = lambda c, t: F.coalesce(F.contains(c, F.lit(t)), F.lit(False))
    return out.filter(has(F.lower("nom13"), term.lower()) | has(F.col("s13"), term) | has(F.lower("nom26"), term.lower()) | has(F.col("s26"), term))


def confirmed(correspondence: DataFrame) -> DataFrame:
    """Provisional rows with a target become confirmed."""
    return correspondence.withColumn("statut", F.when((F.col("statut") == "provisoire") & F.col("s26").isNotNull(), "confirme").otherwise(F.col("statut")))
