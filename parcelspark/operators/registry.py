"""The registry of identifiers: coherence, numbering, generation, switching, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import nicad as nic
from parcelspark.functions.text import pad_left


def anomalies(nicad: Column, syscol: Column, section: Column, parcel: Column) -> Column:
    """What an identifier has wrong in itself, or against the commune, section and number expected where they are given."""
    differs = lambda part, expected, n: (F.coalesce(expected, F.lit("")) != "") & (part != pad_left(expected, n))
    against = F.array_compact(
        F.array(
            F.when(differs(nic.syscol_of(nicad), syscol, 8), "syscol_mismatch"),
            F.when(differs(nic.section_of(nicad), section, 3), "section_mismatch"),
            F.when(differs(nic.parcel_of(nicad), parcel, 5), "parcel_mismatch"),
        )
    )
    own = nic.errors(nicad)
    return F.when(F.size(own) > 0, own).otherwise(against)


def next_numbers(requests: DataFrame, used: DataFrame, span: int = 4096) -> DataFrame:
    """requests (request_id, syscol, section) get the numbers after the largest that is used in their section, in the order of request_id: number and nicad; null where a section's 99999 are used up.

    The largest number is an aggregate joined on. Places within a section come from ranges of ids that are counted first, so no task numbers all requests of a section."""
    key = ["syscol", "section"]
    last = used.groupBy(*key).agg(F.max(F.expr("try_cast(parcelle AS BIGINT)")).alias("last"))
    ranged = requests.withColumn("__range", F.floor(F.col("request_id") / span))
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*key, "__range").agg(F.count("*").alias("__n")).select(*key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy(*key, "__range").orderBy("request_id"))
    out = ranged.join(starts, [*key, "__range"]).withColumn("place", place).join(last, key, "left").withColumn("number", F.coalesce("last", F.lit(0)) + F.col("place"))
    fits = F.col("number") <= 99999
    return out.select("request_id", "syscol", "section", F.when(fits, F.col("number")).alias("number"), F.when(fits, nic.generated(F.col("syscol"), F.col("section"), F.col("number"))).alias("nicad"))


def largest_by_text(parcels: DataFrame, registry: DataFrame) -> DataFrame:
    """Per section the larger of the two tables' last numbers, where 'last' is the largest as text, read as a number."""
    read = F.coalesce(F.expr("try_cast(last AS BIGINT)"), F.lit(0))
    one = lambda df: df.groupBy("syscol", "section").agg(F.max("parcelle").alias("last")).select("syscol", "section", read.alias("last"))
    return one(parcels).unionByName(one(registry)).groupBy("syscol", "section").agg(F.max("last").alias("last_number"))


def switch_batch(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Switches row by row in the order of request_id (request_id, nicad, syscol_new): nicad_new and status ok, invalid, duplicate.

    A new identifier that exists already fails, and of several requests that lead to one identifier the first wins, as if they came in turn."""
    made = requests.withColumn("nicad_new", nic.switched(F.col("nicad"), F.col("syscol_new")))
    first = made.filter("nicad_new is not null").groupBy("nicad_new").agg(F.min("request_id").alias("first_id"))
    there = existing.select(F.col("nicad").alias("nicad_new"), F.lit(True).alias("there")).distinct()
    out = made.join(first, "nicad_new", "left").join(there, "nicad_new", "left")
    status = F.when(F.col("nicad_new").isNull(), "invalid").when(F.coalesce("there", F.lit(False)) | (F.col("request_id") != F.col("first_id")), "duplicate").otherwise("ok")
    return out.select("request_id", "nicad", "nicad_new", status.alias("status"))


def upsert(table: DataFrame, changes: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """changes into table by key. replace: rows that exist take the new values; else they stay. Of several changes to one key the last (by pos) counts."""
    columns = [c for c in table.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("pos")).alias("__new")).withColumnRenamed(key, "__key")
    old = table.withColumn("__old", F.lit(True))
    out = old.join(last, old[key] == last["__key"], "full_outer")
    new, has_new, is_old = F.col("__new"), F.col("__new").isNotNull(), F.coalesce("__old", F.lit(False))
    use_new = has_new if replace else has_new & ~is_old
    return out.select(F.coalesce(key, "__key").alias(key), *[F.when(use_new, new[c]).otherwise(F.col(c)).alias(c) for c in columns])


def last_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(pos)).alias("__last")).select(key, "__last.*")


def verified(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """rows with ``valid`` (the identifier's form) and ``found`` (it is valid and among ``existing``, column nicad)."""
    there = existing.select(F.col("nicad").alias("__nicad"), F.lit(True).alias("__there")).distinct()
    out = rows.withColumn("valid", nic.is_valid(F.col("nicad_raw"))).join(there, nic.cleaned(F.col("nicad_raw")) == F.col("__nicad"), "left")
    return out.withColumn("found", F.col("valid") & F.coalesce("__there", F.lit(False))).drop("__nicad", "__there")


def checked(requests: DataFrame) -> DataFrame:
    """requests (syscol, section, nicad as texts) with ``reason``, what their lengths break first, null for those that are accepted."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return requests.withColumn("reason", F.when(~n("syscol").between(7, 8), "syscol").when(~n("section").between(1, 3), "section").when(n("nicad") != 16, "nicad"))


def cascade(parents: DataFrame, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(children that stay, children that go) when ``parents`` are deleted."""
    gone = parents.select(key).distinct()
    return children.join(gone, key, "left_anti"), children.join(gone, key, "left_semi")


def dashboard(parcels: DataFrame, communes_2013: DataFrame, communes_2026: DataFrame) -> DataFrame:
    """One row of counters over the registry, and the percentage of identifiers that have been switched."""
    named, switched = F.count("nicad"), F.count_if(F.col("statut") == "archive")
    out = parcels.agg(named.alias("nicads"), F.count_if(F.col("nicad").isNotNull() & (F.col("version") == "2013")).alias("v2013"), F.count_if(F.col("nicad").isNotNull() & (F.col("version") == "2026")).alias("v2026"), switched.alias("bascules"), F.when(named > 0, F.floor(switched * 100 / named + 0.5)).otherwise(0).cast("bigint").alias("taux"), F.count("*").alias("parcelles"), F.count_distinct("syscol", "section").alias("sections"))
    for name, table in (("communes_2013", communes_2013), ("communes_2026", communes_2026)):
        out = out.join(F.broadcast(table.agg(F.count("*").alias(name))))  # one row each
    return out


def update_fields(table: DataFrame, changes: DataFrame, key: str, fields: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """changes into table by key: of rows that exist only ``fields`` change, new rows come whole, with defaults for what they lack. Of several changes to one key the last (by pos) counts."""
    columns = [c for c in table.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c in changes.columns]), F.col("pos")).alias("__new")).withColumnRenamed(key, "__key")
    out = table.withColumn("__old", F.lit(True)).join(last, table[key] == last["__key"], "full_outer")
    is_old, has_new = F.coalesce("__old", F.lit(False)), F.col("__key").isNotNull()

    def value(c: str) -> Column:
        new = F.col("__new")[c] if c in changes.columns else F.lit(None)
        fresh = F.coalesce(new, defaults[c]) if defaults and c in defaults else new
        return F.when(~is_old, fresh).when(has_new & F.lit(c in fields), new).otherwise(F.col(c)).alias(c)

    return out.select(F.coalesce(key, "__key").alias(key), *[value(c) for c in columns])


def new_sections(requests: DataFrame, communes: DataFrame, existing: DataFrame) -> DataFrame:
    """requests (request_id, syscol, section) with the padded key and ``status``: ok, commune (unknown), exists; of several requests for one section the first counts."""
    r = requests.select("request_id", pad_left(F.col("syscol"), 8).alias("syscol"), pad_left(F.col("section"), 3).alias("section"))
    first = r.groupBy("syscol", "section").agg(F.min("request_id").alias("first_id"))
    known = communes.select("syscol", F.lit(True).alias("known")).distinct()
    there = existing.select("syscol", "section", F.lit(True).alias("there")).distinct()
    out = r.join(first, ["syscol", "section"]).join(known, "syscol", "left").join(there, ["syscol", "section"], "left")
    status = F.when(F.col("known").isNull(), "commune").when(F.coalesce("there", F.lit(False)) | (F.col("request_id") > F.col("first_id")), "exists").otherwise("ok")
    return out.select("request_id", "syscol", "section", status.alias("status"))


def operation_log(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """Operations (op_id, kind) with what closed them (op_id, pos, ok, failed), the last one by pos: status en_cours, succes or echec, and the numbers."""
    last = closed.groupBy("op_id").agg(F.max_by(F.struct("ok", "failed"), F.col("pos")).alias("end"))
    rows = opened.join(last, "op_id", "left")
    zero = F.lit(0).cast("bigint")
    status = F.when(F.col("end").isNull(), "en_cours").when(F.col("end.failed") > 0, "echec").otherwise("succes")
    return rows.select("op_id", "kind", status.alias("status"), F.coalesce("end.ok", zero).alias("ok"), F.coalesce("end.failed", zero).alias("failed"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with ``batch`` (from 1), so many in each in their order; numbers come from ranges that are counted first."""
    from parcelspark.operators.listing import renumbered

    return renumbered(rows, order).withColumn("batch", F.floor(F.col("position") / size) + 1)


def dependents(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Parents with a count of rows in each child table, which a cascading deletion would take along."""
    out = parents.select(key)
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
