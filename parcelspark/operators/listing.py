"""Lists, searches, dashboards and reports over analyses, errors, parcels and communes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions.text import half_up


def locale_order(name: Column) -> Column:
    """A name as a sort key that people expect: letters with and without marks, and in both cases, stand side by side."""
    return F.collate(name, "UNICODE")


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a sorted list; the order must decide ties, so that pages agree."""
    return df.orderBy(*order).offset(offset).limit(limit)


def clamped_page(df: DataFrame, order: list[Column], limit: int, number: int) -> DataFrame:
    """The page of that number, from 0; one beyond the last is the last, one before the first the first."""
    last = max(0, -(-df.count() // limit) - 1)
    return page(df, order, limit, limit * max(0, min(number, last)))


def contains_any(columns: list[Column], term: str) -> Column:
    """Whether a text is part of any column, without regard to case; a blank term matches all."""
    if not term.strip():
        return F.lit(True)
    needle = F.lit(term.lower())
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
    return out


def any_property_contains(props: Column, term: str) -> Column:
    """Whether any value of a map has the text."""
    needle = F.lit(term.lower())
    return F.lit(True) if not term.strip() else F.exists(F.map_values(props), lambda v: F.coalesce(F.contains(F.lower(v), needle), F.lit(False)))


def since(period: str, now: Column) -> Column:
    """The start of a dashboard's period: TODAY, WEEK, MONTH, ALL."""
    return {"TODAY": F.date_trunc("day", now), "WEEK": now - F.expr("INTERVAL 7 DAYS"), "MONTH": F.add_months(now, -1).cast("timestamp"), "ALL": F.lit(None).cast("timestamp")}[period]


def in_period(created: Column, period: str, now: Column) -> Column:
    return F.lit(True) if period == "ALL" else created >= since(period, now)


def kpis(analyses: DataFrame) -> DataFrame:
    """Number, sums and the mean score with one decimal; zeros for an empty table."""
    zero = F.lit(0)
    return analyses.agg(F.count("*").alias("analyses"), F.coalesce(F.sum("features"), zero).alias("features"), F.coalesce(F.sum("errors"), zero).alias("errors"), F.coalesce(half_up(F.avg("score"), 1), F.lit(0.0)).alias("mean_score"))


def counts_by_type(errors: DataFrame, parent: str) -> DataFrame:
    """Errors of each parent by type, as a text type=n in order."""
    n = errors.groupBy(parent, "error_type").agg(F.count("*").alias("n"))
    pair = F.concat("error_type", F.lit("="), F.col("n").cast("string"))
    return n.groupBy(parent).agg(F.sum("n").alias("errors"), F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("by_type"))


def trend(analyses: DataFrame, order: str, last: int = 20) -> DataFrame:
    """The last rows in ascending order."""
    return analyses.orderBy(F.desc(order)).limit(last).orderBy(order)


def attribute_columns(rows: DataFrame, props: str, priority: list[str], sample: int = 200) -> DataFrame:
    """The names of properties in the first rows: those of priority in their order, then the others by name; names that start with _ are left out."""
    names = rows.orderBy("feature_idx").limit(sample).select(F.explode(F.map_keys(props)).alias("name")).distinct().filter(~F.startswith("name", F.lit("_")))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("name"))
    rank = F.when(place > 0, place).otherwise(len(priority) + 1)
    return names.withColumn("position", F.row_number().over(Window.orderBy(rank, "name")).cast("bigint"))


def attribute_diff(a: Column, b: Column) -> Column:
    """The keys whose values differ between two maps, in order."""
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b))))
    return F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


def csv_field(c: Column, separator: str = ";") -> Column:
    """A field as it stands in a CSV line: null empty, quoted where it holds a separator, quote or line break."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike(f'[{separator}"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_line(columns: list[Column], separator: str = ";") -> Column:
    return F.concat_ws(separator, *[csv_field(c, separator) for c in columns])


def dbf_record(fields: list[tuple[Column, int]]) -> Column:
    """A record of fixed width: each value cut or filled with blanks on the right."""
    return F.concat(*[F.rpad(F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, n), n, " ") for c, n in fields])


def markdown_report(counts: DataFrame, title: str) -> DataFrame:
    """One row with a Markdown table of (error_type, n)."""
    line = F.concat(F.lit("| "), "error_type", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return counts.agg(F.concat(F.lit(f"# {title}\n\n| type | n |\n|---|---|\n"), body).alias("report"))


def renumbered(rows: DataFrame, order: str, span: int = 4096) -> DataFrame:
    """rows with ``position``, their number from 0 in the order of a whole-number column: ranges of it are counted and added up first, so no task numbers all rows."""
    rows = rows.withColumn("__range", F.floor(F.col(order) / span))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return rows.join(starts, "__range").withColumn("position", F.col("__start") + place).drop("__range", "__start")
