"""Running sums and latest values over long orders, without a task that holds a whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each row, the sum of a column over it and all rows before it in its group, in the order of (bucket, order), and the greatest value so far; null values count for nothing.

    Buckets are ranges of the order, each small enough for a task. They are aggregated first; only one row for each bucket of a group meets in a window, and rows meet those of their bucket."""
    sums, latest = sums or {}, latest or {}
    df = df.withColumns({f"__{k}": c for k, c in (sums | latest).items()})
    totals = df.groupBy(*group, bucket).agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums], *[F.max(f"__{k}").alias(f"__{k}") for k in latest])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, bucket, *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums], *[F.max(f"__{k}").over(before).alias(f"__before_{k}") for k in latest])
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(starts, [*group, bucket])
    out = {k: F.col(f"__before_{k}") + F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) for k in sums} | {k: F.greatest(F.col(f"__before_{k}"), F.max(f"__{k}").over(inside)) for k in latest}
    return joined.withColumns(out).drop(*[f"__{k}" for k in out], *[f"__before_{k}" for k in out])
