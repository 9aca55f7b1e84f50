"""What the operators of this package share: reading, cutting lineage, prefix sums and whole groups of rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelspark.operators.lineage import materialise, tidy

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


LEAST = -(1 << 63)


def ordered(number: Column) -> Column:
    """Nine bytes in the order of the numbers, null last: names that begin with them have the smallest number first."""
    shown = F.unhex(F.lpad(F.hex(F.coalesce(number, F.lit(0)).bitwiseXOR(F.lit(LEAST))), 16, "0"))
    return F.concat(F.when(number.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), shown)


def number_of(name: Column) -> Column:
    """The number that a name begins with."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(LEAST))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number)


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before, in the order of (bucket, order).

    Buckets are ranges of the order, small enough for a task each. Their sums are added up first, and only those sums of a group meet in one task; the rows of a group never do."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(bucket).alias("__bucket"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [df[g].eqNullSafe(starts[f"__{g}"]) for g in group] + [df[bucket].eqNullSafe(starts["__bucket"])]
    joined = df.join(starts, same, "inner").drop(*[f"__{g}" for g in group], "__bucket")
    return joined.withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__start")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 50_000, size: int = 1 << 26) -> Iterator[pa.Table]:
    """Tables of whole groups of about so many rows or bytes, from batches sorted by keys; a group is never cut in two. Groups must be of a bounded size."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows and sum(b.nbytes for b in held) < size:
            continue
        full = pa.Table.from_batches(held).combine_chunks()
        cut = n - 1
        last = [full[k][n - 1].as_py() for k in keys]
        while cut > 0 and [full[k][cut - 1].as_py() for k in keys] == last:
            cut -= 1
        if cut:
            yield full.slice(0, cut)
            held, n = full.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
