"""Chat formatting with collapse of cumulative snapshots.

A log may hold a conversation several times, each time a few turns longer. Every turn gets the hash of the conversation up to it, rolled on from turn to turn: the sums of two 60-bit parts of the SHA-256 of (position, role, text), which prefix sums compute without gathering a conversation. A conversation whose last hash, at its length, is a prefix hash of a longer one goes by an anti-join; of equal conversations the one with the smallest id stays. With 120 bits, no two different beginnings among 10^12 turns have one hash but with a chance of 1e-12. The turns of the maximal conversations are rendered, one row each. Where turns meet what is known of their conversation, they do so by conv_id: there a very long one is left to Spark's splitting of skewed joins.

Turns are numbered after one sort by ranges: a row's place is the number of its conversation's rows in the ranges before, and within its range. So a long conversation, or one whose turns all have one number, is spread over tasks; only for the choice of ranges do texts count by their first characters.

Everything is DataFrame functions.

Defined results: turns are in the order of (turn, role, text), nulls first; a null role renders as ``unknown`` and a null text as empty, and both differ from those strings when turns are compared; rows without a conv_id are one conversation; turns that repeat count as often as they occur; a long text is hashed and rendered whole; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, prefix_sums

#: Characters of a text by which ranges are chosen.
AHEAD = 128


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position (from 1) and hash, that of the conversation up to this turn; decimals, so sums are exact."""
    width = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = turns.select("conv_id", "turn", "role", "text")
    ranged = slim.repartitionByRange(width, "conv_id", "turn", "role", F.substring("text", 1, AHEAD))
    # After the sort, the number of a row counts up within its range and over the ranges.
    said = F.sha2(F.concat(F.when(F.col("role").isNull(), "n").otherwise(F.concat(F.lit("r"), F.octet_length("role").cast("string"), F.lit(":"), F.col("role"))), F.when(F.col("text").isNull(), "n").otherwise(F.concat(F.lit("t"), F.col("text")))), 256)
    placed = ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", F.monotonically_increasing_id().alias("at"), said.alias("said"))
    placed = materialise(placed.withColumn("range", F.shiftright("at", 33)).withColumn("one", F.lit(1)))
    placed = prefix_sums(placed, ["conv_id"], "range", ["at"], "one", "before").withColumn("position", F.col("before") + 1)
    mark = F.sha2(F.concat(F.col("position").cast("string"), F.lit(":"), F.col("said")), 256)
    part = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)")
    rolled = materialise(placed.select("conv_id", "turn", "range", "at", "position", part(1).alias("a"), part(16).alias("b")))
    for c in ("a", "b"):
        rolled = prefix_sums(rolled, ["conv_id"], "range", ["at"], c, f"{c}_before")
    return rolled.select("conv_id", "turn", "position", *[(F.col(f"{c}_before") + F.col(c)).cast("decimal(38,0)").alias(f"hash_{c}") for c in ("a", "b")])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no other contains as a prefix."""
    rows, same = materialise(prefixes(turns)), ["n_turns", "hash_a", "hash_b"]
    lengths = rows.groupBy("conv_id").agg(F.max("position").alias("n_turns")).withColumnRenamed("conv_id", "of")
    rows = rows.hint("merge").join(lengths, rows["conv_id"].eqNullSafe(lengths["of"])).select("conv_id", "position", "hash_a", "hash_b", "n_turns")
    whole = materialise(rows.filter("position = n_turns").select("conv_id", *same))
    inside = rows.filter("position < n_turns").select(F.col("position").alias("n_turns"), "hash_a", "hash_b").distinct()
    first = whole.groupBy(*same).agg(F.min("conv_id").alias("first"))
    left = first.hint("merge").join(inside, same, "left_anti")
    return left.select(F.col("first").alias("conv_id"), "n_turns")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_turns, rendered for every turn of the maximal conversations."""
    turns = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = materialise(maximal(turns)).withColumnRenamed("conv_id", "kept")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    return turns.hint("merge").join(kept, turns["conv_id"].eqNullSafe(kept["kept"])).select("conv_id", "turn", "role", "n_turns", line.alias("rendered"))
