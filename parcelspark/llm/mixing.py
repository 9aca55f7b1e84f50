"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the keys are put in order by ranges, token counts are summed along that order in two steps (sums of the ranges, then inside each range), and the order is cut at the source's exact budget. A budget beyond the source's size repeats whole epochs first. What a source's cut comes to is one row (epochs, key at the cut, words left there), so the decision reaches the documents by that small table and texts are never shuffled. The targets depend on all sources at once and are computed over their table, one row each, in one window; documents take no part in it.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; documents with one key (a doc_id that repeats, or null ids) share what is left at the cut equally, rounded down; a source of size 0 has target 0; an empty table gives no rows; extra columns pass through ``mix`` and are ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, prefix_sums, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Sources up to which their table is sent to every task; beyond, Spark joins as it sees fit.
BROADCAST_SOURCES = 20_000
SEED = "mix-1"


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """sources: source, source_size. Adds weight and target.

    Weights repeat in the order of the sources. With all sizes shared by weight, a source stops at ``most`` times its size and the excess is reshared among the others. That is the level x at which the sum of least(most * size, x * weight) is the total; sources in the order of size per weight are capped up to the first whose cap is above the level that it leaves."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w.cast("long")).withColumn("__cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    below = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__total", F.sum("source_size").over(everything)).withColumn("__weights", F.sum("weight").over(everything))
    s = s.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(below), F.lit(0))).cast("double") / (F.col("__weights") - F.coalesce(F.sum("weight").over(below), F.lit(0))).cast("double"))
    open_ = F.col("__cap").cast("double") > F.col("__level") * F.col("weight")
    s = s.withColumn("__x", F.min(F.when(open_, F.struct((F.col("__cap") / F.col("weight")).alias("r"), F.col("source"), F.col("__level").alias("x")))).over(everything)["x"])
    return s.select("source", "source_size", "weight", F.coalesce(F.least(F.col("__cap").cast("double"), F.col("__x") * F.col("weight")), F.col("__cap").cast("double")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, int]:
    """One row per source: source, source_size, weight, target, epochs (whole), cut_key, cut_words, cut_rows; and the number of sources.

    Documents before cut_key are taken once more than ``epochs`` times, those at it with cut_words / cut_rows words."""
    slim = materialise(docs.select("source", order_key(F.col("doc_id"), seed).alias("key"), word_count(F.col("text")).alias("size")).groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    sources = materialise(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("epochs", epochs).withColumn("__left", budget - F.col("epochs") * F.col("source_size"))
    ranged = prefix_sums(slim.withColumn("range", F.substring("key", 1, 3)), ["source"], "range", ["key"], "size", "before")
    left = sources.select(F.col("source").alias("__s"), "__left")
    cuts = ranged.join(left, ranged["source"].eqNullSafe(left["__s"])).filter("before <= __left and __left < before + size")
    cuts = cuts.select("__s", F.col("key").alias("cut_key"), (F.col("__left") - F.col("before")).alias("cut_words"), F.col("rows").alias("cut_rows"))
    out = sources.join(cuts, sources["source"].eqNullSafe(cuts["__s"]), "left").select("source", "source_size", "weight", "target", "epochs", "cut_key", "cut_words", "cut_rows")
    out = materialise(out)
    return out, out.count()


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """For each row of docs: row (all its columns), size, source_size, target, epochs, extra (words taken once more) and taken = epochs * size + extra."""
    per_source, n = plan(docs, weights, most, seed)
    small = F.broadcast(per_source) if n <= BROADCAST_SOURCES else per_source
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.least("size", F.floor(F.col("cut_words") / F.col("cut_rows")))).otherwise(F.lit(0))
    d = docs.select(F.struct("*").alias("row"), order_key(F.col("doc_id"), seed).alias("key"), word_count(F.col("text")).alias("size"), F.col("source").alias("of"))
    d = d.join(small, d["of"].eqNullSafe(small["source"]), "left").withColumn("extra", extra.cast("long"))
    return d.select("row", "size", "source_size", "target", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixture itself, with the columns of docs: each document as often as it is taken, and of the one at a source's cut its first words only. n_chars, where there is one, follows the text."""
    d = taken(docs, weights, most, seed)
    copies = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    d = d.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    # A text falls apart after each of its words, so that its first words are joined again as they stood.
    first = F.array_join(F.slice(F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(F.col("extra"), F.lit(1)).cast("int")), "")
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("size")) & (F.col("copy") > F.col("epochs"))
    row = F.col("row").withField("text", F.when(cut, first).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.length(first).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return d.select(row.alias("row")).select("row.*")
