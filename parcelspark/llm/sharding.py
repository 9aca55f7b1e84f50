"""Sharding by extendible hashing.

Documents are hashed by id to ``BITS`` bits. The directory starts from the empty prefix, and only buckets over the byte limit split on another bit until each fits. A round looks ``FINER`` bits ahead: it sums the bytes of the cells that many bits below the buckets that are still too large, and of the prefixes between, so a prefix is a sum of 2**FINER cells at most; documents whose bucket fits are done, and only the others, those under prefixes over the limit, go on to the next round. A cell that no bit can split, one id that repeats, is cut along its rows (an overflow chain); a row that alone is over the limit is a shard of its own.

Defined results: a null text has 0 bytes; a null doc_id hashes as a value of its own; rows that repeat a doc_id share a shard unless it overflows; an empty table gives no rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, prefix_sums

BITS = 48
LIMIT = 1 << 20
#: Bits that a round adds, and those up to which its table of prefixes, of 2**BROADCAST_BITS rows at most, is sent to every task.
FINER, BROADCAST_BITS = 8, 8


def hashed(doc_id: Column) -> Column:
    """The first 48 bits of the id's md5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(cell: Column, bits: int | Column) -> Column:
    """The first bits of a number of BITS bits, as text."""
    return F.substring(F.lpad(F.bin(cell), BITS, "0"), F.lit(1), F.lit(bits).cast("int") if isinstance(bits, int) else bits)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (the bucket's prefix bits; /k after it in an overflow chain), depth (bits), shard_bytes."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), hashed(F.col("doc_id")).alias("hash")))
    done, todo, coarse, fine = None, rows, 0, FINER
    while True:
        # Depths that this round can settle; those above have been found too large.
        cells = todo.groupBy(F.shiftright("hash", BITS - fine).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        deep = materialise(cells.withColumn("depth", F.explode(F.sequence(F.lit(coarse), F.lit(fine)))).withColumn("prefix", F.expr(f"shiftright(cell, {fine} - depth)")))
        sums = deep.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        fits = F.when(F.col("shard_bytes") <= limit, F.struct("depth", "shard_bytes"))
        found = materialise(deep.hint("merge").join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min(fits).alias("fit")))
        placed = todo.withColumn("cell", F.shiftright("hash", BITS - fine))
        # Beyond BROADCAST_BITS: the written table packs so well that its size on disk would pass for one to broadcast, while its rows grow with the input.
        placed = placed.join(F.broadcast(found), "cell") if fine <= BROADCAST_BITS else placed.hint("merge").join(found, "cell")
        settled = placed.filter("fit is not null").select("doc_id", "n_bytes", _prefix(F.col("hash"), F.col("fit.depth")).alias("shard"), F.col("fit.depth").alias("depth"), F.col("fit.shard_bytes").alias("shard_bytes"))
        done = settled if done is None else done.unionByName(settled)
        todo = materialise(placed.filter("fit is null").select("doc_id", "n_bytes", "hash"))
        if todo.isEmpty():
            return done
        if fine == BITS:
            break
        coarse, fine = fine + 1, min(BITS, fine + FINER)
    # Overflow chains: rows in the order of a number that the written table fixes, cut where the running sum passes a limit.
    order = F.monotonically_increasing_id()
    chained = materialise(todo.withColumn("row", order).withColumn("range", F.shiftright("row", 12)))
    most = chained.groupBy("hash").agg(F.max("n_bytes").alias("largest"))
    summed = prefix_sums(chained, ["hash"], "range", ["row"], "n_bytes", "before").join(most, "hash")
    # A step of limit - largest + 1 leaves room for the row that starts in it; rows over the limit stand alone.
    step = F.greatest(F.lit(1), F.lit(limit) - F.least(F.col("largest"), F.lit(limit)) + 1)
    link = F.when(F.col("n_bytes") > limit, F.concat(F.lit("r"), F.col("row"))).otherwise(F.floor(F.col("before") / step).cast("string"))
    cut = summed.select("doc_id", "n_bytes", F.concat(_prefix(F.col("hash"), BITS), F.lit("/"), link).alias("shard"))
    sizes = cut.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return done.unionByName(cut.join(sizes, "shard").select("doc_id", "n_bytes", "shard", F.lit(BITS).alias("depth"), "shard_bytes"))
