"""Near-duplicate embeddings by random-hyperplane sign hashing.

Equal vectors of a label become one class with a number of copies. Each of several tables hashes a class by the signs of its products with random hyperplanes; classes with equal signs share a bucket, and only buckets with two classes or more go on, with their vectors. A bucket is dealt out in parts of about ``PART`` classes (larger ones, up to ``MOST``, in buckets of over ``PART * PARTS``), and every two parts meet in a block of their own, so no task compares a whole hot bucket. Only where classes meet the size of their bucket do they meet by the bucket; that join is left to Spark's splitting of skewed joins. A block computes exact cosines, keeps the links, and returns for each class the number of vectors that it is linked with and one link towards the smallest class it reaches there, never the pairs. A pair that shares several buckets counts in its first table only. The links' components are found by rounds of distributed joins; classes are named so that the smallest name of a component holds its smallest vec_id.

With b bits, a pair at cosine 0.98 shares a bucket of one table with probability p = (1 - arccos(0.98) / pi)**b; the number of tables makes (1 - p)**tables at most ``MISS``. The bits grow with the logarithm of the rows, so buckets of unrelated vectors stay small.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, have no links and are their own component; vectors of different lengths are not linked; rows that repeat a vec_id are linked as any equal vectors are, and each is returned; an empty table gives no rows; only vec_id, embedding and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, number_of, ordered, tidy, whole_groups
from parcelspark.llm.components import connected_components
from parcelspark.llm.vectors import matrices, unit, usable

MISS = 1e-6
PART, PARTS, MOST = 128, 16, 2048
SEED = 4711
#: Groups up to this size are compared pair by pair at once.
SMALL = 24


def shape_of_tables(rows: int, cosine: float) -> tuple[int, int]:
    """(bits of a table, tables) for so many vectors."""
    bits = max(8, math.ceil(math.log2(max(2, rows))) - 2)
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-p)))


def _coded(bits: int, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        kind = np.int32 if bits < 32 else np.int64
        weights = (1 << np.arange(bits, dtype=np.int64)).astype(kind)
        for batch in batches:
            flat, at, sizes = matrices(batch["embedding"])
            codes = np.zeros((batch.num_rows, tables), dtype=kind)
            for dim in np.unique(sizes).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
                rows = np.flatnonzero(sizes == dim)
                x = unit(flat[(at[rows][:, None] + np.arange(dim))])
                codes[rows] = ((x @ planes[dim]) > 0).reshape(len(rows), tables, bits) @ weights
            # The bytes stand for the vector as it is given: -0.0 is 0.0.
            keys = [xxhash.xxh3_128_digest((flat[at[i] : at[i + 1]] + 0.0).tobytes()) for i in range(batch.num_rows)]
            lists = pa.ListArray.from_arrays(pa.array(range(0, codes.size + 1, tables), type=pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["embedding"], pa.array(keys, pa.binary()), lists], names=["vec_id", "label", "embedding", "key", "codes"])

    return run


def _linked(cosine: float, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["block"], 8_000):
            block, side = t["block"].to_numpy(), t["side"].to_numpy()
            both, table, copies = t["two_parts"].to_numpy(zero_copy_only=False), t["table"].to_numpy(), t["copies"].to_numpy()
            nodes = t["node"].combine_chunks()
            codes = t["codes"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
            flat, at, sizes = matrices(t["embedding"])
            x = np.zeros((len(at) - 1, sizes.max()))
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x[rows, :dim] = unit(flat[at[rows][:, None] + np.arange(dim)])
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            length = np.repeat(np.diff(cuts), np.diff(cuts))
            links = np.zeros(len(x), dtype=np.int64)
            to = np.arange(len(x))

            def add(i: np.ndarray, j: np.ndarray, links=links, to=to, sizes=sizes, both=both, side=side, table=table, codes=codes, copies=copies) -> None:
                ok = (sizes[i] == sizes[j]) & (~both[i] | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                earlier = np.zeros(len(i), dtype=bool)
                for k in range(tables):
                    earlier |= (k < table[i]) & (codes[i, k] == codes[j, k])
                i, j = i[~earlier], j[~earlier]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                while True:  # every row takes the smallest row that it reaches by the links of this block
                    low = np.minimum(to[i], to[j])
                    if (low == to[i]).all() and (low == to[j]).all():
                        break
                    np.minimum.at(to, i, low)
                    np.minimum.at(to, j, low)

            near_i, near_j = [], []
            for d in range(1, SMALL):
                i = np.flatnonzero((block[d:] == block[:-d]) & (length[d:] <= SMALL))
                ok = np.einsum("ij,ij->i", x[i], x[i + d]) >= cosine
                near_i.append(i[ok])
                near_j.append(i[ok] + d)
            add(np.concatenate(near_i), np.concatenate(near_j))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo > SMALL:
                    found = []
                    for k in range(lo, hi, 512):
                        i, j = np.nonzero(np.triu(x[k : min(k + 512, hi)] @ x[lo:hi].T >= cosine, k - lo + 1))
                        found.append((k + i, lo + j))
                    add(*(np.concatenate([f[side_] for f in found]) for side_ in (0, 1)))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(to[some])), pa.array(links[some])], names=["a", "b", "links"])

    return run


@tidy
def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of its label at that cosine or more), component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fit = usable(F.col("embedding")) & F.col("label").isNotNull()
    bits, tables = shape_of_tables(rows.count(), cosine)
    coded = materialise(rows.filter(fit).mapInArrow(_coded(bits, tables), f"vec_id long, label string, embedding array<double>, key binary, codes array<{'int' if bits < 32 else 'long'}>").withColumn("node", F.concat("key", F.lit("/").cast("binary"), F.col("label").cast("binary"))).drop("key"))
    classes = coded.groupBy("node").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.first("codes").alias("codes"))
    classes = materialise(classes.withColumn("place", F.concat(ordered(F.col("least_id")), "node")))
    slim = classes.select(F.col("place").alias("node"), "label", F.posexplode("codes").alias("table", "code"))
    shared = slim.groupBy("table", "label", "code").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.greatest(F.least(F.ceil(F.col("n") / PART), F.lit(PARTS)), F.ceil(F.col("n") / MOST)).cast("int")
    dealt = slim.hint("merge").join(shared, ["table", "label", "code"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("node", "table", F.xxhash64("table", "label", "code", F.least("part", "other"), F.greatest("part", "other")).alias("block"), (F.col("part") > F.col("other")).cast("int").alias("side"), (F.col("part") != F.col("other")).alias("two_parts"))
    blocks = dealt.hint("merge").join(classes.select(F.col("place").alias("node"), "embedding", "codes", "copies"), "node")
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = materialise(blocks.repartition(width, "block").sortWithinPartitions("block").mapInArrow(_linked(cosine, tables), "a binary, b binary, links long"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b"))
    named = classes.select("node", "place", "copies").hint("merge").join(roots.withColumnRenamed("id", "place"), "place", "left").hint("merge").join(counts, F.col("place") == F.col("a"), "left")
    named = named.select("node", number_of(F.coalesce("root", "place")).alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = coded.select("vec_id", "node").hint("merge").join(named, "node").select("vec_id", "n_links", "component")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = linked.unionByName(alone).select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
