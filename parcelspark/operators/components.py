"""Connected components of links held in a table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.lineage import discard, materialise

#: Links that are settled in one task when no more are left.
FEW = 100_000


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id that each id of a few links reaches."""
    to: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while to.setdefault(x, x) != x:
            to[x] = x = to[to[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            to[high] = low
    ids = list(to)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([find(x) for x in ids], pa.binary())], names=["node", "to"])


def connected(links: DataFrame) -> DataFrame:
    """links: a, b, binary ids whose order is random (hashes). Returns id, root for every id in a link; root is the smallest id of its component.

    Every round maps each id to the smallest of itself and its neighbours and goes on with the links between those: since ids are random, two thirds of a chain or a cycle vanish in a round, and a star at once. At most FEW links that are left are settled in one task. The rounds' maps are then applied from the last to the first, so each is read with those that are smaller; all rounds together cost little more than the first. A round is an aggregation and two joins on ids."""
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <= b").distinct())
    maps = []
    while links.limit(FEW + 1).count() > FEW:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        maps.append(near)
        left = links.hint("merge").join(near.withColumnRenamed("to", "x").hint("merge"), F.col("a") == F.col("node")).drop("node")
        left = left.hint("merge").join(near.withColumnRenamed("to", "y").hint("merge"), F.col("b") == F.col("node"))
        left = materialise(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct())
        discard(links)
        links = left
    found = materialise(links.coalesce(1).mapInArrow(_settled, "node binary, to binary"))
    discard(links)
    for near in reversed(maps):
        after = found.select(F.col("node").alias("last"), F.col("to").alias("root"))
        further = materialise(near.hint("merge").join(after.hint("merge"), F.col("to") == F.col("last"), "left").select("node", F.coalesce("root", "to").alias("to")))
        discard(near, found)
        found = further
    out = found.select(F.col("node").alias("id"), F.col("to").alias("root"))
    out.stored = found.stored
    return out
