"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample by balanced bisection, one for ``LIST`` vectors on average; as they are in every task's memory, there are at most a quarter of the sample's size, and beyond that lists grow longer. A vector belongs to the list of its nearest centroid, and at a boundary, where others are within a factor ``REPLICATE`` of that distance, to up to ``REPLICAS`` lists. Centroids are searched through a graph of their neighbours: the search follows the links of the centroids within a ratio of the best so far, and of the ``BEAM`` nearest, and measures only what it reaches. A query reads the lists whose centroids are within a ratio of its nearest one; the ratio is the smallest of ``RATIOS`` that finds ``RECALL`` of the true neighbours within the sample. A query for which this finds fewer neighbours than there are reads lists of twice that ratio, then all.

Lists are dealt out in pages of about ``PAGE`` vectors and the queries of a list in parts of about ``PAGE``, and every page meets every part in a block of its own, so no task holds a long list or many queries; each task passes on its best ``k`` for each query.

Distances are Euclidean, on the original vectors in double precision. Products only screen candidates: those that could be among the best are computed exactly.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, take no part; only vectors of one length are compared, and those of another length than the sample's most frequent share a list that is searched whole; equal distances are in the order of vec_id; all rows with the query's vec_id are its own, and the answers are the nearest to any of them; rows that repeat an id and a vector count once, those that repeat an id at another distance count each; an empty table gives no rows; only vec_id and embedding are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, tidy, whole_groups
from parcelspark.llm.vectors import matrices, usable

SAMPLE = 16_384
#: Vectors to a list on average, while the sample has SUPPORT vectors for each list.
LIST, SUPPORT = 128, 4
PAGE = 512
REPLICATE, REPLICAS = 1.03, 4
RATIOS = (1.02, 1.04, 1.06, 1.08, 1.1, 1.12, 1.15, 1.18, 1.22, 1.27, 1.35, 1.5, 2.0)
RECALL = 0.97
DEGREE, ENTRIES, BEAM = 16, 8, 4


class Centroids:
    """Centroids and the graph of their nearest neighbours."""

    def __init__(self, points: np.ndarray, lists: int):
        rng = np.random.default_rng(3)
        parts = [(-len(points), 0, np.arange(len(points)))]  # largest first
        while len(parts) < lists and len(parts[0][2]) > 1:  # halves of equal size, cut across the line between two means
            part = heapq.heappop(parts)[2]
            x = points[part]
            two = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(4):
                near = ((x - two[0]) ** 2).sum(1) > ((x - two[1]) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                two = np.stack([x[~near].mean(0), x[near].mean(0)])
            order = np.argsort(x @ (two[1] - two[0]), kind="stable")
            for half in (part[order[: len(part) // 2]], part[order[len(part) // 2 :]]):
                heapq.heappush(parts, (-len(half), int(half[0]), half))
        self.at = np.stack([points[p].mean(0) for _, _, p in parts])
        n = len(self.at)
        near = np.zeros((n, min(DEGREE, n - 1)), dtype=np.int64)
        for k in range(0, n, 512):
            d = ((self.at[k : k + 512] ** 2).sum(1)[:, None] + (self.at**2).sum(1)[None]) - 2 * self.at[k : k + 512] @ self.at.T
            d[np.arange(len(d)), k + np.arange(len(d))] = -np.inf
            near[k : k + 512] = np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        far = rng.integers(0, n, (n, 4))  # a few long links and a ring keep the graph connected
        ring = (np.arange(n)[:, None] + 1) % n
        self.graph = np.concatenate([near, far, ring], axis=1)
        self.entries = np.unique(rng.integers(0, n, ENTRIES))

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of the lists within ratio of each row's nearest, nearest first."""
        n, k = len(x), len(self.at)
        if not np.isfinite(ratio):
            new = np.arange(n * k)
        else:
            new = (np.arange(n)[:, None] * k + self.entries).ravel()
        key, dist, followed = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        best = np.full(n, np.inf)
        while len(new):
            d = np.concatenate([np.sqrt(((x[new[at : at + 50_000] // k] - self.at[new[at : at + 50_000] % k]) ** 2).sum(1)) for at in range(0, len(new), 50_000)])
            np.minimum.at(best, new // k, d)
            key, dist, followed = np.r_[key, new], np.r_[dist, d], np.r_[followed, np.zeros(len(new), bool)]
            order = np.lexsort((dist, key // k))
            key, dist, followed = key[order], dist[order], followed[order]
            row = key // k
            go = ~followed & ((dist <= ratio * best[row]) | (_ranks(row) < BEAM))
            followed |= go
            reached = np.unique((row[go] * k)[:, None] + self.graph[key[go] % k])
            known = np.sort(key)
            place = np.minimum(np.searchsorted(known, reached), len(known) - 1)
            new = reached[known[place] != reached]
        row, node = key // k, key % k
        keep = dist <= ratio * best[row]
        order = np.lexsort((node[keep], dist[keep], row[keep]))
        return row[keep][order], node[keep][order], dist[keep][order]


def _ranks(row: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal numbers."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))


def calibrated(centroids: Centroids, points: np.ndarray, k: int) -> float:
    """The smallest ratio at which queries of the sample find RECALL of their true neighbours in the sample."""
    queries = np.arange(0, len(points), max(1, len(points) // 200))
    d = ((points[queries] ** 2).sum(1)[:, None] + (points**2).sum(1)[None]) - 2 * points[queries] @ points.T
    d[np.arange(len(queries)), queries] = np.inf
    true, at = np.unique(np.argsort(d, axis=1)[:, : min(k, len(points) - 1)], return_inverse=True)
    row, node, _ = _lists(centroids, points[true], REPLICATE, REPLICAS)
    member = np.zeros((len(true), len(centroids.at)), dtype=bool)
    member[row, node] = True
    for ratio in RATIOS:
        row, node, _ = centroids.within(points[queries], ratio)
        reads = np.zeros((len(queries), len(centroids.at)), dtype=bool)
        reads[row, node] = True
        found = [(member[at.reshape(len(queries), -1)[i]] & reads[i]).any(axis=1).mean() for i in range(len(queries))]
        if np.mean(found) >= RECALL:
            return ratio
    return RATIOS[-1]


def _lists(centroids: Centroids, x: np.ndarray, ratio: float, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = []
    for at in range(0, len(x), 1024):
        row, node, d = centroids.within(x[at : at + 1024], ratio)
        keep = _ranks(row) < most if most else slice(None)
        found.append((row[keep] + at, node[keep], d[keep]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in range(3))


def _assigned(index, ratio: float, most: int | None):
    """From (vec_id, embedding) to (list, vec_id, embedding), a row for each list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids: Centroids | None = index.value
        for batch in batches:
            flat, at, sizes = matrices(batch["embedding"])
            dim = centroids.at.shape[1] if centroids else -1
            same, other = np.flatnonzero(sizes == dim), np.flatnonzero(sizes != dim)
            row, node, _ = _lists(centroids, flat[at[same][:, None] + np.arange(dim)], ratio, most) if len(same) else (np.zeros(0, int),) * 3
            rows, lists = np.r_[same[row], other], np.r_[node, -sizes[other]]
            for k in range(0, len(rows), 20_000):
                take = pa.array(rows[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(lists[k : k + 20_000], pa.int64()), batch["vec_id"].take(take), batch["embedding"].take(take)], names=["list", "vec_id", "embedding"])

    return run


def best_of(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best distinct rows, in order."""
    order = np.lexsort((vec, score, query))
    q, v = query[order], vec[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (score[order][1:] != score[order][:-1])] if len(q) else np.zeros(0, bool)
    order = order[new]
    return order[_ranks(query[order]) < k]


def _searched(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def shrunk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, s, v = (np.concatenate([best[i], *[h[i] for h in held]]) for i in range(3))
            keep = best_of(q, s, v, k)
            return q[keep], s[keep], v[keep]

        for t in whole_groups(batches, ["block"], 4_000):
            block, ask, ids = (t[c].to_numpy(zero_copy_only=False) for c in ("block", "ask", "vec_id"))
            flat, at, sizes = matrices(t["embedding"])
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x = flat[at[lo] : at[hi]].reshape(hi - lo, sizes[lo])
                asks, has = lo + np.flatnonzero(ask[lo:hi]), lo + np.flatnonzero(~ask[lo:hi])
                if not len(has):
                    continue
                c = x[has - lo]
                for part in range(0, len(asks), 256):
                    own = asks[part : part + 256]
                    q = x[own - lo]
                    square = (q * q).sum(1)[:, None] + (c * c).sum(1)[None]
                    near = square - 2 * q @ c.T
                    near[ids[own][:, None] == ids[has][None]] = np.inf
                    bound = np.partition(near, k - 1, axis=1)[:, k - 1] if len(has) > k else np.full(len(own), np.finfo(float).max)
                    i, j = np.nonzero((near <= (bound + 1e-9 * square.max(axis=1))[:, None]) & np.isfinite(near))
                    exact = np.sqrt(((q[i] - c[j]) ** 2).sum(1))
                    keep = best_of(ids[own][i], exact, ids[has][j], k)
                    held.append((ids[own][i][keep], exact[keep], ids[has][j][keep]))
                    n += len(keep)
                    if n > 200_000:
                        best, held, n = shrunk(), [], 0
        best = shrunk()
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "vec_id", "score"])

    return run


@tidy
def nearest(vectors: DataFrame, queries: Column, k: int = 10, sample: int = SAMPLE, to_a_list: int = LIST) -> DataFrame:
    """For each vector that the column ``queries`` selects, its k nearest others: query_id, rank, vec_id, score. sample: vectors that the index is fitted on; to_a_list: how many a list has on average."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("__asks", queries).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce("__asks", F.lit(False)).alias("ask")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    n = rows.count()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].to_pylist()
    dims = [len(v) for v in some]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    index, ratio = None, 1.0
    if dims:
        points = np.array([v for v in some if len(v) == dim])
        index = Centroids(points, max(1, min(n // to_a_list, len(points) // SUPPORT)))
        ratio = calibrated(index, points, k) if len(points) > 1 else 1.0
    index = spark.sparkContext.broadcast(index)
    kind = "list long, vec_id long, embedding array<double>"
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    posted = materialise(rows.select("vec_id", "embedding").mapInArrow(_assigned(index, REPLICATE, REPLICAS), kind).dropDuplicates(["list", "vec_id", "embedding"]))
    # One row for each list: at most a quarter of the sample, and one for each other length of vectors.
    pages = materialise(posted.groupBy("list").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages")))
    asking = materialise(rows.filter("ask").select("vec_id", "embedding").distinct())

    def searched(asks: DataFrame, ratio: float) -> DataFrame:
        asked = materialise(asks.mapInArrow(_assigned(index, ratio, None), kind))
        parts = asked.groupBy("list").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("parts"))
        shape = F.broadcast(materialise(pages.join(parts, "list")))
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        dealt = lambda c: F.pmod(F.xxhash64("vec_id", "embedding"), c).cast("int")
        has = posted.join(shape, "list").withColumn("page", dealt("pages")).withColumn("part", upto("parts")).withColumn("ask", F.lit(False))
        asked = asked.join(shape, "list").withColumn("part", dealt("parts")).withColumn("page", upto("pages")).withColumn("ask", F.lit(True))
        columns = [F.xxhash64("list", "page", "part").alias("block"), "ask", "vec_id", "embedding"]
        met = has.select(*columns).unionByName(asked.select(*columns)).repartition(width, "block").sortWithinPartitions("block")
        found = met.mapInArrow(_searched(k), "query_id long, vec_id long, score double")
        # A vector that several lists hold is found with the same distance each time.
        found = found.groupBy("query_id", "vec_id", "score").agg(F.lit(1).alias("one"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return materialise(found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    out, left = searched(asking, ratio), asking
    # How many there are to be found: the rows of a length but the query's own. A row for each length.
    lengths = rows.groupBy(F.size("embedding").alias("length")).agg(F.approx_count_distinct("vec_id").alias("about"))
    few = F.broadcast(lengths.filter(F.col("about") < 1000 * k).select("length"))
    exact = rows.join(few, F.size("embedding") == F.col("length"), "left_semi").select("vec_id", "embedding").distinct().groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    for wider in (2 * ratio, math.inf):
        got = out.groupBy("query_id").agg(F.count("*").alias("got"))
        short = left.hint("merge").join(got, F.col("vec_id") == F.col("query_id"), "left").filter(F.coalesce("got", F.lit(0)) < k)
        own = short.groupBy("vec_id", F.size("embedding").alias("length")).agg(F.count("*").alias("own"))
        able = own.join(exact, "length", "left").groupBy("vec_id").agg(F.sum(F.coalesce(F.col("n"), F.lit(1 << 40)) - F.col("own")).alias("able"))
        left = materialise(short.join(able, "vec_id").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), "able")).select("vec_id", "embedding"))
        if left.isEmpty():
            break
        out = out.hint("merge").join(left.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(searched(left, wider))
    return out
