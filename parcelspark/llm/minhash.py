"""Near-duplicate documents by an LSH forest over MinHash signatures.

Texts with equal shingle sets become one node, so copies cost one row. A node's signature has ``HASHES`` least hash values; tree t reads it in the cyclic order that starts at its t-th group of ``DEPTH`` values, and all nodes of a tree that share at least those values with another are sorted by that order. A region is a run of nodes with the same first ``DEPTH`` values. Within it each node is compared with its ``WINDOW`` neighbours on either side, those that share the longest prefixes with it: the more crowded a region is, the deeper are the prefixes that neighbours share. Regions of at most ``WINDOW`` + 1 nodes are thereby compared in full. All links are first sought in these sorted orders.

In larger regions neighbours alone would lose links, so what they leave apart goes an exact way. It is taken only by regions that are not one component yet:

* Regions of at most ``REGION`` nodes become a block each.
* Larger regions are joined to zones (regions with a node in common), each zone's nodes are dealt into parts, and every two parts meet once in a block of their own, whatever the number of trees that they share. Nodes of the zone's largest component meet those outside it alone. So the cost is the square of the nodes outside the largest component, in blocks of a bounded size.

Two nodes are compared by their signatures, which must agree in as many values as all but ``MISS`` of the pairs at the threshold do, and by their sizes. Candidates are confirmed on the full sets; in larger regions, only each node's with a few partners that agree best, the smallest among them, so that groups gather around few nodes. In blocks, only pairs of different components are compared, and where a block has many candidates, the full sets of its nodes meet in it; it counts what all its pairs share and returns for each node one link towards the smallest that it reaches, never the pairs. To confirm, all texts are shuffled by a hash to the nodes that have candidates, and once more if blocks have candidates that the sorted orders did not; a task of that join holds the ids of its share of such nodes.

A pair at similarity 0.8 is missed by all 21 trees with probability (1 - 0.8**3)**21, 3e-7, and by the comparison of signatures with ``MISS``, however many nodes share its prefixes; pairs above are missed less often.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a shorter text is one shingle; rows that repeat, also with null ids, are each returned, in one component; component_id is the least non-null doc_id; an empty table gives no rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, number_of, ordered, tidy, whole_groups
from parcelspark.llm.components import connected_components, further
from parcelspark.llm.words import shingle_sets

HASHES = 64
DEPTH = 3
TREES = HASHES // DEPTH
#: Nodes of a region that is one block, and neighbours on either side in sorted orders.
REGION, WINDOW = 256, 8
#: Shingles that the sets of a region, or of a part of a zone, have about at most.
SHINGLES = 1 << 21
#: A part of a zone has about PART nodes, and more in zones of over PART * PARTS, up to MOST.
PART, PARTS, MOST = 128, 16, 2048
#: Parts in which the nodes of one zone meet what is known of it.
SALT = 64
#: Share of the pairs at the threshold whose signatures may agree less than is asked for.
MISS = 1e-5
#: Groups up to this size are compared pair by pair at once.
SMALL = 24

MULTIPLIERS = np.random.default_rng(97).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, its upper 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * MULTIPLIERS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signs = [], [], []
            for s in shingle_sets(batch["text"], words):
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(signature(s) if len(s) else np.zeros(HASHES, np.uint32))
            flat = pa.array(np.concatenate(signs).view(np.int32) if signs else [], type=pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(range(0, HASHES * len(signs) + 1, HASHES), type=pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), lists], names=["doc_id", "mark", "n_shingles", "digest", "signature"])

    return run


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [s.tobytes() for s in shingle_sets(batch["text"].slice(at, 256), words)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "set"])

    return run


def least_agreement(share: float) -> int:
    """The most values of a signature that all but MISS of the pairs at that similarity agree in."""
    below, k = 0.0, -1
    while below <= MISS:
        k += 1
        below += math.comb(HASHES, k) * share**k * (1 - share) ** (HASHES - k)
    return k


def _grade(same: np.ndarray, share: float) -> np.ndarray:
    """0, 1 or 2: below the threshold, about at it, well above it."""
    return np.searchsorted([HASHES * share, HASHES * (1 + share) / 2], same, side="right").astype(np.int32)


def _candidates(block: np.ndarray, nodes: pa.Array, a: np.ndarray, b: np.ndarray, grade: np.ndarray, dense: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(block[a[cut]]), nodes.take(pa.array(a[cut])), nodes.take(pa.array(b[cut])), pa.array(grade[cut]), pa.array(dense[cut])], names=["block", "a", "b", "grade", "dense"])


def _compared(percent: int):
    """From MEETING in whole blocks to candidate pairs of nodes with different roots; of a block with many only each node's best."""
    share = percent / 100
    agree = least_agreement(share)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["block"], 20_000):
            block, sizes, side, two = (t[c].to_numpy(zero_copy_only=False) for c in ("block", "n", "side", "two"))
            nodes = t["node"].combine_chunks()
            roots = t["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            signs = t["signature"].combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            length = np.repeat(np.diff(cuts), np.diff(cuts))

            def kept(i: np.ndarray, j: np.ndarray, same: np.ndarray, sizes=sizes, roots=roots, side=side, two=two) -> np.ndarray:
                lo, hi = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
                return (same >= agree) & (100 * lo >= percent * hi) & (roots[i] != roots[j]) & (~two[i] | (side[i] != side[j]))

            out: list[tuple[np.ndarray, np.ndarray, bool]] = []
            for d in range(1, SMALL):
                i = np.flatnonzero((block[d:] == block[:-d]) & (length[d:] <= SMALL))
                for at in range(0, len(i), 20_000):
                    a = i[at : at + 20_000]
                    ok = kept(a, a + d, (signs[a] == signs[a + d]).sum(axis=1))
                    out.append((a[ok], a[ok] + d, False))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo <= SMALL:
                    continue
                best, pairs, found = [], [], 0
                number = np.arange(lo, hi)  # rows of a block are in the order of nodes
                for at in range(lo, hi, 64):
                    i = np.arange(at, min(hi, at + 64))
                    same = np.zeros((len(i), hi - lo), dtype=np.int16)
                    for k in range(HASHES):
                        same += signs[i, k, None] == signs[None, lo:hi, k]
                    a, b = np.repeat(i, hi - lo), np.tile(number, len(i))
                    ok = (kept(a, b, same.ravel()) & (a != b)).reshape(same.shape)
                    rank = np.where(ok, _grade(same, share) * (hi - lo) + (hi - 1 - number)[None], -1)
                    some = ok.any(axis=1)
                    best.append((i[some], lo + rank.argmax(axis=1)[some]))
                    if found <= 4 * (hi - lo):
                        x, y = np.nonzero(np.triu(ok, at - lo + 1))
                        found += len(x)
                        pairs.append((at + x, lo + y))
                many = found > 4 * (hi - lo)
                out += [(a, b, many) for a, b in (best if many else pairs)]
            a, b = (np.concatenate([x[k] for x in out] or [np.zeros(0, int)]) for k in (0, 1))
            dense = np.concatenate([np.full(len(x[0]), x[2]) for x in out] or [np.zeros(0, bool)])
            grade = np.concatenate([_grade((signs[a[at : at + 100_000]] == signs[b[at : at + 100_000]]).sum(axis=1), share) for at in range(0, len(a), 100_000)] or [np.zeros(0, np.int32)])
            yield from _candidates(block, nodes, a, b, grade, dense)

    return run


def _neighbouring(percent: int):
    """From (key, nodes, node, n, signature) in the order of a tree to candidates among neighbours there: all of regions that a window holds, else the best one of each node. dense: whether it is such a best one."""
    share = percent / 100
    agree = least_agreement(share)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            key, sizes, nodes = t["key"].to_numpy(), t["n"].to_numpy(), t["node"].combine_chunks()
            whole = t["nodes"].to_numpy() <= WINDOW + 1
            signs = t["signature"].combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
            order = np.empty(len(key), dtype=np.int64)  # places of the nodes among themselves; equal nodes are equal
            names, at = np.unique(np.array(nodes.to_pylist(), dtype="S25"), return_inverse=True)
            order[:] = len(names) - 1 - at
            best, to = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
            for d in range(1, min(WINDOW, len(key) - 1) + 1):
                i = np.flatnonzero((key[d:] == key[:-d]) & (at[d:] != at[:-d]))
                same = (signs[i] == signs[i + d]).sum(axis=1)
                ok = (same >= agree) & (100 * np.minimum(sizes[i], sizes[i + d]) >= percent * np.maximum(sizes[i], sizes[i + d]))
                i, grade = i[ok], _grade(same[ok], share).astype(np.int64)
                small = whole[i]
                yield from _candidates(np.zeros(len(key), np.int64), nodes, i[small], i[small] + d, grade[small].astype(np.int32), np.zeros(int(small.sum()), bool))
                i, grade = i[~small], grade[~small]
                for x, y in ((i, i + d), (i + d, i)):
                    rank = grade * len(key) + order[y]
                    better = rank > best[x]
                    best[x[better]], to[x[better]] = rank[better], y[better]
            some = np.flatnonzero(best >= 0)
            yield from _candidates(np.zeros(len(key), np.int64), nodes, some, to[some], (best[some] // max(len(key), 1)).astype(np.int32), np.ones(len(some), bool))
            held = t.slice(max(0, t.num_rows - WINDOW))

    return run


def shared(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many values each of the sorted sets of rows has in common with each of columns; ``most``: values that are worked on at once, by ranges."""
    m, total = len(sets), sum(map(len, sets))
    both = np.zeros((len(rows), len(columns)), dtype=np.int64)
    steps = max(1, -(-total // most))
    edges = [np.uint64(k * 2**64 // steps) for k in range(1, steps)]
    cuts = [np.r_[0, np.searchsorted(s, edges), len(s)].astype(int) if steps > 1 else [0, len(s)] for s in sets]
    for k in range(steps):
        parts = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        _, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = n[at] > 1
        row, value = np.repeat(np.arange(m), [len(p) for p in parts])[several], (np.cumsum(n > 1) - 1)[at[several]]
        order = np.argsort(value, kind="stable")
        row, value = row[order], value[order]
        width, wide = int((n > 1).sum()), max(256, (1 << 23) // m)
        for c in range(0, width, wide):
            lo, hi = np.searchsorted(value, [c, c + wide])
            x = np.zeros((m, min(wide, width - c)), dtype=np.float32)
            x[row[lo:hi], value[lo:hi] - c] = 1
            both += (x[rows] @ x[columns].T).astype(np.int64)
    return both


def _joined(percent: int):
    """From (block, side, two, node, set) in whole blocks to links (a, b): each node with the smallest of its block that it reaches by pairs that are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["block"], 2 * REGION):
            block, side, two = (t[c].to_numpy(zero_copy_only=False) for c in ("block", "side", "two"))
            nodes, sets = t["node"].combine_chunks(), t["set"].combine_chunks()
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = [np.frombuffer(sets[i].as_buffer(), np.uint64) for i in range(lo, hi)]
                size = np.array([len(s) for s in own])
                parts = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                rows, columns = parts if two[lo] else (np.arange(hi - lo),) * 2
                both = shared(own, rows, columns)
                i, j = np.nonzero(100 * both >= percent * (size[rows, None] + size[None, columns] - both))
                i, j = rows[i], columns[j]
                to = np.arange(hi - lo)
                while (to[i] != to[j]).any():
                    low = np.minimum(to[i], to[j])
                    np.minimum.at(to, i, low)
                    np.minimum.at(to, j, low)
                moved = np.flatnonzero(to != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(lo + to[moved])), nodes.take(pa.array(lo + moved))], names=["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                s, t = (s, t) if len(s) < len(t) else (t, s)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting: the tables here grow with the input, but are written so compactly that Spark would send them whole to every task."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _regions(nodes: DataFrame) -> DataFrame:
    """tree, key, nodes, narrow, node, n, signature of the nodes that share their first values in a tree with others: nodes says with how many, narrow whether they may be one block."""
    value = lambda t, k: F.element_at("signature", F.lit((t * DEPTH + k) % HASHES + 1))
    trees = [F.xxhash64(F.lit(t), *[value(t, k) for k in range(DEPTH)]) for t in range(TREES)]
    rows = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode(F.array(*trees)).alias("tree", "key"))
    several = rows.groupBy("tree", "key").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles")).filter("nodes > 1")
    narrow = (F.col("nodes") <= REGION) & ((F.col("shingles") <= SHINGLES) | (F.col("nodes") == 2))
    rows = _met(rows, several.select("tree", "key", "nodes", narrow.alias("narrow")), ["tree", "key"])
    return materialise(_met(rows, nodes.select("node", "signature"), "node").select("tree", "key", "nodes", "narrow", "node", "n", "signature"))


def _sorted(rows: DataFrame, width: int) -> DataFrame:
    """rows in each tree's order, dealt to tasks by ranges of it: a narrow region is in one task, a larger one may be in several."""
    order = F.slice(F.concat("signature", "signature"), F.col("tree") * DEPTH + 1, HASHES // 2)
    upto = F.when(F.col("narrow"), F.slice("order", 1, DEPTH)).otherwise(F.slice("order", 1, 3 * DEPTH))
    return rows.withColumn("order", order).repartitionByRange(width, "tree", upto).sortWithinPartitions("tree", "order", "node")


#: What meets in a block: of two sides only the pairs across are compared, if ``two``.
MEETING = ["block", "side", "two", "node", "n", "signature", "root"]
CANDIDATES = "block long, a binary, b binary, grade int, dense boolean"


def _parts(nodes: Column, shingles: Column) -> Column:
    return F.greatest(F.least(F.ceil(nodes / PART), F.lit(PARTS)), F.ceil(nodes / MOST), F.ceil(shingles / SHINGLES), F.lit(1)).cast("long")


def _blocks(wide: DataFrame, roots: DataFrame) -> DataFrame:
    """(block, side, two, node, root) so that any two nodes of a region in wide that have different roots meet in one block, once."""
    members = _met(wide.select("tree", "key", "node", "n"), roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = members.groupBy("tree", "key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("node").alias("first")).filter("least <> most")
    rows = materialise(_met(members, apart.select("tree", "key", "first"), ["tree", "key"]).select("node", "n", "root", "first"))
    zones = connected_components(rows.select(F.col("node").alias("a"), F.col("first").alias("b")))
    placed = materialise(_met(rows.select("node", "n", "root").distinct(), zones.select(F.col("id").alias("node"), F.col("root").alias("zone")), "node"))
    each = placed.groupBy("zone", "root").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    whole = each.groupBy("zone").agg(F.max(F.struct("nodes", "shingles", "root")).alias("main"), F.sum("nodes").alias("nodes"), F.sum("shingles").alias("shingles"))
    whole = whole.select("zone", F.col("main.root").alias("main"), _parts(F.col("main.nodes"), F.col("main.shingles")).alias("mains"), _parts(F.col("nodes") - F.col("main.nodes"), F.col("shingles") - F.col("main.shingles")).alias("others"))
    # A zone may hold a third of all nodes: its row is repeated, so that they join in SALT tasks.
    whole = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = _met(placed.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALT)).cast("int")), whole, ["zone", "salt"]).withColumn("in_main", F.col("root") == F.col("main"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))))
    meets = lambda kind, a, b, side, two: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"), two.alias("two"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    of_main = F.transform(upto("others"), lambda k: meets("main", F.col("part"), k, F.lit(0), F.lit(True)))
    of_other = F.concat(
        F.transform(upto("mains"), lambda k: meets("main", k, F.col("part"), F.lit(1), F.lit(True))),
        F.transform(upto("others"), lambda k: meets("others", F.least("part", k), F.greatest("part", k), F.col("part") > k, F.col("part") != k)),
    )
    met = dealt.select("zone", "node", "root", F.explode(F.when(F.col("in_main"), of_main).otherwise(of_other)).alias("at"))
    return met.select(F.xxhash64("zone", "at.kind", "at.a", "at.b").alias("block"), "at.side", "at.two", "node", "root")


def _sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, set for the distinct nodes of wanted (node), from the text of one document of each."""
    ids = _met(nodes.select("node", "of"), wanted, "node", "left_semi").select("of.mark", F.col("of.doc_id").alias("of_id")).distinct()
    marked = docs.withColumn("mark", F.xxhash64("text"))
    texts = marked.join(ids.hint("shuffle_hash"), (marked["mark"] == ids["mark"]) & marked["doc_id"].eqNullSafe(ids["of_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words), "digest binary, set binary").filter("digest is not null")
    return materialise(_met(sets, wanted.select("node", F.substring("node", 10, 16).alias("digest")), "digest").dropDuplicates(["node"]).select("node", "set"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough on their full sets."""
    both = _met(_met(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a"), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return materialise(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a binary, b binary, ok boolean").filter("ok").select("a", "b").distinct())


def _best(found: DataFrame) -> DataFrame:
    """Of the candidates (a, b, grade) each node's with its smallest partner among those that agree best, and with two more of these, taken by a hash."""
    either = found.select(F.col("a").alias("node"), F.col("b").alias("other"), "grade").unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("other"), "grade"))
    by = lambda *order: F.min(F.struct((-F.col("grade")).alias("g"), *order, "other"))["other"]
    best = either.groupBy("node").agg(F.array(by(), by(F.xxhash64(F.lit(1), "other").alias("h")), by(F.xxhash64(F.lit(2), "other").alias("h"))).alias("best"))
    return best.select("node", F.explode(F.array_distinct("best")).alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _by_orders(rows: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, root) of the components that the sorted orders of rows find, and the sets of their candidates."""
    found = _sorted(rows, width).select("key", "nodes", "node", "n", "signature").mapInArrow(_neighbouring(percent), CANDIDATES)
    found = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "grade", "dense").distinct())
    sets = _sets_of(_ends(found), docs, nodes, words)
    pairs = found.filter("not dense").select("a", "b").unionByName(_best(found.filter("dense"))).distinct()
    return connected_components(_verified(pairs, sets, percent)), sets


@tidy
def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Documents are linked whose sets of shingles of ``words`` words have a Jaccard similarity of at least ``percent`` / 100."""
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_blocks = lambda df: df.repartition(width, "block").sortWithinPartitions("block", "node")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialise(docs.withColumn("mark", F.xxhash64("text")).mapInArrow(_sketch(words), "doc_id long, mark long, n_shingles long, digest binary, signature array<int>"))
    # A node's name begins with its smallest id, so the smallest name of a component has the component's.
    nodes = sketched.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("mark", "doc_id")).alias("of"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    nodes = materialise(nodes.withColumn("node", F.concat(ordered(F.col("first_id")), "digest")))
    rows = _regions(nodes)
    roots, sets = _by_orders(rows, docs, nodes, words, percent, width)

    # What is still apart in regions that are larger than a window meets in blocks.
    wide = rows.filter("not narrow")
    some = rows.filter(f"narrow and nodes > {WINDOW + 1}").select(F.xxhash64("tree", "key").alias("block"), F.lit(0).alias("side"), F.lit(False).alias("two"), "node")
    some = _met(some, roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = some.groupBy("block").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("block")
    blocks = _met(some, split, "block", "left_semi").select("block", "side", "two", "node", "root")
    if not wide.isEmpty():
        blocks = blocks.unionByName(_blocks(wide, roots))
    blocks = materialise(blocks)
    if not blocks.isEmpty():
        met = _met(blocks, nodes.select("node", "n", "signature"), "node").select(*MEETING)
        found = materialise(in_blocks(met).mapInArrow(_compared(percent), CANDIDATES))
        pairs = found.filter("not dense").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        full = materialise(_met(blocks, found.filter("dense").select("block").distinct(), "block", "left_semi").select("block", "side", "two", "node"))
        wanted = _ends(pairs).unionByName(full.select("node")).distinct()
        lacking = _met(wanted, sets.select("node"), "node", "left_anti")
        sets = sets.unionByName(_sets_of(materialise(lacking), docs, nodes, words))
        links = _verified(pairs, sets, percent)
        if not full.isEmpty():
            whole = in_blocks(_met(full, sets, "node")).select("block", "side", "two", "node", "set")
            links = links.unionByName(materialise(whole.mapInArrow(_joined(percent), "a binary, b binary")))
        roots = further(roots, links)

    rooted = _met(nodes.select("digest", "node"), roots.withColumnRenamed("id", "node"), "node", "left").select(F.col("digest").alias("of"), number_of(F.coalesce("root", "node")).alias("least"))
    out = _met(sketched.select("doc_id", "n_shingles", "digest"), rooted, F.col("digest") == F.col("of"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are not kept; rows that repeat one doc_id stay or go together, and rows with a null doc_id stay."""
    gone = near_duplicates(docs, words, percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
