"""Best-fit packing of tokenized documents by hierarchical residual packing.

Each input partition packs its own pieces best-fit and emits the bins that are nearly full. The underfull bins become items: they meet those of neighbouring partitions in a tree, ``FAN_IN`` nodes at a time, and are packed best-fit again, until the root has packed the last of them. Only underfull bins move, so a node reads a few bins of each partition below it.

Where a node of the tree would meet more than ``MAX_OPEN`` bins, the tree ends, and all open bins are packed by their counts: how many have each fill, which is a number for each fill, is packed best-fit with multiplicities on the driver, and the bins are dealt to the planned sequences by their numbers within their fill, which come from distributed prefix sums. So every open bin is packed with all others, and no node holds them.

Defined results: a null or empty text is its end token alone; a null doc_id is kept as null; repeated rows are packed as often as they occur; an empty table gives no rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, prefix_sums
from parcelspark.llm.tokens import word_ids

CAPACITY = 4096
END_ID = 1
FAN_IN = 8
#: A bin with this many free tokens or fewer counts as nearly full.
SLACK = 16
#: Bins that a node of the tree meets at most; where there are more, all are packed by their counts.
MAX_OPEN = 20_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, node long, closed boolean"
OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths: longest first, each into the fullest bin that still takes it, else into a new one."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has r tokens of room
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room := room - n:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of the pieces of a document's ids, 4 bytes each."""
    step = 4 * capacity
    for k, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def _leaves(path: str, capacity: int, end_id: int, slack: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, end = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        coder, rows = word_ids(path), []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part["doc_id"].to_pylist(), coder.of(part["text"].to_pylist()), strict=True):
                    rows += [(doc, *piece) for piece in cut(ids + end, capacity)]
        sequence, offset, closed = [0] * len(rows), [0] * len(rows), [False] * len(rows)
        for b, members in enumerate(best_fit([r[3] for r in rows], capacity)):
            fill = sum(rows[i][3] for i in members)
            at = 0
            for i in members:
                sequence[i], offset[i], closed[i] = node << 32 | b, at, fill >= capacity - slack
                at += rows[i][3]
        docs, pieces, starts, lengths, crcs = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [docs, pieces, starts, lengths, crcs, sequence, offset, [node] * len(rows), closed]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[*OUT, "node", "closed"])

    return run


def _merge(capacity: int, slack: int, root: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fills = pdf.groupby("sequence_id")["length"].sum().sort_index()
        ids, lengths = fills.index.tolist(), fills.tolist()
        bins = best_fit(lengths, capacity)
        totals = [sum(lengths[i] for i in members) for members in bins]
        still = set() if root else {k for k, n in enumerate(totals) if n < capacity - slack}
        moved = {}
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                moved[ids[i]] = (ids[members[0]], at, k not in still)
                at += lengths[i]
        to = pdf["sequence_id"].map(moved)
        return pdf.assign(sequence_id=to.str[0].astype("int64"), offset=pdf["offset"] + to.str[1].astype("int64"), closed=to.str[2].astype(bool))

    return run


def planned(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit of so many bins of each fill, largest first: (fill, first number within the fill, how many, first sequence, offset) for ranges of bins that have the same place in consecutive sequences."""
    with_room: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]  # by room: fills so far, and how many such sequences
    rooms, done = 0, []

    def put(fills: list[int], n: int, room: int) -> None:
        nonlocal rooms
        if room:
            with_room[room].append((fills, n))
            rooms |= 1 << room
        else:
            done.append((fills, n))

    for fill in sorted(counts, reverse=True):
        left = counts[fill]
        while left and (fits := rooms >> fill):
            room = fill + (fits & -fits).bit_length() - 1
            fills, n = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            # As many more of this fill as a sequence takes; the last one may get fewer.
            each = min(room // fill, left)
            took = min(n, left // each)
            if n > took:
                put(fills, n - took, room)
            put(fills + [fill] * each, took, room - fill * each)
            left -= took * each
        each = capacity // fill
        if left // each:
            put([fill] * each, left // each, capacity - fill * each)
        if left % each:
            put([fill] * (left % each), 1, capacity - fill * (left % each))
    out, number, sequence = [], dict.fromkeys(counts, 0), 0
    for fills, n in [*done, *(x for held in with_room for x in held)]:
        at = 0
        for fill in fills:
            out.append((fill, number[fill], n, sequence, at))
            number[fill] += n
            at += fill
        sequence += n
    return out


def _dealt(plan, base: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fill, first, _, sequence, at = plan.value
        begins = fill << 48 | first
        for pdf in frames:
            number = pdf["number"].to_numpy()
            k = np.searchsorted(begins, pdf["fill"].to_numpy() << 48 | number, side="right") - 1
            yield pd.DataFrame({"bin": pdf["sequence_id"], "to": base + sequence[k] + number - first[k], "shift": at[k]})

    return run


def _by_counts(rest: DataFrame, capacity: int) -> DataFrame:
    """rest (OUT, node) with all its bins packed by their counts."""
    bins = materialise(rest.groupBy("node", "sequence_id").agg(F.sum("length").alias("fill")))
    counts = {r["fill"]: r["n"] for r in bins.groupBy("fill").agg(F.count("*").alias("n")).collect()}  # a row for each fill
    ranges = np.array(sorted(planned(counts, capacity)), dtype=np.int64).T
    base = (bins.agg(F.max("sequence_id")).first()[0] >> 32) + 1 << 32
    numbered = prefix_sums(bins.withColumn("one", F.lit(1)), ["fill"], "node", ["sequence_id"], "one", "number")
    sent = rest.sparkSession.sparkContext.broadcast(ranges)
    to = numbered.select("sequence_id", "fill", F.col("number").cast("long").alias("number")).mapInPandas(_dealt(sent, base), "bin long, to long, shift long")
    moved = rest.join(to, F.col("sequence_id") == F.col("bin"))
    return moved.withColumn("sequence_id", F.col("to")).withColumn("offset", F.col("offset") + F.col("shift"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and where it is: sequence_id, offset.

    tokenizer: path of the vocabulary file, the same on every executor."""
    leaves = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_leaves(tokenizer, capacity, end_id, slack), PIECE))
    out, rest = leaves.filter("closed"), leaves.filter("not closed")
    last = rest.agg(F.max("node")).first()[0]
    while last is not None:
        meeting = rest.groupBy(F.floor(F.col("node") / fan_in).alias("node")).agg(F.countDistinct("sequence_id").alias("n"))
        if (meeting.agg(F.max("n")).first()[0] or 0) > MAX_OPEN:
            out = out.select(*OUT).unionByName(_by_counts(rest, capacity).select(*OUT))
            break
        last //= fan_in
        rest = rest.withColumn("node", F.floor(F.col("node") / fan_in))
        merged = materialise(rest.groupBy("node").applyInPandas(_merge(capacity, slack, last == 0), PIECE))
        out, rest = out.unionByName(merged.filter("closed")), merged.filter("not closed")
        if last == 0:
            break
    return out.select(*OUT)
