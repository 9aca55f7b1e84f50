"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of n-grams: words and word pairs, and the same over the words' shapes (case, digits, symbols, last byte, length, repeated or not), where a shape's indicator also says which share of the text's words have it. Features are hashed to ``SLOTS``. Each is scaled by the log of the ratio of its smoothed counts in the two classes, each text is brought to length 1, and dual coordinate descent fits a linear model with hinge loss. A logistic curve, fitted on a fifth of the sample that the model has not seen, turns margins into probabilities.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the smallest hashes of their ids and one text for each, and of these in that order on the first whose features are at most ``SAMPLE_FEATURES``, in one task; features are made of whole texts, and all documents scored, in parallel. Only the sample's ids and the model (two numbers per slot) are sent to every task.

Defined results: a null or empty text has no features and gets the score of the model's constant; rows with a null label, or with none, are not learned from; where a doc_id has two labels, or two texts, the smaller counts; without both classes every score is the share of label 1, (n1 + 1) / (n + 2); repeated rows are scored alike; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from parcelspark.llm.common import materialise
from parcelspark.llm.words import chunks, mixed

SLOTS = 1 << 18
#: What the model is fitted on at most: documents, and features of them all (four bytes each).
SAMPLE, SAMPLE_FEATURES = 12_000, 50_000_000
COST = 1.0
EPOCHS = 8
THRESHOLD = 0.7

UPPER, SMALL_LETTER, DIGIT, SYMBOL, OTHER = 1, 2, 4, 8, 16
KIND = np.full(256, SYMBOL, dtype=np.uint8)
KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = UPPER, SMALL_LETTER, DIGIT, OTHER
SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75, 0.95])


def features(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, where each text's slots begin and the last ones end) for a few texts at a time; a text's slots are sorted and distinct."""
    for _, data, starts, ends, hashes, at in chunks(texts):
        n, docs = len(starts), len(at) - 1
        doc = np.repeat(np.arange(docs), np.diff(at))
        kinds = np.bitwise_or.reduceat(KIND[data], starts) if n else np.zeros(0, np.uint8)
        last = data[ends - 1]
        tail = np.where((KIND[last] == SYMBOL), last, 0).astype(np.uint64)
        title = (KIND[data[starts]] == UPPER) if n else np.zeros(0, bool)
        again = np.zeros(n, dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        size = np.searchsorted([1, 3, 6, 10, 16, 30], ends - starts).astype(np.uint64)
        shape = kinds.astype(np.uint64) | tail << np.uint64(5) | title.astype(np.uint64) << np.uint64(13) | size << np.uint64(14) | again.astype(np.uint64) << np.uint64(17)
        coarse = kinds.astype(np.uint64) | tail << np.uint64(5) | again.astype(np.uint64) << np.uint64(17)
        pair = np.flatnonzero(doc[1:] == doc[:-1]) if n else np.zeros(0, int)
        odd = np.uint64(0x9E3779B97F4A7C15)
        kinds_of = [(hashes, doc), (hashes[pair] * odd + hashes[pair + 1], doc[pair]), (mixed(shape + np.uint64(1 << 40)), doc), (mixed(shape[pair] << np.uint64(20) | shape[pair + 1] | np.uint64(1 << 42)), doc[pair])]
        # The share of words that have a shape, in steps.
        key, count = np.unique(doc.astype(np.uint64) << np.uint64(20) | coarse, return_counts=True)
        of = (key >> np.uint64(20)).astype(np.int64)
        step = np.searchsorted(SHARES, count / np.maximum(np.diff(at)[of], 1)).astype(np.uint64)
        kinds_of.append((mixed((key & np.uint64((1 << 20) - 1)) << np.uint64(8) | step | np.uint64(1 << 43)), of))
        word, owner = np.concatenate([x for x, _ in kinds_of]), np.concatenate([d for _, d in kinds_of])
        slots = np.unique(owner.astype(np.int64) * SLOTS + (mixed(word) % np.uint64(SLOTS)).astype(np.int64))
        yield (slots % SLOTS).astype(np.int32), np.searchsorted(slots, np.arange(docs + 1) * SLOTS)


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [slots[at[k] : at[k + 1]].tobytes() for slots, at in features(batch["text"]) for k in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(rows, pa.binary())], names=["doc_id", "quality", "slots"])


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float, epochs: int, dims: int) -> np.ndarray:
    """Weights that minimise |w|**2 / 2 + cost * hinge loss, one dual variable at a time; the last weight is the constant's."""
    w, alpha, order = np.zeros(dims + 1), np.zeros(len(rows)), np.random.default_rng(5)
    length = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (float(w[at] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / length[i], 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                moved = max(moved, abs(step))
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton's steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.column_stack([margins, np.ones(len(y))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, bytes]] = []
    for batch in batches:
        rows += zip(*(batch[c].to_pylist() for c in ("doc_id", "quality", "slots")), strict=True)
    rows.sort()
    y = np.array([1.0 if q else -1.0 for _, q, _ in rows])
    sets = [np.frombuffer(s, np.int32) for _, _, s in rows]
    n1 = int((y > 0).sum())
    if min(n1, len(y) - n1) < 2:
        yield _model(np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0, math.log((n1 + 1) / (len(y) - n1 + 1)))
        return
    unseen = np.zeros(len(y), dtype=bool)
    for label in (1.0, -1.0):
        unseen[np.flatnonzero(y == label)[::5]] = True

    def train(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        has = [np.bincount(np.concatenate([sets[i] for i in use if y[i] == c]), minlength=SLOTS) + 1.0 for c in (1.0, -1.0)]
        ratio = np.log(has[0] / has[0].sum()) - np.log(has[1] / has[1].sum())
        x = []
        for i in use:
            v = ratio[sets[i]]
            x.append((sets[i], v / max(math.sqrt(float(v @ v)), 1e-9)))
        w = descend(x, y[use], COST, EPOCHS, SLOTS)
        return ratio * w[:-1], ratio * ratio, w[-1]

    rw, r2, constant = train(np.flatnonzero(~unseen))
    margins = np.array([rw[sets[i]].sum() / max(math.sqrt(r2[sets[i]].sum()), 1e-9) + constant for i in np.flatnonzero(unseen)])
    slope, offset = _curve(margins, y[unseen])
    yield _model(rw, r2, constant, slope, offset)


def _model(rw: np.ndarray, r2: np.ndarray, constant: float, slope: float, offset: float) -> pa.RecordBatch:
    data = [[rw.astype(np.float32).tobytes()], [r2.astype(np.float32).tobytes()], [constant], [slope], [offset]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=["rw", "r2", "constant", "slope", "offset"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_FEATURES):
    """A broadcast model from labels (doc_id, quality 0 or 1) of docs (doc_id, text). sample, most: labelled documents, and features of them, that it is fitted on at most."""
    named = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")))
    named = named.orderBy(order, "doc_id").limit(sample)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(named), "doc_id")
    # One text per id, so that no id that repeats can swell the sample.
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "quality").agg(F.min("text").alias("text"))
    made = materialise(chosen.mapInArrow(_featured, "doc_id long, quality int, slots binary"))
    # The window is over the sample's ids and sizes alone.
    sizes = made.select("doc_id", F.sum(F.octet_length("slots") / 4).over(Window.orderBy(order, "doc_id")).alias("so_far")).filter(F.col("so_far") <= most).select("doc_id")
    model = made.join(F.broadcast(sizes), "doc_id", "left_semi").coalesce(1).mapInArrow(_fit, "rw binary, r2 binary, constant double, slope double, offset double").first()
    if model is None:  # no document is labelled
        model = dict(zip(("rw", "r2", "constant", "slope", "offset"), (bytes(4 * SLOTS), bytes(4 * SLOTS), 0.0, 0.0, 0.0), strict=True))
    parts = (np.frombuffer(model["rw"], np.float32), np.frombuffer(model["r2"], np.float32), model["constant"], model["slope"], model["offset"])
    return docs.sparkSession.sparkContext.broadcast(parts)


def score(text: Column, model) -> Column:
    """The probability of label 1 as a column, for use beside others: only the text goes to Python."""

    @arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        rw, r2, constant, slope, offset = model.value
        out = []
        for slots, at in features(texts):
            sums = np.r_[0.0, np.cumsum(rw[slots], dtype=np.float64)], np.r_[0.0, np.cumsum(r2[slots], dtype=np.float64)]
            weight, length = (s[at[1:]] - s[at[:-1]] for s in sums)
            margin = weight / np.maximum(np.sqrt(np.maximum(length, 0.0)), 1e-9) + constant
            out.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), type=pa.float64())

    return probability(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from learning: a quarter by the crc32 of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
