"""Cross-entropy difference of each document under a target and a background n-gram model.

Both are word bigram models that back off to words, over one vocabulary: the ``TARGET_WORDS`` most frequent words of the target and the ``BACKGROUND_WORDS`` most frequent of the background (A-Z lower-cased), and one sign for all others. Counts are exact and cover every document: each task adds up the words and pairs of its texts, and Spark sums them in tables that grow with the corpora. The models are matched: the same vocabulary, order and smoothing, and the background's counts are scaled to the target's total, so that the sizes of the two corpora do not tell.

A pair is one number, made of its words' places in the vocabulary, so counts of words, which every task holds, and the count of the pair give its losses. Most pairs of a corpus occur once in it. So each task adds up a document's losses as if none of its pairs were in the target and each were its own alone in the background (or, where the documents are not the background, in neither), and only pairs that occur otherwise are kept, with what they add to these. Those of them that make up at least one part in ``HEAVY_PAIRS`` of all words, of which there are at most so many, are sent to every task; the others are joined. Losses are whole numbers of ``1 / UNIT``, so sums do not depend on their order.

loss = mean over words of -ln p(word | word before), and score = target_loss - background_loss: the lower, the more a document resembles the target.

Defined results: a null, empty or blank text has 0 tokens and null losses and score; its words follow a marker of the text's start; with an empty target, all words have the background's vocabulary and the target's model is uniform over it; an empty background leaves the uniform distribution; of words that are equally frequent at the vocabulary's end the smaller hashes count; texts of any length count whole; repeated rows count and are scored each; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, tidy
from parcelspark.llm.words import chunks

#: Places of the word before a text's first, and of words outside the vocabulary, whose own places follow.
START, OTHER, FIRST = 0, 1, 2
TARGET_WORDS, BACKGROUND_WORDS, HEAVY_PAIRS = 1 << 16, 1 << 18, 1 << 20
#: Pairs that a task holds before it passes them on.
HELD = 1 << 20
#: Weight of the lower order in each: of the uniform distribution, and of the words.
UNIFORM, BACKOFF = 1.0, 4.0
UNIT = 1 << 30


def _worded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (hashes) with their counts; null for the texts that have a word."""
    texts = 0
    for batch in batches:
        for _, _, _, _, hashes, at in chunks(batch["text"]):
            texts += int((np.diff(at) > 0).sum())
            word, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts])], names=["word", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


class Words:
    """The vocabulary with each word's counts in the target and the background, by place."""

    def __init__(self, hashes: np.ndarray, t: np.ndarray, b: np.ndarray, starts: tuple[int, int], totals: tuple[int, int]):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.total = float(totals[0] or 1)
        self.all_words = totals[0] + totals[1]
        self.scale = (1.0, self.total / (totals[1] or 1))
        self.lower, self.held = [], []
        for counts, start, total, scale in zip((t[order], b[order]), starts, totals, self.scale, strict=True):
            words = np.r_[0, total - counts.sum(), counts].astype(np.float64)
            self.lower.append((words * scale + UNIFORM / (len(counts) + 1)) / (self.total + UNIFORM))
            words[START] = start
            self.held.append(words * scale + BACKOFF)

    def places(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The pair that each word ends: the place of the word before in the upper half, its own in the lower."""
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            word = np.where(self.hashes[near] == hashes, near + FIRST, OTHER)
        else:
            word = np.full(len(hashes), OTHER)
        before = np.r_[START, word[:-1]] if len(word) else word
        before[at[:-1][np.diff(at) > 0]] = START
        return (before.astype(np.int64) << 32) | word.astype(np.int64)

    def losses(self, pair: np.ndarray, t: np.ndarray | int, b: np.ndarray | int) -> list[np.ndarray]:
        """-ln p of the pairs' words under both models, in units."""
        before, word = pair >> 32, pair & 0xFFFFFFFF
        return [np.floor(-np.log((n * scale + BACKOFF * lower[word]) / held[before]) * UNIT + 0.5).astype(np.int64) for n, scale, lower, held in zip((t, b), self.scale, self.lower, self.held, strict=True)]


def vocabulary(target: DataFrame, background: DataFrame, of_target: int = TARGET_WORDS, of_background: int = BACKGROUND_WORDS) -> Words:
    """The words of both models, from counts of all words."""
    counted = [_texts(c).mapInArrow(_worded, "word long, n long").select("word", (F.col("n") * t).alias("t"), (F.col("n") * (1 - t)).alias("b")) for c, t in ((target, 1), (background, 0))]
    words = materialise(counted[0].unionByName(counted[1]).groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b")))
    known = words.filter("word is not null")
    # At most so many words of each corpus come to the driver.
    best = [known.filter(F.col(c) > 0).orderBy(F.desc(c), "word").limit(most).toArrow() for c, most in (("t", of_target), ("b", of_background))]
    rows = pa.concat_tables(best)
    hashes, first = np.unique(rows["word"].to_numpy().view(np.uint64), return_index=True)
    zero = lambda r: tuple(int(x or 0) for x in r or (0, 0))
    starts, totals = words.filter("word is null").select("t", "b").first(), known.agg(F.sum("t"), F.sum("b")).first()
    return Words(hashes, rows["t"].to_numpy()[first], rows["b"].to_numpy()[first], zero(starts), zero(totals))


def _counted(words):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed_on(most: int) -> Iterator[pa.RecordBatch]:
            if sum(len(p) for p, _ in held) <= most:
                return
            pair, to = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.bincount(to, weights=np.concatenate([n for _, n in held]), minlength=len(pair)).astype(np.int64)
            held.clear()
            if most and len(pair) <= most // 2:
                held.append((pair, n))
                return
            for k in range(0, len(pair), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["pair", "n"])

        for batch in batches:
            for _, _, _, _, hashes, at in chunks(batch["text"]):
                held.append(np.unique(words.value.places(hashes, at), return_counts=True))
                yield from passed_on(HELD)
        yield from passed_on(0)

    return run


def other_pairs(target: DataFrame, background: DataFrame, docs: DataFrame, words, own: int) -> DataFrame:
    """pair, t, b, n (in the target, the background, and all corpora) of the pairs that are in the target or more often in the background than ``own`` times."""
    found = []
    for corpus, t, b in ((target, 1, 0), (background, 0, 1), *([] if docs is background else [(docs, 0, 0)])):
        counted = _texts(corpus).mapInArrow(_counted(words), "pair long, n long")
        found.append(counted.select("pair", (F.col("n") * t).alias("t"), (F.col("n") * b).alias("b"), "n"))
    summed = reduce(DataFrame.unionByName, found).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("t", "b", "n")])
    return materialise(summed.filter((F.col("t") > 0) | (F.col("b") > own)))


def _added(words, own: int):
    """From (pair, t, b) to (pair, t, b): what the pair's losses are more than those of a pair that is ``own`` times in the background alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch["pair"].to_numpy()
            real = words.value.losses(pair, batch["t"].to_numpy(), batch["b"].to_numpy())
            plain = words.value.losses(pair, 0, own)
            yield pa.RecordBatch.from_arrays([batch["pair"], *(pa.array(x - y) for x, y in zip(real, plain, strict=True))], names=["pair", "t", "b"])

    return run


def _summed(words, heavy, own: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, added = heavy.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, _, _, _, hashes, at in chunks(batch["text"]):
                pair = words.value.places(hashes, at)
                place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                here = known[place] == pair if len(known) else np.zeros(len(pair), dtype=bool)
                sums = []
                for loss, more in zip(words.value.losses(pair, 0, own), added, strict=True):
                    so_far = np.zeros(len(pair) + 1, dtype=np.int64)
                    np.cumsum(loss + (np.where(here, more[place], 0) if len(known) else 0), out=so_far[1:])
                    sums.append(so_far[at[1:]] - so_far[at[:-1]])
                left = np.r_[0, np.cumsum(~here)][at].astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(left), pa.array(pair[~here]))
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), pa.array(row + np.arange(n)), pa.array(np.diff(at).astype(np.int64)), *map(pa.array, sums), rest], names=["doc_id", "row", "n_tokens", "t", "b", "rest"])
                row += n

    return run


@tidy
def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame, heavy_pairs: int = HEAVY_PAIRS, of_target: int = TARGET_WORDS, of_background: int = BACKGROUND_WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score."""
    send, own = docs.sparkSession.sparkContext.broadcast, int(docs is background)
    chosen = vocabulary(target, background, of_target, of_background)
    words = send(chosen)
    others = other_pairs(target, background, docs, words, own)
    least = chosen.all_words / heavy_pairs
    often = others.filter(F.col("n") >= least).select("pair", "t", "b").toArrow()
    known = often["pair"].to_numpy()
    order = np.argsort(known)
    known, t, b = (x.to_numpy()[order] for x in (often["pair"], often["t"], often["b"]))
    added = [x - y for x, y in zip(chosen.losses(known, t, b), chosen.losses(known, 0, own), strict=True)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    part = materialise(rows.mapInArrow(_summed(words, send((known, added)), own), "doc_id long, row long, n_tokens long, t long, b long, rest array<long>"))
    seldom = others.filter(F.col("n") < least).select("pair", "t", "b").mapInArrow(_added(words, own), "pair long, t long, b long")
    more = part.select("row", F.explode("rest").alias("pair")).hint("merge").join(seldom, "pair").groupBy("row").agg(F.sum("t").alias("more_t"), F.sum("b").alias("more_b"))
    whole = part.select("doc_id", "row", "n_tokens", "t", "b").hint("merge").join(more, "row", "left")
    mean = lambda m: F.when(F.col("n_tokens") > 0, (F.col(m) + F.coalesce(f"more_{m}", F.lit(0))) / UNIT / F.col("n_tokens"))
    out = whole.select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
