"""Groups of spelling variants by an even-partition pigeonhole join.

Two words are near if one inserted, deleted or replaced letter leads from one to the other. Cut the shorter word of such a pair, of length l, in two halves at l // 2: the edit falls into one of them, so the other stands in the longer word unchanged, at its place or, behind an insertion, shifted by one. Each word is therefore indexed by both halves for its own length, and probes with the halves that words of its own length, and of one letter less, would share with it. Only words under one key are compared.

A half may be shared by a third of all words. Where a key has over ``PAIRS`` pairs, its words are cut again by the same rule: the part that may hold the edit is halved, and one half more must be shared. This goes on, for such keys only, until the part is a single letter: the words of a key are then near anyway, or one letter longer, and their number is bounded by the alphabet. So no key's pairs grow with the square of the words that share a half, and none is dropped.

Words under one key are verified in batches; pairs found twice (an insertion between two halves is in both) are counted once. Links from a word to its form lead to words at least ``RATIO`` times as frequent, so they end after a few, and doubling them finds the last.

Defined results: null and empty texts have no words; a null id is hashed as ``null``; rows that repeat count as often as they occur; ties of frequency go to the first word in the order of code points; an empty table gives no rows; words may be as long as a text; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import lowered, materialise, tidy, whole_groups

#: Letters: all are in Latin-1, so that a letter is a byte in the verification.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Pairs of words under one key that are compared as they are, pairs and bytes that are worked on at once.
PAIRS, AT_ONCE, BYTES = 1 << 11, 1 << 18, 1 << 24
#: How many times as frequent a word's form is.
RATIO = 10


def occurrences(docs: DataFrame, least: int, damage: int | None) -> DataFrame:
    """word, n: the words of at least ``least`` letters. One letter is taken from each run whose crc32 ``damage`` divides."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lowered(F.col("run")).alias("word"))
    if damage is not None:
        named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "word")
        runs = runs.select("word", F.crc32(named.cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("word")).alias("word")).filter(F.char_length("word") >= least)
    return runs.groupBy("word").agg(F.count("*").alias("n"))


def _halves(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """The two parts of [a, b) that may hold the edit."""
    middle = a + F.floor((b - a) / 2).cast("int")
    part = lambda x, y: F.struct(l.alias("l"), x.alias("a"), y.alias("b"))
    return F.array(part(a, middle), part(middle, b))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key: of the length and what stands around the part that may hold the edit, which has a letter more in a longer word."""
    length = F.char_length("word")
    around = F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), F.col("b") + F.col("longer") + 1, length)
    return rows.withColumn("key", F.xxhash64("l", "a", *around))


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (l, key, longer, word, n) in whole keys, shorter words first, to the near pairs among them: word, other, other_n, both ways."""
    for t in whole_groups(batches, ["l", "key"]):
        length, key, longer = (t[c].to_numpy() for c in ("l", "key", "longer"))
        names, n = t["word"].combine_chunks(), t["n"].to_numpy()
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (length[1:] != length[:-1]), True])
        stop = np.repeat(new[1:], np.diff(new))
        for size in np.unique(length):
            lo, hi = np.searchsorted(length, [size, size + 1])
            step = max(1, BYTES // (int(size) + 1))
            index = np.flatnonzero(longer[lo:hi] == 0) + lo
            partners = stop[index] - index - 1
            first = 0
            while first < len(index):
                last = first + max(1, int(np.searchsorted(np.cumsum(partners[first:]), min(AT_ONCE, step), side="right")))
                left = np.repeat(index[first:last], partners[first:last])
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(partners[first:last]) - partners[first:last], partners[first:last])
                for at in range(0, len(left), step):
                    i, j = left[at : at + step], right[at : at + step]
                    ok = _one_edit(names, i, j, longer[j] == 1, int(size))
                    i, j = i[ok], j[ok]
                    a, b = np.r_[i, j], np.r_[j, i]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n[b])], names=["word", "other", "other_n"])
                first = last


def _one_edit(names: pa.Array, i: np.ndarray, j: np.ndarray, longer: np.ndarray, size: int) -> np.ndarray:
    """Whether the words i of that length and j, longer by a letter or not, differ by exactly one edit."""
    rows, at = np.unique(np.r_[i, j], return_inverse=True)
    letters = np.array([w.encode("latin-1") for w in names.take(pa.array(rows)).to_pylist()], dtype=f"S{size + 1}").view(np.uint8).reshape(-1, size + 1)
    ok = np.zeros(len(i), dtype=bool)
    same = np.flatnonzero(~longer)
    ok[same] = (letters[at[same]] != letters[at[len(i) + same]]).sum(axis=1) == 1
    more = np.flatnonzero(longer)
    s, r = letters[at[more], :size], letters[at[len(i) + more]]
    before, behind = s != r[:, :size], s != r[:, 1:]
    first = np.where(before.any(axis=1), before.argmax(axis=1), size)
    last = np.where(behind.any(axis=1), size - 1 - behind[:, ::-1].argmax(axis=1), -1)
    ok[more] = last < first
    return ok


def near_pairs(words: DataFrame) -> DataFrame:
    """word, other, other_n for words (word, n) that are near, both ways; a pair may come twice."""
    width = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    length = F.char_length("word")
    cut = lambda k: F.transform(_halves(length - k, F.lit(0), length - k), lambda p: F.struct(F.lit(k).alias("longer"), p["l"].alias("l"), p["a"].alias("a"), p["b"].alias("b")))
    rows = _keyed(words.filter(length > 1).select("word", "n", F.explode(F.concat(cut(0), cut(1))).alias("p")).select("word", "n", "p.*"))
    ready = []
    while True:
        rows = materialise(rows)
        sizes = rows.groupBy("key").agg(F.sum(1 - F.col("longer")).alias("index"), F.sum("longer").alias("probe"), F.max(F.col("b") - F.col("a")).alias("part"))
        pairs = F.col("index") * ((F.col("index") - 1) / 2 + F.col("probe"))
        sizes = sizes.filter(pairs > 0).select("key", ((pairs > PAIRS) & (F.col("part") > 1)).alias("split"))
        met = materialise(rows.hint("merge").join(sizes.hint("merge"), "key"))
        ready.append(met.filter("not split").select("l", "key", "longer", "word", "n"))
        rows = met.filter("split")
        if rows.isEmpty():
            break
        rows = _keyed(rows.select("word", "n", "longer", F.explode(F.when(F.col("b") - F.col("a") > 1, _halves(F.col("l"), F.col("a"), F.col("b"))).otherwise(F.array(F.struct("l", "a", "b")))).alias("p")).select("word", "n", "longer", "p.*"))
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.repartition(width, "l", "key").sortWithinPartitions("l", "key", "longer").mapInArrow(_verified, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words that have a form: links are doubled until none leads on."""
    to = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = materialise(to.hint("merge").join(on.hint("merge"), "root", "left").select("word", "root", "next"))
        if both.filter("next is not null").isEmpty():
            return to
        to = both.select("word", F.coalesce("next", "root").alias("root"))


@tidy
def variants(docs: DataFrame, least: int = 7, occurs: int = 2, damage: int | None = 31) -> DataFrame:
    """One row per word of at least ``least`` letters with at least ``occurs`` occurrences: word, form (its most frequent near word, if RATIO times as frequent), root (the last form from it), n, n_near (near words), form_n."""
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = materialise(occurrences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least, damage).filter(F.col("n") >= occurs))
    near = near_pairs(words).repartition(width, "word").dropDuplicates(["word", "other"])
    near = materialise(near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best")))
    met = words.hint("merge").join(near.hint("merge"), "word", "left")
    frequent = -F.col("best.n") >= RATIO * F.col("n")
    met = materialise(met.select("word", F.when(frequent, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, -F.col("best.n")).alias("form_n")))
    roots = _roots(met.filter("form is not null"))
    return met.hint("merge").join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
