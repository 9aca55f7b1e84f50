"""Benchmark decontamination by a distributed positional inverted index.

Test items are windows of ``size`` consecutive words; a shorter item is one window. Their terms are counted over all training documents, and each window is asked for by its ``RAREST`` rarest terms: only these terms need posting lists. Texts are cut into words once, and the words are stored. The index is a table of postings (document, term, position) in the shared folder. The lists of a window's terms are taken less the terms' places in the window, so that each gives the places where the window would begin, and are intersected by document and beginning. What is left is confirmed on the documents' words, and gives exact phrases; ``proximities`` gives the places where the rarest terms only stand near each other.

Everything is an expression or a join. Tables of terms and windows are sent to every task where their measured size is under ``BROADCAST_BYTES``, and the keys of documents with candidates where there are at most ``BROADCAST_KEYS``; beyond that, the joins sort, and what is known of a term is repeated ``SALT`` times, since one term may have a third of all postings. Documents go by 128 bits of a hash of id and text, so rows that repeat share one result.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; an item without an id hits words, but is not counted or named; repeated items count once; rows of documents that repeat are each returned; with an empty benchmark nothing is hit; an empty table of documents gives no rows; only doc_id and text, item_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import LOWER, UPPER, lowered, materialise, tidy

#: Words, with and without capitals of ASCII.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of a window whose lists are intersected.
RAREST = 2
BROADCAST_BYTES, BROADCAST_KEYS = 32 << 20, 200_000
#: Parts in which the postings of a term meet what is known of it.
SALT = 64

KEY = ["h1", "h2"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), F.lit(ANY_WORD), F.lit(0))


def keyed(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id, text).alias("h1"), F.xxhash64(F.lit(1), text, doc_id).alias("h2"), doc_id.alias("doc_id"), text.alias("text"))


def _small(df: DataFrame, text: Column) -> bool:
    """Whether a table of short rows and a text may be sent to every task."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return 64 * n + size <= BROADCAST_BYTES


def _with(rows: DataFrame, known: DataFrame, on: str, small: bool) -> DataFrame:
    """rows (with h1) joined to what is known of some column's values."""
    if small:
        return rows.join(F.broadcast(known), on)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod("h1", F.lit(SALT)).cast("int")).hint("merge").join(known.hint("merge"), [on, "salt"]).drop("salt")


def windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(window, terms) of the distinct windows, and (window, item_id) of the items that have them."""
    w = items.select("item_id", F.explode(F.array(words(F.col("text").cast("string")))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size, F.lit(0)) + 1)
    w = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("terms"))
    w = materialise(w.select(F.unhex(F.md5(F.array_join("terms", " "))).alias("window"), "terms", "item_id"))
    return w.groupBy("window").agg(F.first("terms").alias("terms")), w.select("window", "item_id").filter("item_id is not null").distinct()


def split(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, n_words, found (the words as they stand), stored: texts are cut into words once, which costs more than all that is done with them afterwards."""
    found = docs.select(*KEY, "doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ANY_WORD), F.lit(0)).alias("found"))
    return materialise(found.withColumn("n_words", F.size("found").cast("long")))


def _tokens(split: DataFrame) -> DataFrame:
    """h1, h2, pos, term of every word."""
    return split.select(*KEY, F.posexplode("found").alias("pos", "word")).select(*KEY, "pos", lowered(F.col("word")).alias("term"))


def frequencies(split: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """term, n: how often terms occur in split documents."""
    tokens = _tokens(split).select("term")
    if small:
        return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).hint("merge").join(terms.hint("merge"), "term")


def seeds(wins: DataFrame, counts: DataFrame, rarest: int, small: bool) -> DataFrame:
    """term, window, place, rank, need: the rarest terms of each window, the rarest first; windows with a term that does not occur are left out, since they cannot occur."""
    each = wins.select(F.col("window"), F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term"))
    each = each.join(F.broadcast(counts), "term") if small else each.hint("merge").join(counts.hint("merge"), "term")
    sorted_ = F.slice(F.array_sort(F.collect_list(F.struct("n", "place", "term"))), 1, rarest)
    whole = each.groupBy("window", "size").agg(F.count("*").alias("found"), sorted_.alias("rare")).filter("found = size")
    return whole.select("window", F.size("rare").alias("need"), F.posexplode("rare").alias("rank", "r")).select("r.term", "window", "r.place", "rank", "need")


def postings(split: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """The index, stored: h1, h2, pos, term for every occurrence of the terms."""
    return materialise(_with(_tokens(split), terms, "term", small).select("term", *KEY, "pos"))


#: Whether a group has a row of each rank.
ALL_RANKS = "bit_or(shiftleft(1, rank)) = shiftleft(1, max(need)) - 1"


def intersected(index: DataFrame, asked: DataFrame, small: bool) -> DataFrame:
    """window, h1, h2, start: where all terms that are asked for stand at their places."""
    starts = _with(index, asked, "term", small).select("window", *KEY, (F.col("pos") - F.col("place")).alias("start"), "rank", "need").filter("start >= 0")
    return starts.groupBy("window", *KEY, "start").agg(F.expr(ALL_RANKS).alias("ok")).filter("ok").drop("ok")


def _indexed(split: DataFrame, items: DataFrame, size: int, rarest: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    wins, of_items = windows(items, size)
    wins = materialise(wins)
    small = _small(wins, F.array_join("terms", " "))
    terms = materialise(wins.select(F.explode("terms").alias("term")).distinct())
    asked = materialise(seeds(wins, materialise(frequencies(split, terms, small)), rarest, small))
    return wins, of_items, asked, postings(split, asked.select("term").distinct(), small), small


def _phrases(docs: DataFrame, words_of: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, hits) of documents with hits, an array of (start, stop, window); and (window, item_id)."""
    wins, of_items, asked, index, small = _indexed(words_of, items, size, RAREST)
    found = materialise(intersected(index, asked, small))
    found = found.join(F.broadcast(wins), "window") if small else found.hint("merge").join(wins.hint("merge"), "window")
    # A document's candidates: no more than its words times the lengths that windows have.
    of_docs = materialise(found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "terms", "window")).alias("candidates")))
    some = docs.select(*KEY, "text")
    if of_docs.count() <= BROADCAST_KEYS:
        some = some.join(F.broadcast(of_docs.select(*KEY)), KEY, "left_semi")
    met = some.hint("merge").join(of_docs.hint("merge"), KEY).select(*KEY, "candidates", F.explode(F.array(words(F.col("text")))).alias("w"))
    right = F.filter("candidates", lambda c: F.slice("w", c["start"] + 1, F.size(c["terms"])) == c["terms"])
    hits = met.select(*KEY, F.transform(right, lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["terms"])).alias("stop"), c["window"].alias("window"))).alias("hits"))
    return materialise(hits.filter(F.size("hits") > 0).dropDuplicates(KEY)), of_items


def covered(hits: Column) -> Column:
    """Words inside any of the hits."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(h["stop"] - F.greatest(h["start"], acc["upto"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["upto"], h["stop"]).alias("upto"))
    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["n"])


@tidy
def contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated."""
    docs = keyed(docs)
    words_of = split(docs)
    hits, of_items = _phrases(docs, words_of, items, size)
    named = hits.select(*KEY, F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window"))
    named = named.hint("merge").join(of_items.hint("merge"), "window").groupBy(*KEY).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    hits = hits.select(*KEY, covered(F.col("hits")).alias("hit")).hint("merge").join(named.hint("merge"), KEY, "left")
    every = words_of.select(*KEY, "doc_id", "n_words")
    out = every.hint("merge").join(hits.hint("merge"), KEY, "left")
    n_hit, names = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@tidy
def phrases(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The exact occurrences: h1, h2 (a document's key, see ``keyed``), start, stop, item_id."""
    docs = keyed(docs)
    hits, of_items = _phrases(docs, split(docs), items, size)
    return hits.select(*KEY, F.explode("hits").alias("h")).select(*KEY, "h.*").join(of_items, "window").drop("window")


@tidy
def proximities(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 3, within: int = 20) -> DataFrame:
    """h1, h2, pos, item_id: occurrences of the rarest term of an item's window with each other of its ``rarest`` rarest terms at most ``within`` words away, in any order. Lists meet by ranges of ``within`` positions, so a term's occurrences meet those nearby only."""
    _, of_items, asked, index, small = _indexed(split(keyed(docs)), items, size, rarest)
    placed = materialise(_with(index, asked, "term", small).select("window", *KEY, "pos", "rank", "need"))
    here = F.floor(F.col("pos") / within)
    anchors = placed.filter("rank = 0").select("window", *KEY, F.col("pos").alias("at"), "need", F.explode(F.array(here - 1, here, here + 1)).alias("cell"))
    near = anchors.hint("merge").join(placed.select("window", *KEY, "pos", "rank", here.alias("cell")).hint("merge"), ["window", *KEY, "cell"]).filter(F.abs(F.col("pos") - F.col("at")) <= within)
    found = near.groupBy("window", *KEY, "at").agg(F.expr(ALL_RANKS).alias("ok")).filter("ok")
    return found.select("window", *KEY, F.col("at").alias("pos")).join(of_items, "window").drop("window").distinct()
