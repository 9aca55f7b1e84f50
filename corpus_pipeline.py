"""The corpus pipeline: reject poor documents, keep one of each group of near-duplicates, mix the sources, pack the rest.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import minhash, mixing, packing, quality
from parcelspark.llm.common import materialise, table
from parcelspark.llm.queries import tokenizer_path


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below its threshold; labels of held-out rows are not learned from.

    Every row is judged by its whole text: a null or empty one gets the score of the model's constant, rows that repeat stay or go together, and a null doc_id is only unlabelled. Other columns stay as they are, whatever their names; an empty table gives no rows."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    return docs.filter(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that shares 80 % of its shingles of five words.

    Texts without words (null, empty, blank) are linked with nothing and stay. Rows that repeat one doc_id stay or go together, and rows with a null doc_id stay. Whole texts are compared. Other columns stay as they are; an empty table gives no rows."""
    return minhash.deduplicated(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source up to its share of all words, whole epochs first; a document that is taken twice is there twice.

    A null source is one of its own. Texts without words have no weight: they are taken as often as their source's whole epochs go. Documents with one doc_id, and those without, share what is left at the cut. Of the document at a cut only the first words are taken. Other columns stay as they are (n_chars follows the text); an empty table gives no rows."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences of 4096 tokens.

    A null or empty text is its end token alone; a text of over 4096 tokens is cut into pieces; rows that repeat are packed as often as they occur, and a null doc_id is kept. Only doc_id and text are read; an empty table gives no rows."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", reject_poor),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
