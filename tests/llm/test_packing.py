"""Best-fit packing against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelspark.llm import packing
from parcelspark.llm.queries import op1_best_fit_packing, tokenizer_path
from parcelspark.llm.tokens import WordIds

SCHEMA = "doc_id long, text string, node int, length string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, texts, tokenizer, capacity):
    """Every document's ids are there once, whole and in order; sequences are gapless and not too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        ids = ids_of(tokenizer, text)
        pieces = sorted(by_doc.pop(doc), key=lambda r: r["piece"])
        assert [(p["piece"], p["start"]) for p in pieces] == [(k, k * capacity) for k in range(len(pieces))]
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert len(part) == p["length"] and zlib.crc32(np.asarray(part, "<u4").tobytes()) == p["ids_crc32"]
        assert sum(p["length"] for p in pieces) == len(ids)
    assert not by_doc
    for members in by_sequence.values():
        at = 0
        for m in sorted(members, key=lambda r: r["offset"]):
            assert m["offset"] == at
            at += m["length"]
        assert at <= capacity
    return len(by_sequence)


def test_whole_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = op1_best_fit_packing(spark, sf_dir).collect()
    n = check(rows, texts, tokenizer, packing.CAPACITY)
    least = -(-sum(r["length"] for r in rows) // packing.CAPACITY)
    assert n <= least * 1.03 + 1


def test_many_partitions_merge_to_nearly_full_sequences(spark, tokenizer):
    texts = {k: "parcel " * (1 + (k * 37) % 23) for k in range(600)}
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], SCHEMA).repartition(20)
    rows = packing.pack(docs, tokenizer_path(), capacity=64, slack=1, fan_in=3).collect()
    n = check(rows, texts, tokenizer, 64)
    assert n <= 1.03 * sum(r["length"] for r in rows) / 64 + 1


def test_nulls_repeats_and_long_texts(spark, tokenizer):
    long = "word, " * 5000 + "<|endoftext|>"
    docs = [(1, None, 1, "x"), (2, "", None, None), (3, long, 1, ""), (4, "ÀÉ 日本 x\u0085y <|startoftext|>", 1, "")]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), tokenizer_path()).collect()
    check(rows, {d[0]: d[1] for d in docs}, tokenizer, packing.CAPACITY)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    twice = packing.pack(spark.createDataFrame([(None, "a b", 1, ""), (7, "a b", 1, ""), (7, "a b", 1, "")], SCHEMA), tokenizer_path()).collect()
    assert sorted(str(r["doc_id"]) for r in twice) == ["7", "7", "None"] and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_open_bins_beyond_a_nodes_number_meet_all_others(spark, tokenizer, monkeypatch):
    """Documents of over half a sequence in the first partitions, and the short ones that fit beside them each in one of its own."""
    monkeypatch.setattr(packing, "MAX_OPEN", 20)
    texts = {k: "parcel " * (40 if k < 60 else 22) for k in range(100)}
    part = lambda ids, n: spark.sparkContext.parallelize([(k, texts[k], 1, "x") for k in ids], n)
    docs = spark.createDataFrame(part(range(60), 3).union(part(range(60, 100), 40)), SCHEMA)
    rows = packing.pack(docs, tokenizer_path(), capacity=64, slack=1, fan_in=3).collect()
    assert check(rows, texts, tokenizer, 64) == 60


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 60), max_size=12))
def test_counted_bins_are_each_placed_once(counts):
    sequences, placed = {}, {}
    for fill, first, n, sequence, at in packing.planned(counts, 50):
        for k in range(n):
            assert (fill, first + k) not in placed
            placed[fill, first + k] = True
            sequences.setdefault(sequence + k, []).append((at, fill))
    assert set(placed) == {(f, k) for f, n in counts.items() for k in range(n)}
    for members in sequences.values():
        ends = [a + f for a, f in sorted(members)]
        assert [a for a, _ in sorted(members)] == [0, *ends[:-1]] and ends[-1] <= 50
    assert len(sequences) == len(packing.best_fit([f for f, n in counts.items() for _ in range(n)], 50))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_word_cache_gives_the_tokenizers_ids(texts):
    coder = test_word_cache_gives_the_tokenizers_ids.__dict__.setdefault("coder", WordIds(tokenizer_path()))
    for text, got in zip(texts, coder.of(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_uses_few_bins(lengths):
    bins = packing.best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    # Best-fit decreasing needs at most 11/9 of the least number of bins, and four more.
    assert len(bins) <= 11 / 9 * -(-sum(lengths) // 50) + 4 or len(bins) <= sum(n > 25 for n in lengths) + 1
