"""Benchmark hits against a scan of every window in plain Python; proximities against all positions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelspark.llm import decontaminate
from parcelspark.llm.queries import ORACLES, QUERIES
from tests.oracle import connection, same

LOWER = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def made(seed, n_docs):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "É", "é", "ñandú", "x1", "7", "zeta", "ÑA", "語"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "..."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 12, 20]))) for i in range(12)] + [(3, "the of the of"), (90, None), (91, " ,"), (None, "w1 w2 w3 w4 w5"), (92, "the the the the the the the the the the the the"), (92, "the of the of")]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.choice([0, 3, 40]))]
        for _ in range(rng.choice([0, 1, 3])):
            parts += [rng.choice(items)[1] or "", text(rng.choice([0, 2]))]
        docs.append((i, " ".join(parts)))
    return [*docs, (500, None), (501, ""), (None, "w1 w2 w3 w4 w5"), (None, "w1 w2 w3 w4 w5"), (502, "the " * 3000), (502, "the of the of the"), (502, "the " * 3000), (503, "a" * 100_000)], items


@pytest.mark.parametrize(("size", "bytes_", "keys"), [(4, 1 << 25, 1000), (10, 1 << 25, 1000), (4, 0, 0)])
def test_hits_are_those_of_a_scan(spark, monkeypatch, size, bytes_, keys):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", keys)
    docs, items = made(size, 60)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, h1 string")
    got = decontaminate.contaminated(frame, spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, window string"), size)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == Counter(brute(docs, items, size))


def test_phrases_and_proximities(spark):
    items = [(1, "alpha beta gamma delta"), (2, "common common rare")]
    docs = [(1, "x alpha beta gamma delta x"), (2, "delta gamma x beta alpha"), (3, "alpha " + "y " * 50 + "beta gamma delta"), (4, "common " * 20 + "rare"), (5, "common x common x rare")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ids = {(r["h1"], r["h2"]): r["doc_id"] for r in decontaminate.keyed(d).collect()}
    exact = {(ids[r["h1"], r["h2"]], r["item_id"], r["start"], r["stop"]) for r in decontaminate.phrases(d, i).collect()}
    assert exact == {(1, 1, 1, 5), (4, 2, 18, 21)}
    near = {(ids[r["h1"], r["h2"]], r["item_id"]) for r in decontaminate.proximities(d, i, rarest=4, within=5).collect()}
    assert near == {(1, 1), (2, 1), (4, 2), (5, 2)}


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contaminated(d, i).collect() == []
    got = decontaminate.contaminated(one, i).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]


def test_query(spark, sf_dir):
    same(QUERIES["op12_decontamination"](spark, sf_dir), connection(sf_dir), ORACLES["op12_decontamination"])


def test_texts_are_cut_once(spark, monkeypatch):
    """Whole texts meet the pattern of words once: beside the items' and that of documents with candidates, no other column is made with it."""
    made = []
    for name in ("regexp_extract_all", "regexp_count"):
        of = getattr(F, name)
        monkeypatch.setattr(F, name, lambda *args, of=of, name=name: made.append(name) or of(*args))
    docs = spark.createDataFrame([(1, "One two, three"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "two three")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: (3, 2), 2: (0, 0), 3: (0, 0)}
    assert made == ["regexp_extract_all"] * 3
