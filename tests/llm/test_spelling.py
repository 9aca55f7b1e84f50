"""Spelling variants against all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from parcelspark.llm import spelling
from parcelspark.llm.queries import ORACLES, QUERIES
from tests.oracle import connection, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    form, count = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w], count[w] = best if best and n[best] >= 10 * n[w] else None, len(others)

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n)


def damaged(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abcéÿÀ")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.choice([7, 8, 9, 15, 16]))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "internet", "internal", "internals"]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 15, 250])
        for _ in range(6):
            v = damaged(rng, w)
            words += [v] * rng.choice([1, 2, 20])
            words += [damaged(rng, v)] * 2
    rng.shuffle(words)
    return [(i, " ".join(w.upper() if k % 9 == 0 and w.isascii() else w for k, w in enumerate(words[at : at + 200]))) for i, at in enumerate(range(0, len(words), 200))]


@pytest.mark.parametrize(("seed", "pairs"), [(1, 1 << 11), (2, 1), (3, 4)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed, pairs):
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    docs = [*made(seed), (900, None), (901, ""), (None, "abcdefgh abcdefgh abcdefgx"), (None, "abcdefgh abcdefgh abcdefgx"), (902, "z" * 50_000 + " " + "z" * 50_000 + " " + "z" * 49_999), (902, "z" * 49_999 + " short words"), (903, "1abcdefgÿ×÷2")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(docs)


def test_a_half_that_very_many_words_share(spark):
    """20,000 words share their first half; no key keeps more pairs than the bound, and every near pair is found."""
    rng = random.Random(5)
    words = sorted({"shared" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r["word"], r["other"]) for r in spelling.near_pairs(frame).collect()}
    index, want = {}, set()
    for w in words:
        for i in range(len(w)):
            index.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    for group in index.values():
        want.update((a, b) for a in group for b in group if a != b)
    assert got == want


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    same(QUERIES["op11_spelling_variants"](spark, sf_dir), connection(sf_dir), ORACLES["op11_spelling_variants"])
