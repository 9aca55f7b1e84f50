"""Near-duplicates of texts and of embeddings, and components, against brute force."""

import math
import random
import re

import numpy as np
import pytest

from parcelspark.llm import embed_dedup, minhash
from parcelspark.llm.components import connected_components, further
from parcelspark.llm.queries import op4_minhash_forest, op5_embedding_dedup

DOCS = "doc_id long, text string, node string, label int, kept string"
VECTORS = "vec_id long, embedding array<float>, label int, node string, codes int"


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def components(ids, links):
    """The smallest id reachable from each position."""
    to = list(range(len(ids)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, j in links:
        to[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def brute_texts(docs, words, percent):
    sets = [shingles(t, words) for _, t in docs]
    links = []
    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    links.append((i, j))
    least = components([d for d, _ in docs], links)
    return sorted([(d, len(s), c, d == c and d is not None) for (d, _), s, c in zip(docs, sets, least, strict=True)], key=str)


def test_documents_of_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_minhash_forest(spark, sf_dir)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == brute_texts(docs, 4, 80)


def test_graded_copies_and_odd_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    docs = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append((len(docs), (" " if g % 2 else "\n\t").join(text).replace("w1", "W1")))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "b c"), (905, "b c"), (None, "x y z"), (None, "x y z"), (906, "x y z"), (907, "word " * 50_000), (908, "word " * 40_000)]
    frame = spark.createDataFrame([(d, t, "n", 1, "k") for d, t in docs], DOCS)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame, 5, 80).collect()), key=str)
    assert got == brute_texts(docs, 5, 80)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS), 5, 80).count() == 0
    kept = minhash.deduplicated(frame, 5, 80)
    assert kept.columns == frame.columns


def test_a_large_group_of_near_copies(spark):
    """Over REGION copies of one text, each with a word of its own: one region at every level, dealt out in parts."""
    rng = random.Random(6)
    base = [f"v{rng.randrange(10_000)}" for _ in range(400)]
    docs = [(k, " ".join([*base[:200], f"own{k}", *base[200:]])) for k in range(1300)]
    got = minhash.near_duplicates(spark.createDataFrame([(d, t, "", 1, "") for d, t in docs], DOCS), 5, 80).collect()
    assert len(got) == 1300 and {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_a_prefix_of_many_whose_members_are_like_the_original_alone(spark, monkeypatch):
    """Over REGION nodes share prefixes, and each is similar enough to one node only, which need not be the first."""
    monkeypatch.setattr(minhash, "REGION", 50)
    rng = random.Random(7)
    base = [f"b{k}" for k in range(45)]
    docs = [(0, " ".join(base))]
    for k in range(1, 401):
        gone = set(rng.sample(base, 5))
        docs.append((k, " ".join([w for w in base if w not in gone] + [f"own{k}x{j}" for j in range(4)])))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame([(d, t, "", 1, "") for d, t in docs], DOCS), 1, 80).collect()), key=str)
    assert got == brute_texts(docs, 1, 80)


def as_texts(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("own", [100, 40])
def test_pairs_among_thousands_that_share_most_of_their_words(spark, own):
    """Texts that share 600 words, at 0.75 (or nearer) with each other and not linked, and pairs among them at 0.82: prefixes of the signatures are shared by most."""
    rng = random.Random(own)
    common = [f"c{k}" for k in range(6 * own)]
    docs = [(k, " ".join(common + [f"own{k}x{j}" for j in range(own)])) for k in range(2000)]
    for k in range(200):
        a = [f"pair{k}x{j}" for j in range(own)]
        docs.append((5000 + 2 * k, " ".join(common + a)))
        docs.append((5001 + 2 * k, " ".join(common + a[: int(0.34 * own)] + [f"other{k}x{j}" for j in range(own - int(0.34 * own))])))
    rng.shuffle(docs)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([(d, t, "", 1, "") for d, t in docs], DOCS), 1, 80).collect()}
    want = {d: d for d, _ in docs} | {5001 + 2 * k: 5000 + 2 * k for k in range(200)}
    assert got == want


def test_a_region_of_long_texts_meets_in_parts(spark, monkeypatch):
    """Sets that are too large to meet in one region, and a chain of links that only pairs across parts hold together."""
    monkeypatch.setattr(minhash, "SHINGLES", 1500)
    rng = random.Random(9)
    base = [f"l{k}" for k in range(300)]
    docs = []
    for k in range(60):
        docs.append((k, " ".join(base)))
        base = list(base)
        for _ in range(12):
            base[rng.randrange(300)] = f"new{rng.randrange(10**9)}"
    got = as_texts(minhash.near_duplicates(spark.createDataFrame([(d, t, "", 1, "") for d, t in docs], DOCS), 1, 80))
    assert got == brute_texts(docs, 1, 80)


def brute_vectors(rows, cosine):
    unit = []
    for _, v, label in rows:
        ok = v is not None and len(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float64) if ok else None
        unit.append(x / np.sqrt((x * x).sum()) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least = components([r[0] for r in rows], links)
    return sorted([(r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, least, strict=True)], key=str)


def as_rows(frame):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()), key=str)


def test_embeddings_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert as_rows(op5_embedding_dedup(spark, sf_dir)) == brute_vectors(rows, 0.98)


def test_odd_vectors_and_a_hot_group(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(k, np.float32(base + 0.05 * rng.standard_normal(16)).tolist(), k % 2) for k in range(700)]
    rows += [(1000 + k, np.float32(rng.standard_normal(16)).tolist(), 0) for k in range(100)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [float("inf")] * 16, 0), (2005, [None] * 16, 0), (2006, rows[0][1], None), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [0.0, -0.0, 3.0], 1), (2009, [0.0, 0.0, 3.0], 1)]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], VECTORS)
    assert as_rows(embed_dedup.near_duplicates(frame, 0.98)) == brute_vectors(rows, 0.98)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS), 0.98).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (5, 4), (None, 1), (6, 6)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(100, 101)]])
def test_components(spark, links):
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    ids = sorted({x for link in real for x in link})
    assert got == dict(zip(ids, components(ids, [(ids.index(a), ids.index(b)) for a, b in real]), strict=True))


@pytest.mark.parametrize("first, more", [([(1, 2), (4, 5)], [(2, 5), (7, 8), (9, 9)]), ([], [(3, 2)]), ([(1, 2)], []), ([(5, 6), (3, 4), (1, 9)], [(6, 4), (9, 10), (10, 3)])])
def test_components_after_more_links(spark, first, more):
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["root"] for r in further(connected_components(frame(first)), frame(more)).collect()}
    assert got == {r["id"]: r["root"] for r in connected_components(frame(first + more)).collect()}


def test_sorted_orders_carry_the_links(spark, sf_dir, monkeypatch):
    """On the given tables: how many nodes the sorted orders join to others, of those that are joined in the end."""
    seen = {}
    by_orders = minhash._by_orders

    def counted(rows, docs, nodes, *rest):
        roots, sets = by_orders(rows, docs, nodes, *rest)
        seen["nodes"], seen["joined"] = nodes.count(), roots.count() - roots.select("root").distinct().count()
        return roots, sets

    monkeypatch.setattr(minhash, "_by_orders", counted)
    out = minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 80).filter("n_shingles > 0")
    joined = seen["nodes"] - out.select("component_id").distinct().count()
    assert joined > 0 and seen["joined"] >= 0.95 * joined
