"""Nearest neighbours, language-model scores and quality against brute force or held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from parcelspark.llm import ann, lm_score, quality
from parcelspark.llm.queries import op3_nearest_neighbours, op6_cross_entropy_difference, op9_quality_nbsvm

VECTORS = "vec_id long, embedding array<float>, label int, list string, page int"


def brute_nearest(rows, queries, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i in queries:
            best = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = best[:k]
    return out


def recall(frame, rows, queries, k=10):
    """The share of the true neighbours that were found; scores, order and counts are checked on the way."""
    true, got = brute_nearest(rows, queries, k), {}
    by_id = dict(rows)
    for r in frame.collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {q for q, best in true.items() if best}
    hits = total = 0
    for q, best in true.items():
        found = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(best) + 1))
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        for r in found:
            d = np.array(by_id[q], dtype=np.float64) - np.array(by_id[r["vec_id"]], dtype=np.float64)
            assert abs(r["score"] - math.sqrt(float((d * d).sum()))) < 1e-12 and r["vec_id"] != q
        hits += len({r["vec_id"] for r in found} & {j for _, j in best})
        total += len(best)
    return hits / max(total, 1)


def test_neighbours_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(op3_nearest_neighbours(spark, sf_dir), rows, {i for i, _ in rows if i % 100 == 0}) >= 0.9


def test_neighbours_among_many_lists(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((50, 24)) * 2
    rows = [(k, np.float32(centres[k % 50] + rng.standard_normal(24)).tolist()) for k in range(6000)]
    frame = spark.createDataFrame([(i, v, 0, "l", 1) for i, v in rows], VECTORS)
    from pyspark.sql import functions as F

    assert recall(ann.nearest(frame, F.col("vec_id") % 100 == 0, 10), rows, {i for i, _ in rows if i % 100 == 0}) >= 0.9


def test_odd_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [2.0, 0.0]), (200, [1.0, 2.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 0, "l", 1) for i, v in rows], VECTORS)
    assert recall(ann.nearest(frame, F.col("vec_id") % 100 == 0, 10), rows, {0, 100, 200}) == 1.0
    assert ann.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0, 10).count() == 0
    twice = spark.createDataFrame([(k, v, 0, "l", 1) for k, v in ((100, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [4.0, 0.0]), (100, [1.0, 0.0]))], VECTORS)
    assert [tuple(r) for r in ann.nearest(twice, F.col("vec_id") % 100 == 0, 10).orderBy("rank").collect()] == [(100, 1, 1, 1.0), (100, 2, 1, 3.0)]
    alone = spark.createDataFrame([(100, [1.0, 2.0], 0, "l", 1)], VECTORS)
    assert ann.nearest(alone, F.col("vec_id") % 100 == 0, 10).count() == 0


def test_repeats_do_not_take_the_places_of_others(spark):
    """One row that repeats 20 times is one neighbour, and ids and vectors that are null take no part."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(100, [0.0, 1.0, 0.0])] + [(k, np.float32(rng.standard_normal(3)).tolist()) for k in range(1, 30)]
    near = (50, [0.0, 1.0, 0.0009765625])
    frame = spark.createDataFrame([(i, v, 0, "l", 1) for i, v in [*rows, *[near] * 20, *[(None, [0.0, 1.0, 0.0])] * 15]], VECTORS)
    assert recall(ann.nearest(frame, F.col("vec_id") % 100 == 0, 10), [*rows, near], {100}) == 1.0


def test_more_lists_than_two_thousand_and_short_ones(spark):
    """Lists grow in number with the vectors; where those that a query reads hold fewer than k vectors, it reads more."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(k, np.float32(rng.standard_normal(4)).tolist()) for k in range(12_000)]
    frame = spark.createDataFrame([(i, v, 0, "l", 1) for i, v in rows], VECTORS)
    assert len(ann.Centroids(np.array([v for _, v in rows]), 3000).at) == 3000
    assert recall(ann.nearest(frame, F.col("vec_id") % 500 == 0, 10, to_a_list=4), rows, {i for i, _ in rows if i % 500 == 0}) >= 0.9


def test_a_hot_list_of_vectors_and_queries(spark, monkeypatch):
    """Pages and parts of queries meet once each."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "PAGE", 40)
    rng = np.random.default_rng(7)
    rows = [(k, np.float32(np.ones(6) + 0.01 * rng.standard_normal(6)).tolist()) for k in range(600)]
    frame = spark.createDataFrame([(i, v, 0, "l", 1) for i, v in rows], VECTORS)
    assert recall(ann.nearest(frame, F.col("vec_id") % 2 == 0, 10), rows, {i for i, _ in rows if i % 2 == 0}) >= 0.9


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_model(texts, known):
    one, two = Counter(), Counter()
    for t in texts:
        w = [x if x in known else "<other>" for x in words(t)]
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
        one[None] += bool(w)
    return one, two


def test_losses_are_those_of_plain_counts(spark):
    """Whether pairs are sent to the tasks or joined, a dictionary gives the same figures."""
    target = ["the parcel lies north", "The parcel lies south of the road", None]
    background = ["buy now cheap", "the road is long", "cheap cheap cheap", ""]
    schema = "doc_id long, text string, slot int, n int"
    docs = [(1, "the parcel lies here"), (2, "cheap\tcheap"), (3, None), (4, " "), (5, "unseen"), (5, "unseen"), (None, "the road")]
    frame = lambda texts: spark.createDataFrame([(k, t, 1, 1) for k, t in enumerate(texts)], schema)
    scored = lambda *heavy: lm_score.cross_entropy_difference(spark.createDataFrame([(*d, 1, 1) for d in docs], schema), frame(target), frame(background), *heavy).collect()
    got = scored()
    by_id = lambda rows: sorted(rows, key=str)
    assert by_id(got) == by_id(scored(1)) == by_id(scored(8))
    known = {w for t in [*target, *background] for w in words(t)}
    models = [brute_model(target, known), brute_model(background, known)]
    totals = [sum(n for w, n in one.items() if w is not None) for one, _ in models]
    scale = [1.0, totals[0] / totals[1]]
    vocabulary = len(known) + 1
    for r, (_, text) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(docs, key=lambda d: str(d[0])), strict=True):
        w = words(text)
        assert r["n_tokens"] == len(w)
        if not w:
            assert r["score"] is None and r["target_loss"] is None
            continue
        losses, w = [], [x if x in known else "<other>" for x in w]
        for (one, two), s in zip(models, scale, strict=True):
            total = 0.0
            for before, word in zip([None, *w], w, strict=False):
                lower = (s * one[word] + lm_score.UNIFORM / vocabulary) / (totals[0] + lm_score.UNIFORM)
                total -= math.log((s * two[before, word] + lm_score.BACKOFF * lower) / (s * one[before] + lm_score.BACKOFF))
            losses.append(total / len(w))
        assert abs(r["target_loss"] - losses[0]) < 1e-8 and abs(r["background_loss"] - losses[1]) < 1e-8 and abs(r["score"] - losses[0] + losses[1]) < 1e-8
    # Documents that are the background themselves.
    own = spark.createDataFrame([(*d, 1, 1) for d in docs], schema)
    several = lambda *heavy: by_id(lm_score.cross_entropy_difference(own, frame(target), own, *heavy).collect())
    assert several() == several(1) == several(8)
    ours = {w for t in [*target, *(t for _, t in docs)] for w in words(t)}
    mine = brute_model([t for _, t in docs], ours)
    for r in several():
        if r["doc_id"] == 5:
            s = totals[0] / sum(n for w, n in mine[0].items() if w is not None)
            size = len(ours) + 1
            lower = (s * mine[0]["unseen"] + lm_score.UNIFORM / size) / (totals[0] + lm_score.UNIFORM)
            assert abs(r["background_loss"] + math.log((s * mine[1][None, "unseen"] + lm_score.BACKOFF * lower) / (s * mine[0][None] + lm_score.BACKOFF))) < 1e-8
    # Words beyond the vocabulary are one sign, of however many kinds, and a very long text counts whole.
    few = lm_score.cross_entropy_difference(frame(["x y " * 50_000, "the zz", "the qq"]), frame(target), frame(background), 8, 1, 1).collect()
    assert few[[r["doc_id"] for r in few].index(0)]["n_tokens"] == 100_000
    assert len({r["score"] for r in few if r["doc_id"] > 0}) == 1
    nothing = spark.createDataFrame([], schema)
    assert lm_score.cross_entropy_difference(nothing, nothing, nothing).count() == 0
    assert [r["score"] for r in lm_score.cross_entropy_difference(frame(["a b"]), nothing, nothing).collect()] == [0.0]


def test_benchmark_passages_score_lower(spark, sf_dir):
    got = {r["doc_id"]: r["score"] for r in op6_cross_entropy_difference(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r["text"] and len(r["text"]) > 100]
    has = [got[d] for d, t in docs.items() if any(x in t for x in items)]
    others = [s for d, s in got.items() if s is not None and not any(x in docs[d] for x in items)]
    assert set(got) == set(docs)
    if has:
        assert np.mean(has) < np.mean(others)


def test_quality_on_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in op9_quality_nbsvm(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= quality.THRESHOLD) for r in got.values())
    rest = [(got[d]["score"], q) for d, q in labels.items() if d in got and got[d]["held_out"]]
    assert len(rest) > 50
    good, poor = [s for s, q in rest if q == 1], [s for s, q in rest if q == 0]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in poor] for a in good])
    assert auc > 0.8
    # Clean documents stay, and most poor ones go.
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.8 and np.mean([s < quality.THRESHOLD for s in poor]) > 0.5


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, quality string, slots int"
    docs = spark.createDataFrame([(1, "good text here", "x", 1), (2, None, "x", 1), (3, "", None, None), (3, "x", "", 1), (None, "y", "", 1)], schema)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, share in (([], 0.5), ([(1, 1), (9, 1), (None, 1), (2, None)], 2 / 3), ([(1, 1), (2, 0)], 0.5)):
        scores = [r[0] for r in docs.select(quality.score(docs["text"], quality.fit(docs, labels(rows)))).collect()]
        assert len(scores) == 5 and all(abs(s - share) < 1e-6 for s in scores)


def test_descent_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(np.array([k % 2, 2 + int(rng.integers(5))]), np.array([1.0, 0.3])) for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    w = quality.descend(rows, y, 1.0, 20, 8)
    assert all(y[i] * (w[at] @ v + w[-1]) > 0.5 for i, (at, v) in enumerate(rows))
