"""The quality classifier against a version in plain Python, with named features and dictionaries."""

import math
import random
import re

import numpy as np

from parcelspark.llm import quality


def features_of(text):
    """Words, word pairs, shapes, shape pairs, and for each coarse shape the step of its share."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    out, fine, coarse, before = set(), [], [], None
    lowered = [bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in words]
    for w, low in zip(words, lowered, strict=True):
        kinds = frozenset("upper" if 65 <= b < 91 else "lower" if 97 <= b < 123 else "digit" if 48 <= b < 58 else "other" if b >= 128 else "symbol" for b in w)
        last = w[-1:] if w[-1] < 128 and not w[-1:].isalnum() else b""
        length = sum(len(w) > edge for edge in (1, 3, 6, 10, 16, 30))
        fine.append((kinds, last, 65 <= w[0] < 91, length, low == before))
        coarse.append((kinds, last, low == before))
        before = low
    out |= {("word", w) for w in lowered} | {("words", *p) for p in zip(lowered, lowered[1:], strict=False)}
    out |= {("shape", s) for s in fine} | {("shapes", *p) for p in zip(fine, fine[1:], strict=False)}
    for c in set(coarse):
        out.add(("share", c, sum(coarse.count(c) / len(words) > edge for edge in quality.SHARES)))
    return out


def trained(sets, y):
    """Feature weights times ratios, ratios and the constant: the dual is climbed one document at a time."""
    has = {1.0: {}, -1.0: {}}
    for s, label in zip(sets, y, strict=True):
        for f in s:
            has[label][f] = has[label].get(f, 0) + 1
    totals = {label: sum(n.values()) + quality.SLOTS for label, n in has.items()}
    ratio = {f: math.log((has[1.0].get(f, 0) + 1) / totals[1.0]) - math.log((has[-1.0].get(f, 0) + 1) / totals[-1.0]) for f in has[1.0].keys() | has[-1.0].keys()}
    unseen = math.log(1 / totals[1.0]) - math.log(1 / totals[-1.0])
    at = lambda f: ratio.get(f, unseen)
    rows = []
    for s in sets:
        norm = math.sqrt(sum(at(f) ** 2 for f in s))
        rows.append({f: at(f) / norm for f in s} | {None: 1.0})
    w, alpha, order = {}, [0.0] * len(rows), np.random.default_rng(5)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * sum(w.get(f, 0.0) * v for f, v in rows[i].items()) - 1
            new = min(max(alpha[i] - gradient / sum(v * v for v in rows[i].values()), 0.0), quality.COST)
            moved = max(moved, abs(new - alpha[i]))
            for f, v in rows[i].items():
                w[f] = w.get(f, 0.0) + (new - alpha[i]) * y[i] * v
            alpha[i] = new
        if moved < 1e-3:
            break
    return w, at


def margin(model, s):
    w, at = model
    return sum(w.get(f, 0.0) * at(f) for f in s) / max(math.sqrt(sum(at(f) ** 2 for f in s)), 1e-9) + w.get(None, 0.0)


def test_scores_are_those_of_plain_python(spark):
    rng = random.Random(12)
    good, poor, both = ([f"{k}{j}" for j in range(60)] for k in ("land", "SPAM", "the"))
    docs = []
    for k in range(160):
        own = good if k % 2 else poor
        docs.append((k, " ".join(rng.choice(own if rng.random() < 0.3 else both) + rng.choice(["", "", ".", "!!"]) for _ in range(rng.randint(3, 40))), k % 2))
    docs += [(500, None, None), (501, "", None), (502, "never seen WORDS", None), (503, "land1 " * 30_000, None)]
    frame = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in docs if q is not None], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    got = {r[0]: r[1] for r in frame.select("doc_id", quality.score(frame["text"], model)).collect()}

    known = [(features_of(t), 1.0 if q else -1.0) for _, t, q in docs if q is not None]
    y = [label for _, label in known]
    held = [i for label in (1.0, -1.0) for i in [i for i, x in enumerate(y) if x == label][::5]]
    seen = [i for i in range(len(known)) if i not in held]
    plain = trained([known[i][0] for i in seen], [y[i] for i in seen])
    held.sort()
    slope, offset = quality._curve(np.array([margin(plain, known[i][0]) for i in held]), np.array([y[i] for i in held]))
    # Slots are shared by a few features, and weights are kept in single precision.
    for d, t, _ in docs:
        want = 1 / (1 + math.exp(-(slope * margin(plain, features_of(t)) + offset)))
        assert abs(got[d] - want) < 0.03, (d, got[d], want)
    assert np.mean([abs(got[d] - 1 / (1 + math.exp(-(slope * margin(plain, features_of(t)) + offset)))) for d, t, _ in docs]) < 0.01


def test_the_sample_is_bounded_by_its_features(spark):
    docs = spark.createDataFrame([(k, " ".join(f"{'a' if k % 2 else 'b'}{j}" for j in range(50))) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    scores = lambda most: [r[0] for r in docs.select(quality.score(docs["text"], quality.fit(docs, labels, most=most))).collect()]
    assert len(set(scores(10))) == 1  # too few features for any document: no model
    assert len(set(scores(10**6))) > 1


def test_quality_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert docs.select(quality.score(docs["text"], quality.fit(docs, labels))).count() == 0
