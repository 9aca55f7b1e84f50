"""Mixing against a brute-force version."""

import re

from parcelspark.llm import mixing
from parcelspark.llm.queries import op2_mixing

SCHEMA = "doc_id long, text string, source string, size int, taken string, __size int, n_chars long"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """sizes by source. Weight is shared again and again until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, total = {}, set(names), float(sum(sizes.values()))
    while free:
        rest = total - sum(target.values())
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > 3 * sizes[s]]
        if not over:
            return target | shares
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
    return target


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + size(text)
    targets = brute_targets(sizes)
    rows = op2_mixing(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, size(t)) for d, t, _ in docs)
    of, taken = {d: s for d, _, s in docs}, {}
    for r in rows:
        source = of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - targets[source]) < 1e-6 * max(1, targets[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_mixing(spark, sf_dir).collect()))


DOCS = [(k, "a b c d" * (k % 3) + " é f", ("x", "y", None, "Z")[k % 4], 1, "t", 9, 3) for k in range(40)] + [(None, None, "x", None, None, None, None), (7, "a b", "x", 1, "", 1, 1), (7, "a b", "x", 1, "", 1, 1), (50, "", "only-empty", 1, "", 1, 1)]


def test_mixture_has_the_words_that_are_taken(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    sizes = {}
    for d in DOCS:
        sizes[d[2]] = sizes.get(d[2], 0) + size(d[1])
    targets = brute_targets(sizes)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    rows, got = out.collect(), {}
    for r in rows:
        got[r["source"]] = got.get(r["source"], 0) + size(r["text"])
    # Two rows with one id share what is left at a cut, rounded down.
    assert all(abs(got.get(s, 0) - targets[s]) <= 2 for s in sizes)
    assert {(r["size"], r["taken"], r["__size"]) for r in rows} <= {(d[3], d[4], d[5]) for d in DOCS}
    whole = {d[1] for d in DOCS}
    assert all(r["text"] in whole or any(w and w.startswith(r["text"]) for w in whole) for r in rows)
    assert all(r["n_chars"] in (3, 1, None) or r["n_chars"] == len(r["text"]) for r in rows)


def test_empty_table_and_one_source(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "a b", None, 1, "", 1, 1), (2, "c", None, 1, "", 1, 1)], SCHEMA)
    assert sorted(r["text"] for r in mixing.mix(one).collect()) == ["a b", "c"]
