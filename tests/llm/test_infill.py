"""Fill-in-the-middle outputs against plain Python, the automaton against a walk through every byte."""

import hashlib
import random
import re

import numpy as np
import pytest

from parcelspark.llm import infill
from parcelspark.llm.queries import ORACLES, QUERIES
from tests.oracle import connection, same


def brute(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>"))
    form = "plain" if plain else "spm" if h[3] % 100 < 50 else "psm"
    output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(lines), form, None if plain else len(p), None if plain else len(m), sha(output), sha(text))


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def texts(n, seed=1):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 30, 100, 400, 3000])
        text = "".join(rng.choice(["a", "é", "語", "\n", "\n", "<", "P", "S", ">", " b", "<P", "M>", "x" * 20, "<M>" if i % 7 == 0 else ""]) for _ in range(size))
        made.append((i, text if i % 7 == 0 else re.sub("<[PSM]>", "<>", text)))
    return made


@pytest.mark.parametrize("chunk", [4, 64, 1 << 15])
def test_outputs_are_those_of_plain_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(infill, "CHUNK", chunk)
    monkeypatch.setattr(infill, "GROUP", 4)
    rows = [*texts(60), (100, None), (None, "a\nb"), (None, "a\nb"), (101, "one\n\ntwo\n"), (101, "one\n\ntwo\n"), (101, "other"), (102, "\n\n\n"), (103, "\r\n" * 5), (104, "ends with <"), (105, "<\nP>\n" * 9)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = infill.digests(infill.infilled(docs)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(*r)) for r in rows)


def test_a_very_long_text_comes_in_parts(spark):
    text = "".join(f"line {i} ü\n" * (1 + i % 3) for i in range(60_000))
    docs = spark.createDataFrame([(5, text), (6, "short")], "doc_id long, text string")
    out = infill.infilled(docs)
    parts = sorted((r["part"], r["output"]) for r in out.filter("key is not null").collect())
    assert len(parts) > 20 and max(len(p.encode()) for _, p in parts) <= infill.CHUNK
    want = brute(5, text)
    assert hashlib.sha256("".join(p for _, p in parts).encode()).hexdigest() == want[5]
    assert {tuple(r) for r in infill.digests(out).select(*COLUMNS).collect()} == {want, brute(6, "short")}


def test_functions_of_chunks_compose_to_the_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        data = rng.choice(np.frombuffer(b"ab\n<PSM>>", np.uint8), rng.integers(0, 40))
        cuts = np.r_[0, np.sort(rng.integers(0, len(data) + 1, 5)), len(data)]
        steps, counts = infill.functions(data, cuts)
        step, count = infill.composed(steps, counts, np.zeros(len(steps), np.int64), 1)
        for state in range(6):
            at, begun = state, 0
            for byte in data:
                begun += infill.BEGINS[at]
                at = infill.NEXT[infill.CLASS[byte], at]
            assert (step[0, state], count[0, state]) == (at, begun)


def test_empty_table(spark):
    assert infill.digests(infill.infilled(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_query(spark, sf_dir):
    same(QUERIES["op13_fill_in_middle"](spark, sf_dir), connection(sf_dir), ORACLES["op13_fill_in_middle"])
