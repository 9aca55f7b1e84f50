"""Sharding, URL filter, chat formatting and the pipeline."""

import hashlib
import io
import math
import random
import re
from collections import Counter
from contextlib import redirect_stdout

import pytest

from parcelspark.llm import chat, sharding, url_filter
from parcelspark.llm.queries import ORACLES, RULES, op8_url_filter, op10_chat_collapse

DOCS = "doc_id long, text string, hash string, shard int"


def bits(doc_id):
    digest = hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()
    return f"{int(digest[:12], 16):048b}"


def brute_shards(docs, limit):
    """(doc_id, bytes, shard) by splitting buckets from the whole down."""
    out, todo = [], [("", list(docs))]
    while todo:
        prefix, rows = todo.pop()
        if sum(n for _, n in rows) <= limit:
            out += [(d, n, prefix) for d, n in rows]
        else:
            todo += [(prefix + b, part) for b in "01" if (part := [(d, n) for d, n in rows if bits(d).startswith(prefix + b)])]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100, 1000, 10**9])
def test_shards(spark, limit):
    docs = [(k, "x" * (k % 90)) for k in range(500)] + [(900, None), (None, "é"), (901, "")]
    rows = sharding.shards(spark.createDataFrame([(*d, "h", 1) for d in docs], DOCS), limit).collect()
    want = brute_shards([(d, len((t or "").encode())) for d, t in docs], limit)
    assert sorted([(r["doc_id"], r["n_bytes"], r["shard"]) for r in rows], key=str) == want
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["n_bytes"]
        assert r["depth"] == len(r["shard"])
    assert all(r["shard_bytes"] == sums[r["shard"]] <= limit for r in rows)
    assert sharding.shards(spark.createDataFrame([], DOCS), limit).count() == 0


def test_overflow_chain(spark):
    docs = [(1, "x" * 40)] * 10 + [(1, "y" * 500)] + [(2, "z" * 10)]
    rows = sharding.shards(spark.createDataFrame([(*d, "h", 1) for d in docs], DOCS), 100).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in rows) == Counter((d, len(t)) for d, t in docs)
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["n_bytes"]
    assert all(n <= 100 or n == 500 for n in sums.values()) and all(r["shard_bytes"] == sums[r["shard"]] for r in rows)


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(h) + len(p), h + p, action) for action, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


def test_pages_of_the_table(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = op8_url_filter(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert (r["host"], r["path"]) == parts(pages[r["page_id"]])
        rule, action = rule_of(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == action)


URLS = [None, "", "no scheme", "http://", "HTTP://Example.COM", "http://a.com/en/x?q=1#f", "http://example.com/en/7/x", "http://sub.example.com/en/7", "http://notexample.com/en/7", "x://net/de/", "http://example.net/de/8", "http://a://b.org/es/", "http://org?/es/", "//b.com/en/", "http://a.com#/en/", "http://É.com/EN/\nz", "a\nb://org/es/\n1", "http://b.org/es/" + "9" * 5000, "http://b.org/es/" + "9" * 5000]


def test_odd_urls_and_clashing_columns(spark):
    schema = "page_id long, url string, suffix string, entropy int, blocked int, prediction string"
    frame = spark.createDataFrame([(k, u, "s", 7, 1, "p") for k, u in enumerate(URLS)], schema)
    out = url_filter.verdicts(frame, RULES)
    rows = sorted(out.collect(), key=lambda r: r["page_id"])
    assert out.columns[: len(frame.columns)] == frame.columns and len(rows) == len(URLS)
    for r, u in zip(rows, URLS, strict=True):
        assert (r["__url_host"], r["__url_path"]) == parts(u) and r["__rule"] == rule_of(*parts(u))[0]
        assert (r["url"], r["suffix"], r["entropy"], r["blocked"], r["prediction"]) == (u, "s", 7, 1, "p")
    empty = url_filter.verdicts(spark.createDataFrame([], schema), RULES)
    assert empty.count() == 0


def test_trees_learn_from_labelled_urls(spark):
    good = [(k, f"https://site{k % 9}.example/articles/{k}/title-of-text") for k in range(150)]
    poor = [(1000 + k, f"http://x{k * 7919 % 100000}9.spam{k % 9}.test/p?id={k * 31}&ref={k * 17}&s=%20%3D") for k in range(150)]
    labelled = spark.createDataFrame([(u, 0) for _, u in good[:100]] + [(u, 1) for _, u in poor[:100]] + [(None, 1), ("u", None)], "url string, blocked int")
    judged = url_filter.verdicts(spark.createDataFrame(good + poor, "page_id long, url string"), [], labelled).collect()
    right = sum((r["__verdict"] == "block") == (r["page_id"] >= 1000) for r in judged)
    assert right >= 0.95 * len(judged)


def test_features_of_whole_urls(spark):
    """Entropy counts every character of a long URL, and the shares all of it."""
    from pyspark.sql import functions as F

    urls = ["http://a.com/x", "http://b.org/" + "ab" * 700 + "".join(chr(97 + k % 26) for k in range(3000)), "é://ü", "", "aaaa"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    made = url_filter.lexical(F.col("url"), url_filter.host(F.col("url")), url_filter.path(F.col("url")))
    for r in frame.select("url", *[c.cast("double").alias(k) for k, c in made.items()]).collect():
        u = r["url"]
        want = -sum(n / len(u) * math.log2(n / len(u)) for n in Counter(u).values())
        assert abs(r["entropy"] - want) < 1e-9 and r["url_length"] == len(u)
        assert abs(r["digit_share"] - sum(c in "0123456789" for c in u) / max(len(u), 1)) < 1e-12


def test_statistics_of_suffixes_count_all_labelled_urls(spark):
    """A domain whose labels lie outside the sample is known all the same."""
    labelled = [(f"http://good{k}.example/p/{k}", 0) for k in range(60)] + [(f"http://a{k}.bad.example/p/{k}", 1) for k in range(60)]
    frame = spark.createDataFrame(labelled, "url string, blocked int")
    asked = spark.createDataFrame([(k, f"http://b{k}.bad.example/p/{k}") for k in range(30)], "page_id long, url string")
    assert {r["__verdict"] for r in url_filter.verdicts(asked, [], frame, sample=40).collect()} == {"block"}


TURNS = "conv_id long, turn long, role string, text string, hash string, position int"


def brute_chat(turns):
    """Conversations that no other contains as a prefix; the smallest id of equal ones."""
    by = {}
    for c, turn, role, text in turns:
        by.setdefault(c, []).append((turn, role, text))
    said = {c: [x[1:] for x in sorted(v, key=lambda x: tuple((y is not None, y) for y in x))] for c, v in by.items()}
    kept = [c for c, s in said.items() if not any(o != c and t[: len(s)] == s and (len(t) > len(s) or o < c) for o, t in said.items())]
    return sorted((c, turn, role, len(by[c]), f"<|{role or 'unknown'}|>\n{text or ''}<|end|>\n") for c in kept for turn, role, text in by[c])


def test_conversations_of_the_table(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op10_chat_collapse(spark, sf_dir).collect())) == brute_chat(turns)


def test_snapshots_and_odd_turns(spark):
    long = [(9, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(700)]
    turns = [(1, 1, "user", "a"), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (3, 1, "user", "a"), (3, 2, "assistant", "b"), (4, 1, "user", None), (5, 1, "user", ""), (6, 1, None, "a"), (7, 1, "unknown", "a"), *long, *[(8, k, r, t) for _, k, r, t in long[:600]]]
    frame = spark.createDataFrame([(*t, "h", 1) for t in turns], TURNS)
    rows = sorted(tuple(r) for r in chat.rendered(frame).select("conv_id", "turn", "role", "n_turns", "rendered").collect() if r["role"] is not None or True)
    key = lambda r: tuple(map(str, r))
    got, want = sorted(rows, key=key) if all(r[2] for r in rows) else sorted(map(key, rows)), sorted(map(key, brute_chat_with_nulls(turns)))
    assert sorted(map(key, got)) == want
    assert {r[0] for r in rows} == {2, 4, 5, 6, 7, 9}
    assert chat.rendered(spark.createDataFrame([], TURNS)).count() == 0


def brute_chat_with_nulls(turns):
    return [(c, turn, None if role == "\0" else role, n, text.replace("<|\0|>", "<|unknown|>")) for c, turn, role, n, text in brute_chat([(c, t, "\0" if r is None else r, "\0" if x is None else x) for c, t, r, x in turns]) for text in [text.replace("\0<|end|>", "<|end|>")]]


def test_rows_without_a_conversation_or_turn(spark):
    frame = spark.createDataFrame([(None, 1, "user", "x", "", 1), (None, 2, "user", "y", "", 1), (1, None, "user", "x", "", 1), (1, None, "user", "x", "", 1)], TURNS)
    assert Counter(r["conv_id"] for r in chat.rendered(frame).collect()) == Counter({None: 2, 1: 2})


def test_ties_and_nulls_are_as_in_sql(spark, tmp_path):
    """Turns with one number are in the order of their texts, whatever those are; rows without an id are a conversation."""
    import duckdb

    rng = random.Random(3)
    turns = [(None, 1, "user", "x"), (None, 2, None, "?"), (900, 1, "user", "x"), (900, 2, "?", None), (901, 1, "user", "x"), (902, None, None, None), (902, None, None, None), (903, None, None, None)]
    for k in range(60):
        words = rng.sample("abcdefghij", 3)
        turns += [(2 * k, 1, "user", w) for w in sorted(words)[:2]] + [(2 * k + 1, 1, "user", w) for w in words]
    turns += [(950, 1, "user", f"{'w' * 500}{k}") for k in range(300)] + [(951, 1, "user", f"{'w' * 500}{k}") for k in sorted(range(300), key=str)[:200]]
    rng.shuffle(turns)
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/t")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/t/*.parquet')")
    want = Counter(con.execute(ORACLES["op10_chat_collapse"]).fetchall())
    assert Counter(map(tuple, chat.rendered(frame).collect())) == want
    assert {r[0] for r in want} & {950, 951} == {950}


def test_a_very_long_text_in_a_conversation(spark):
    text = "word " * 200_000
    frame = spark.createDataFrame([(1, 1, "user", text), (2, 1, "user", text), (2, 2, "user", "b"), (3, 1, "user", text + ".")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"] for r in chat.rendered(frame).select("conv_id").collect()} == {2, 3}


@pytest.mark.parametrize("make", [lambda s, d: chat.rendered(s.read.parquet(f"{d}/conversations.parquet")), lambda s, d: op8_url_filter(s, d)])
def test_no_python_in_native_plans(spark, sf_dir, make):
    out = io.StringIO()
    with redirect_stdout(out):
        make(spark, sf_dir).explain()
    assert not re.search("Python|Pandas|Arrow", out.getvalue())
