"""The corpus pipeline, stage by stage against brute force on its own input."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from parcelspark.llm import packing
from parcelspark.llm.common import materialise

from .test_mixing import brute_targets, size
from .test_near_duplicates import brute_texts


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input rows, output) of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, sf_dir))
        out[name] = docs, made
        docs = made
    return out


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "mixing to target weights", "best-fit packing"]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for _, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns


def test_rejected_documents_go(stages, spark, sf_dir):
    before, after = (Counter(rows_of(x)) for x in stages["quality classifier"])
    assert not after - before
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r[0] for r in after}
    good = [d in kept for d, q in labels.items() if q == 1 and any(r[0] == d for r in before)]
    assert sum(good) >= 0.75 * len(good)


def test_one_of_each_group_stays(stages):
    before, after = (x.select("doc_id", "text").collect() for x in stages["MinHash near-dedup"])
    want = {d for d, _, _, kept in brute_texts([tuple(r) for r in before], 5, 80) if kept}
    assert Counter(r["doc_id"] for r in after) == Counter(want)


def test_sources_reach_their_targets(stages):
    before, after = (x.select("source", "text").collect() for x in stages["mixing to target weights"])
    sizes, got = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r["text"])
    for r in after:
        got[r["source"]] += size(r["text"])
    targets = brute_targets(sizes)
    assert all(abs(got[s] - targets[s]) <= 1 for s in sizes)


def test_every_document_is_packed(stages):
    before, after = stages["best-fit packing"]
    rows = after.collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in before.select("doc_id").collect())
    fills = Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= packing.CAPACITY


def test_run_is_the_stages_in_turn(stages, spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    want = stages["best-fit packing"][1]
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got.collect()) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in want.collect())


def test_operators_do_not_swallow_import_errors():
    folder = os.path.dirname(packing.__file__)
    for name in [os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".py")] + [corpus_pipeline.__file__]:
        with open(name) as f:
            assert not re.search(r"except\s+(ImportError|ModuleNotFoundError|Exception)", f.read())


#: Columns that clash with names inside the operators.
ODD = "doc_id long, text string, lang string, source string, n_chars int, key string, node string, slots int, row long, size long, score double"


def odd_rows():
    long = "word " * 60_000
    texts = [None, "", " \n", "a b c d e f", "a b c d e f", long, long, "The parcel lies north of the road, near the river."]
    rows = [(k, t, None if k % 3 else "en", "web" if k % 2 else None, len(t or ""), "k", "n", 1, 2, 3, 0.5) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[0], (None, "a b c d e f", "en", "web", 11, "k", "n", 1, 2, 3, 0.5), (None, None, None, None, None, None, None, None, None, None, None)]


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, repeats and columns that clash: what each stage returns is what its docstring says."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    stage = dict(corpus_pipeline.STAGES)
    before = Counter(map(tuple, docs.collect()))

    judged = stage["quality classifier"](spark, docs, sf_dir)
    assert judged.columns == docs.columns
    after = Counter(map(tuple, judged.collect()))
    assert all(after[r] in (0, n) for r, n in before.items()) and not after - before
    texts = {r[1]: r in after for r in before}
    assert all((r in after) == texts[r[1]] for r in before)

    kept = stage["MinHash near-dedup"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r[0], r[1]) for r in odd_rows() if r[0] not in (4, 6))

    mixed = stage["mixing to target weights"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert any(r["doc_id"] == x[0] and (x[1] or "").startswith(r["text"] or "") for x in odd_rows())

    packed = stage["best-fit packing"](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in odd_rows())
    assert sum(r["length"] == 1 for r in packed) == 5


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, sf_dir, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], ODD), sf_dir)
    assert out.count() == 0


def test_written_tables_are_shared_and_go(spark, sf_dir):
    """Tables of an operator that is done are deleted, but for its result; on a cluster there must be a shared folder."""
    from unittest import mock

    from parcelspark.llm.queries import op5_embedding_dedup
    from parcelspark.operators.lineage import shared_dir

    folder = shared_dir(spark).replace("file:", "")
    count = lambda: len([n for n in os.listdir(folder) if n.startswith("table-")])
    before = count()
    rows = op5_embedding_dedup(spark, sf_dir)
    assert count() == before + 1 and rows.count() > 0
    cluster = mock.Mock()
    cluster.sparkContext.getCheckpointDir.return_value, cluster.sparkContext.master = None, "spark://host:7077"
    cluster.conf.get.return_value = None
    with pytest.raises(ValueError):
        shared_dir(cluster)
