"""Every query of the library against its SQL twin, and the driver's entry points."""

import ast
import re
from pathlib import Path

import pytest

from parcelspark.plans import catalogue
from tests.conftest import ROOT, SMALL
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        same(frame, con, catalogue.ORACLES[name])
    else:
        assert frame.count() >= 0


def test_entry_points(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).columns


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "parcelspark").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_no_local_checkpoints():
    for p in [*Path(ROOT / "parcelspark").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
        assert not p.exists() or not re.search(r"\.localCheckpoint\(", p.read_text())
