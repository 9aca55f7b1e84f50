"""Drawings as rows: entities, blocks within blocks, odd files, and reading in splits."""

import pytest

from parcelspark.sources import dxf


def text(*pairs):
    return "".join(f"{c}\n{v}\n" for c, v in pairs)


def section(name, *pairs):
    return text((0, "SECTION"), (2, name), *pairs, (0, "ENDSEC"))


def block(name, *pairs, base=(0, 0)):
    return [(0, "BLOCK"), (2, name), (10, base[0]), (20, base[1]), *pairs, (0, "ENDBLK")]


def rows(spark, *contents):
    frame = spark.createDataFrame([(f"{k}.dxf", bytearray(c.encode("latin-1"))) for k, c in enumerate(contents)], "path string, content binary")
    found = sorted(dxf.dxf_features(frame).collect(), key=lambda r: (r["path"], r["feature_idx"]))
    return [(r["geom_type"], r["layer"], r["label"], [[round(v, 6) for v in p] for p in r["points"]]) for r in found]


LINE = [(0, "LINE"), (8, 0), (10, 0), (20, 0), (11, 1), (21, 0)]


def test_drawing(spark):
    content = section("BLOCKS", *block("B", *LINE)) + section("ENTITIES", (0, "INSERT"), (2, "B"), (8, "PARCELLES"), (10, 5), (20, 5), (50, 90), (41, 2), (0, "LWPOLYLINE"), (8, "P"), (70, 1), (10, 0), (20, 0), (10, 4), (20, 0), (10, 4), (20, 4), (0, "TEXT"), (8, "N"), (1, "Lot\\P12 é"), (10, 1), (20, 2)) + text((0, "EOF"))
    want = [("LineString", "PARCELLES", "", [[5, 5], [5, 7]]), ("Polygon", "P", "", [[0, 0], [4, 0], [4, 4], [0, 0]]), ("Point", "N", "Lot\n12 é", [[1, 2]])]
    assert rows(spark, content) == want and rows(spark, content.replace("\n", "\r\n"), content.replace("\n", "\r")) == want * 2


def test_blocks_within_blocks(spark):
    inner = block("I", (0, "POINT"), (8, ""), (10, 3), (20, 1), *LINE[:1], (8, "OWN"), *LINE[2:], base=(1, 1))
    outer = block("O", (0, "INSERT"), (2, "I"), (8, 0), (10, 10), (20, 0), (42, 3), (0, "INSERT"), (2, "NONE"), (0, "INSERT"), (2, "I"), (8, "L"), (10, 0), (20, 0))
    content = section("BLOCKS", *inner, *outer) + section("ENTITIES", (0, "INSERT"), (2, "O"), (8, "A"), (10, 100), (20, 0), (50, 180), (0, "POINT"), (10, 7), (20, 7))
    assert rows(spark, content) == [("Point", "A", "", [[88, 0]]), ("LineString", "OWN", "", [[91, 3], [90, 3]]), ("Point", "L", "", [[98, 0]]), ("LineString", "OWN", "", [[101, 1], [100, 1]]), ("Point", "0", "", [[7, 7]])]


def test_a_block_that_holds_itself_ends(spark):
    content = section("BLOCKS", *block("B", (0, "POINT"), (10, 1), (20, 0), (0, "INSERT"), (2, "B"), (10, 1), (20, 0))) + section("ENTITIES", (0, "INSERT"), (2, "B"))
    assert sorted(r[3][0][0] for r in rows(spark, content)) == [float(k) for k in range(1, dxf.DEEPEST + 1)]


def test_polylines_and_odd_values(spark):
    vertex = lambda x, y: [(0, "VERTEX"), (10, x), (20, y)]
    content = section("ENTITIES", (0, "POLYLINE"), (8, "LOST"), *vertex(0, 0), *vertex(1, 1), (0, "POLYLINE"), (8, "P"), (70, 9), *vertex(0, 0), *vertex(2, "x"), *vertex(2, 0), *vertex(2, 2), (0, "SEQEND"), *vertex(9, 9), (0, "POLYLINE"), (8, "OPEN"), *vertex(5, 5), *vertex(6, 6), (0, "LINE"), (10, 1), (20, 1), (0, "LWPOLYLINE"), (10, 1), (20, 1), (10, 2), (0, "MTEXT"), (3, "a"), (3, "b"), (1, "c "), (10, 1), (20, 1), (0, "TEXT"), (1, "nowhere"), (0, "HATCH"), (10, 1), (20, 1))
    assert rows(spark, content) == [("Polygon", "P", "", [[0, 0], [2, 0], [2, 2], [0, 0]]), ("LineString", "OPEN", "", [[5, 5], [6, 6]]), ("Point", "0", "abc", [[1, 1]])]


def test_no_drawing(spark):
    assert rows(spark, "", "no\ndrawing", section("HEADER", *LINE), text((0, "EOF"))) == []
    empty = spark.createDataFrame([], "path string, content binary")
    assert dxf.dxf_features(empty).collect() == []


@pytest.mark.parametrize("size", ["1m", "4k"])
def test_files_are_read_in_splits(spark, tmp_path, size):
    content = section("BLOCKS", *block("B", *LINE)) + section("ENTITIES", *[p for k in range(800) for p in [(0, "INSERT"), (2, "B"), (8, f"L{k % 7}"), (10, k), (20, k)]], (0, "TEXT"), (1, "end"), (10, 1), (20, 1))
    (tmp_path / "a.dxf").write_text(content)
    (tmp_path / "b.dxf").write_text(content.replace("end", "other"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = dxf.read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 2 * 801
    for name, label in (("a.dxf", "end"), ("b.dxf", "other")):
        own = sorted((r for r in found if r["path"].endswith(name)), key=lambda r: r["feature_idx"])
        assert [r["feature_idx"] for r in own] == list(range(801)) and own[800]["label"] == label
        assert all(own[k]["points"] == [[k, k], [k + 1, k]] and own[k]["layer"] == f"L{k % 7}" for k in range(800))
