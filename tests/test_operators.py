"""Operators, functions and formats on small cases: trips through files, hand-made geometry, odd values."""

import decimal
import io
import math
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelspark.functions import geometry as geo
from parcelspark.functions import planar
from parcelspark.functions import nicad as nic
from parcelspark.operators import cad as layers
from parcelspark.operators import correction, listing, quality
from parcelspark.operators.lookups import by_key
from parcelspark.operators.spatial import box_join, points_in
from parcelspark.sources import cad, export, geojson, tables
from tests.oracle import plain

SQUARE = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
HOLE = [*SQUARE, [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]]
SHIFTED = [[[2.0, 2.0], [6.0, 2.0], [6.0, 6.0], [2.0, 6.0], [2.0, 2.0]]]
TRIANGLE = [[[0.0, 0.0], [8.0, 0.0], [0.0, 8.0], [0.0, 0.0]]]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("raw, errors", [(None, ["empty"]), (" - ", ["empty"]), ("12", ["length"]), ("12a", ["not_numeric", "length"]), ("0000000000000001", ["syscol_zero", "section_zero"]), ("0143-0101 001·00002", []), ("0143010100100000", [])])
def test_identifier_errors(spark, raw, errors):
    assert one(spark, nic.errors(F.lit(raw).cast("string")))[0] == errors


def test_identifier_parts(spark):
    r = one(spark, nic.parcel_number(F.lit("Lot 1234567"))[0], nic.parcel_number(F.lit("x"))[1], nic.section_number(F.lit("12345")), nic.syscol_number(F.lit("abc")), nic.prefix_of(F.lit("123")), nic.generated(F.lit("1"), F.lit("2"), F.lit("3")), nic.generated(F.lit("123456789"), F.lit("2"), F.lit("3")), nic.same_parcel(F.lit("0143010100100002"), F.lit("0143020100100002")))
    assert tuple(r) == ("34567", "none", "345", "00000000", "12300000", "0000000100200003", None, True)


def geometries(*polygons):
    return pa.array([[p] if p else [] for p in polygons], pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))


@pytest.mark.parametrize("a, b, operation, area", [(SQUARE, SHIFTED, "intersection", 4.0), (SQUARE, SHIFTED, "union", 28.0), (SQUARE, SHIFTED, "difference", 12.0), (HOLE, SQUARE, "intersection", 15.0), (TRIANGLE, SQUARE, "intersection", 16.0), (TRIANGLE, SHIFTED, "intersection", 8.0), (SQUARE, [], "intersection", 0.0), (SQUARE, SQUARE, "difference", 0.0)])
def test_overlay(a, b, operation, area):
    x, y = geometries(a, SQUARE, a), geometries(b, SQUARE, b)
    assert np.allclose(planar.areas(x, y, operation), [area, 0.0 if operation == "difference" else 16.0, area])
    made = planar.pieces(x, y, operation)
    assert np.allclose(planar.areas(made, geometries([], [], []), "first"), [area, 0.0 if operation == "difference" else 16.0, area])


def test_overlay_of_nulls():
    x = pa.array([None, [SQUARE], []], pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))
    assert planar.areas(x, geometries(SQUARE, SHIFTED, SQUARE), "intersection").tolist() == [0.0, 4.0, 0.0]
    assert planar.pieces(x, geometries(SQUARE, SHIFTED, SQUARE), "intersection").to_pylist()[0] == []
    assert planar.areas(x.slice(0, 0), x.slice(0, 0), "union").tolist() == []


def hull_of(points):
    h = planar.hull(np.array([p[0] for p in points], float), np.array([p[1] for p in points], float))
    return [h.tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=7, unique=True), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=7, unique=True))
def test_areas_add_up(p, q):
    a, b = hull_of(p), hull_of(q)
    if len(a[0]) < 3 or len(b[0]) < 3:
        return
    x, y = geometries(a), geometries(b)
    area = lambda op, x=x, y=y: planar.areas(x, y, op)[0]
    assert math.isclose(area("first"), abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a[0], a[0][1:] + a[0][:1], strict=True))) / 2, abs_tol=1e-6)
    assert math.isclose(area("union"), area("first") + area("first", y) - area("intersection"), abs_tol=1e-6)
    assert math.isclose(area("difference"), area("first") - area("intersection"), abs_tol=1e-6)
    # What two geometries cover together, in one cell and in four.
    both = geometries(a, b)
    whole = planar.covered(both, np.array([0, 0]), np.array([[-1.0, -1.0, 21.0, 21.0]]))
    quarters = np.array([[i * 10.0, j * 10.0, i * 10 + 10.0, j * 10 + 10.0] for i in range(2) for j in range(2)])
    four = planar.covered(pa.concat_arrays([both] * 4), np.repeat(np.arange(4), 2), quarters)
    assert math.isclose(whole[0], area("union"), abs_tol=1e-6) and math.isclose(four.sum(), area("union"), abs_tol=1e-6)


def test_a_hull_of_many_points():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 100, (5000, 2)).astype(float)
    h = planar.hull(points[:, 0], points[:, 1])
    side = (np.roll(h, -1, 0) - h)[:, None] * (points[None] - h[:, None])[..., ::-1]
    assert (side[..., 0] - side[..., 1] >= -1e-9).all() and {tuple(p) for p in h} <= {tuple(p) for p in points}


def test_boxes_of_any_size_meet(spark):
    """One bad coordinate does not make millions of cells."""
    boxes = [(0, 0.0, 0.0, 1_000_000.0, 2_000_000.0), (1, 5.0, 5.0, 2e6, 3e6), (2, 10.0, 10.0, 20.0, 20.0), (3, 19.0, 19.0, 700.0, 700.0), (4, -1e9, -1e9, 1e9, 1e9), (5, 3e6, 3e6, 3e6 + 1, 3e6 + 1), (6, None, 0.0, 1.0, 1.0), (7, float("nan"), 0.0, 1.0, 1.0), (8, float("-inf"), 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(boxes, "k long, x0 double, y0 double, x1 double, y1 double")
    got = {(r["l_k"], r["r_k"]) for r in box_join(frame, frame, 60.0, self_join_on="k").collect()}
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    assert got == {(a[0], b[0]) for a in boxes[:6] for b in boxes[:6] if a[0] < b[0] and meet(a, b)}


def test_geometry_expressions(spark):
    ring, polygon = F.lit(SQUARE[0]), F.lit(HOLE)
    inside = lambda x, y: geo.point_in_ring(F.lit(x), F.lit(y), ring)
    r = one(spark, geo.polygon_area(polygon), inside(1.0, 1.0), inside(4.0, 2.0), inside(5.0, 2.0), geo.ring_area(F.lit([[0.0, 0.0]])))
    assert tuple(r) == (15.0, True, True, False, 0.0)
    lon, lat = one(spark, *geo.to_wgs84(F.lit(500000.0), F.lit(0.0)))
    assert abs(lon + 15) < 1e-9 and abs(lat) < 1e-9
    assert tuple(one(spark, *geo.to_wgs84(F.lit(-17.4), F.lit(14.7)))) == (-17.4, 14.7)
    x, y = one(spark, *geo.affine(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(90.0), F.lit(10.0), F.lit(0.0)))
    assert abs(x - 10) < 1e-9 and abs(y - 2) < 1e-9


def test_points_find_the_first_box(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 200.0, 20.0)], "box_idx long, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 6.0, 6.0), (2, 150.0, 7.0), (3, 10.0, 10.0), (4, -5.0, 0.0), (5, None, 1.0)], "p long, x double, y double")
    got = {r["p"]: r["b_box_idx"] for r in points_in(points, boxes, 7.0, "p", "box_idx").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: None, 5: None}


def test_geojson_forms(spark):
    docs = [(1, '{"type":"FeatureCollection","features":[null,{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"nicad":"1","NICAD":"2"}}]}'), (2, '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":null}'), (3, '{"type":"FeatureCollection"}')]
    frame = spark.createDataFrame(docs, "doc long, value string")
    rows = {r["doc"]: r for r in geojson.features(frame).collect()}
    assert set(rows) == {1, 2} and rows[1]["props"] == {"nicad": "1", "NICAD": "2"} and rows[1]["rings"][0][2] == [1.0, 1.0] and rows[2]["props"] == {}
    bad = spark.createDataFrame([(1, '{"type":"Point"}')], "doc long, value string")
    assert [(r["feature_idx"], r["geom_type"]) for r in geojson.features(bad, strict=False).collect()] == [(0, None)]
    with pytest.raises(Exception, match="invalid GeoJSON"):
        geojson.features(bad).collect()


def test_geojson_files(spark, tmp_path):
    frame = spark.createDataFrame([("Polygon", SQUARE, {"nicad": "7"})], "geom_type string, rings array<array<array<double>>>, props map<string,string>")
    geojson.write(frame, str(tmp_path / "out"))
    back = geojson.read(spark, str(tmp_path / "out" / "*.txt")).first()
    assert back["rings"] == SQUARE and back["props"] == {"nicad": "7"}


def test_shapefiles_there_and_back(spark, tmp_path):
    shp, _ = cad.shp_bytes([HOLE, [], SHIFTED])
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(cad.dbf_bytes([{"NICAD": "1"}, {"NICAD": None}, {"NICAD": "é" * 20}], [("NICAD", 16)]))
    (tmp_path / "a.prj").write_text('PROJCS["WGS 84 / UTM zone 28N"]')
    rows = sorted(cad.read_shapefiles(spark, str(tmp_path)).collect(), key=lambda r: r["feature_idx"])
    assert [r["rings"] for r in rows] == [HOLE, [], SHIFTED] and [r["props"]["NICAD"] for r in rows] == ["1", "", "é" * 16] and all(r["utm28"] for r in rows)


def test_shapefile_archives(spark, tmp_path):
    parcels = spark.createDataFrame([(k, f"0143010{k % 2}", "001", f"{k:05d}", f"n{k}", SQUARE) for k in range(6)], "feature_idx long, syscol string, section string, parcelle string, nicad string, rings array<array<array<double>>>")
    rows = export.shapefile_archives(parcels, part_rows=2).collect()
    assert sum(r["n"] for r in rows) == 6 and {r["syscol"] for r in rows} == {"01430100", "01430101"}
    for r in rows:
        (tmp_path / r["name"]).write_bytes(r["content"])
        with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
            assert {n.rsplit(".", 1)[1] for n in z.namelist()} == {"shp", "shx", "dbf", "prj"}
    members = cad.archive_members(spark, str(tmp_path)).collect()
    assert {m["kind"] for m in members} == {"shp", "dbf", "prj"} and len(members) == 3 * len(rows)


def test_csv_rules(spark, tmp_path):
    assert [tables.separator(h) for h in ("a;b,c", "a\tb,c", "a,b")] == [";", "\t", ","]
    lines = spark.createDataFrame([("'1'\t\"x\"",), ("2",)], "value string")
    assert [r["record"] for r in tables.records(lines, '"a"\tb').collect()] == [{"a": "1", "b": "x"}, {"a": "2", "b": ""}]
    r = one(spark, listing.csv_line([F.lit(None).cast("string"), F.lit('a;"b'), F.lit(3)]))
    assert r[0] == ';"a;""b";3'
    export.write_csv(spark.createDataFrame([("a;b", 'c"d')], "x string, y string"), str(tmp_path / "csv"))
    assert tuple(tables.read_quoted_csv(spark, str(tmp_path / "csv"), "x string, y string").first()) == ("a;b", 'c"d')


def test_corrections(spark):
    allowed = one(spark, correction.allowed(F.lit("overlap"), F.lit("clip_first")), correction.allowed(F.lit("gap"), F.lit("delete")))
    assert tuple(allowed) == (True, False)
    pairs = spark.createDataFrame([(1, 2, [SQUARE], [SHIFTED]), (3, 4, [SQUARE], [SQUARE])], f"i long, j long, a {planar.PARTS}, b {planar.PARTS}")
    rows = {r["i"]: r for r in correction.clip(pairs).collect()}
    assert rows[1]["left_area"] == 12.0 and not rows[1]["deleted"] and rows[3]["deleted"]


def test_renumbering(spark):
    frame = spark.createDataFrame([(k,) for k in (5, 1, 90_000, 7, 4097)], "k long")
    assert {r["k"]: r["position"] for r in listing.renumbered(frame, "k").collect()} == {1: 0, 5: 1, 7: 2, 4097: 3, 90_000: 4}


def test_keys_that_are_too_long_find_nothing(spark):
    rows = spark.createDataFrame([("14301039", "001", "00001", "2026")], "syscol string, section string, parcelle string, version string")
    found = lambda **k: by_key(rows, **k).count()
    assert found(syscol="14301039", section="1", parcelle="1") == 1 and found(syscol="143010391") == 0 and found(section="0011") == 0 and found(parcelle="000012") == 0


def test_whole_numbers_are_compared_exactly():
    assert plain(1704067207179) != plain(1704067207180) and plain(3) == plain(3.0) == plain(decimal.Decimal("3.00"))


def test_selections_have_no_cap_of_their_own(spark):
    """More entities than a screen takes: all come back, unless a number is given."""
    entities = spark.range(0, layers.RETURNED_CAP + 1000, 1, 4).select(F.col("id").alias("feature_idx"), F.lit("x1").alias("layer"), F.lit("Polygon").alias("geom_type"), F.lit("").alias("label"))
    assert layers.selected_or_all(entities).count() == layers.RETURNED_CAP + 1000
    assert layers.selected_or_all(entities, total=7).count() == 7
    assert layers.capped(entities.withColumn("layer", F.lit("Limites-Parcelles")), 20, 20).count() == layers.RETURNED_CAP + 1000


def test_point_of_ring_is_made_once(spark):
    """The ring, which may be a long expression, is not repeated for its mean, nor the mean for each edge."""
    x, _ = geo.point_on(F.col("outline_of_it"))
    assert str(x).count("outline_of_it") == 1
    rings = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 9.0], [9.0, 9.0], [9.0, 0.0], [8.0, 0.0], [8.0, 8.0], [1.0, 8.0], [1.0, 0.0], [0.0, 0.0]]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "k int, r array<array<double>>")
    x, y = geo.point_on(F.col("r"))
    assert [tuple(v) for v in df.orderBy("k").select(x, y).collect()] == [(2.0, 2.0), (0.0, 0.0)]


def test_numbers_beyond_six_digits_stay_apart(spark):
    rows = spark.createDataFrame([(k, "AUTO_999998" if k == 0 else "7" if k % 2 else "", k > 0 and k % 2 == 0) for k in range(0, 9000, 500)] + [(1, "AUTO_x", False)], "feature_idx long, nicad string, missing boolean")
    got = correction.assign_auto(rows).orderBy("feature_idx").collect()
    assert [r["nicad"] for r in got] == [f"AUTO_{999_999 + k}" for k in range(17)]
