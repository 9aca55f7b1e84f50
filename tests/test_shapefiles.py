"""Shapefiles in ranges of records, written by several tasks and read again."""

import io
import random
import struct
import time
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from parcelspark.functions import geometry as geo
from parcelspark.sources import cad, export, shapefiles


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    boxes = [[[[float(k), 0.0], [k + 1.0, 0.0], [k + 1.0, 1.0 + k % 3], [float(k), 0.0]]] if k % 10 else [] for k in range(1003)]
    shp, shx = cad.shp_bytes(boxes)
    for ending, data in (("shp", shp), ("SHX", shx), ("dbf", cad.dbf_bytes([{"NICAD": str(k), "NOM": "é"} for k in range(1000)], [("NICAD", 16), ("NOM", 4)])), ("prj", shapefiles.UTM28)):
        (tmp_path / f"a.{ending}").write_bytes(data)
    (tmp_path / "b.shp").write_bytes(cad.shp_bytes(boxes[:3])[0])
    (tmp_path / "c.txt").write_text("no shapefile")
    found = shapefiles.read(spark, str(tmp_path), records=100)
    assert found.rdd.getNumPartitions() >= 12
    rows = sorted(found.collect(), key=lambda r: (r["path"], r["feature_idx"]))
    a, b = [r for r in rows if r["path"].endswith("/a")], [r for r in rows if r["path"].endswith("/b")]
    assert [r["rings"] for r in a] == boxes and [r["feature_idx"] for r in a] == list(range(1003)) and all(r["utm28"] for r in a)
    assert [r["props"] for r in a] == [{"NICAD": str(k), "NOM": "é"} for k in range(1000)] + [{}] * 3 and a[0]["geom_type"] is None and a[1]["geom_type"] == "Polygon"
    assert [r["rings"] for r in b] == boxes[:3] and not any(r["utm28"] for r in b)
    assert shapefiles.read(spark, str(tmp_path / "a.shp")).count() == 1003


def test_tasks_write_files_of_their_own(spark, tmp_path):
    k = F.col("id").cast("double")
    rows = spark.range(0, 5000, 1, 4).select(F.array(geo.rectangle(k, k, k + 1, k + 2)).alias("rings"), F.create_map(F.lit("NICAD"), F.col("id").cast("string")).alias("props"))
    shapefiles.write(rows, str(tmp_path / "out"), [("NICAD", 16)])
    assert len(list((tmp_path / "out").glob("*.shp"))) == 4 and not list((tmp_path / "out").glob("_temporary*"))
    back = shapefiles.read(spark, str(tmp_path / "out"), records=700)
    got = back.agg(F.count("*"), F.sum(F.col("props")["NICAD"].cast("long")), F.sum(geo.polygon_area(F.col("rings")))).first()
    assert tuple(got) == (5000, 5000 * 4999 // 2, 10_000.0)
    shapefiles.write(rows.limit(0), str(tmp_path / "none"), [("NICAD", 16)])


def test_writing_grows_with_the_records():
    """30,000 records take seconds of a processor, not the square of their number."""
    boxes = [[[[k, 0.0], [k + 1.0, 0.0], [k + 1.0, 1.0], [k, 1.0], [k, 0.0]]] for k in map(float, range(30_000))]
    start = time.process_time()
    shp, shx = cad.shp_bytes(boxes)
    assert time.process_time() - start < 6
    assert (len(shp), len(shx)) == (100 + 30_000 * 136, 100 + 30_000 * 8)


def test_archives_are_handed_on_one_by_one():
    """A batch of many archives is never unpacked as a whole."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.shp", bytes(1 << 20))
        z.writestr("a.DBF", b"x")
        z.writestr("a.shx", b"y")
    batch = pa.RecordBatch.from_pydict({"path": [f"{k}.zip" for k in range(60)], "content": [out.getvalue()] * 60})
    sizes, rows = [], []
    for made in cad.unpacked(iter([batch])):
        sizes.append(made.nbytes)
        rows += [(r["path"], r["member"], r["kind"], len(r["content"])) for r in made.to_pylist()]
    assert max(sizes) < 2 * cad.HELD < sum(sizes)
    assert rows == [(f"{k}.zip", *m) for k in range(60) for m in (("a.DBF", "dbf", 1), ("a.shp", "shp", 1 << 20))]


def polygons(rng, n):
    """Polygons of none to three rings, none to nine points in each."""
    point = lambda: [rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6)]
    return [[[point() for _ in range(rng.randrange(1, 10))] for _ in range(rng.randrange(4))] for _ in range(n)]


def plain_record(k, rings):
    """A record of a .shp file, as the format says."""
    flat = [p for r in rings for p in r]
    body = struct.pack("<i", 0)
    if flat:
        x, y = zip(*flat, strict=True)
        starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
        body = struct.pack("<i4dii", 5, min(x), min(y), max(x), max(y), len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in flat)
    return struct.pack(">ii", k, len(body) // 2) + body


def test_records_of_all_shapes_at_once():
    rng = random.Random(7)
    boxes = [*polygons(rng, 300), [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]], []]
    flat = [[[p[:2] for p in r] for r in rings] for rings in boxes]
    shp, shx = cad.shp_bytes(boxes)
    assert shp[100:] == b"".join(plain_record(k, rings) for k, rings in enumerate(flat, 1))
    assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx)
    every = [p for rings in flat for r in rings for p in r]
    assert struct.unpack("<4d", shp[36:68]) == (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every))
    for k in range(len(boxes)):
        at, size = (v * 2 for v in struct.unpack(">ii", shx[100 + 8 * k : 108 + 8 * k]))
        assert shp[at : at + 8] == struct.pack(">ii", k + 1, size // 2)
    sliced = pa.array(flat, cad.RINGS).slice(20, 100)
    assert cad.shp_bytes(sliced)[0] == cad.shp_bytes(flat[20:120])[0]
    assert cad.shp_bytes([]) == cad.shp_bytes(pa.array([], cad.RINGS)) and len(cad.shp_bytes([])[0]) == 100
    assert cad.shp_bytes(pa.array([None, []], cad.RINGS)) == cad.shp_bytes([[], []])
    # Points, lines, records of odd lengths, and parts that are out of order.
    point, line = struct.pack("<idd", 1, 7.0, 8.0), struct.pack("<i4dii", 3, 0, 0, 1, 1, 1, 2) + struct.pack("<i4d", 0, 0.0, 0.0, 1.0, 1.0)
    odd = struct.pack("<i4dii", 5, 0, 0, 1, 1, 2, 2) + struct.pack("<2i4d", 1, 0, 0.0, 0.0, 1.0, 1.0)
    record = lambda body: struct.pack(">ii", 1, len(body) // 2) + body
    for more in ([point], [line, point], [struct.pack("<i", 11) + bytes(32)], [point + b"ab", line], [odd]):
        data = shp + b"".join(map(record, more))
        assert cad._records(data).to_pylist() == list(cad.polygon_records(data))
    assert cad._records(shp[:100]).to_pylist() == []


def test_attributes_of_all_kinds_at_once():
    rng = random.Random(8)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(9)))
    for letters in ("ab 1-", "aé €", "a\t b"):
        rows = [{"A": text(letters) if rng.random() < 0.9 else None, "B": text(letters)} for _ in range(50)]
        data = cad.dbf_bytes(rows, [("A", 6), ("B", 3), ("C", 2)])
        cut = lambda v, n: (v or "").encode("latin-1", "replace")[:n].decode("latin-1").strip()
        want = [{"A": cut(r["A"], 6), "B": cut(r["B"], 3), "C": ""} for r in rows]
        assert cad.dbf_rows(data) == want
        for n in (0, 20, 50, 60):
            assert [dict(m) for m in cad._properties(data, n).to_pylist()] == (want + [{}] * 10)[:n]
        assert [dict(m) for m in cad._properties(data[:-60], 50).to_pylist()] == cad.dbf_rows(data[:-60])


def test_archives_there_and_back(spark):
    """The parts of a shapefile are read where its archive is unpacked, without a shuffle, and a record costs some microseconds."""
    k = F.col("id").cast("double")
    rings = F.when(F.col("id") % 31 > 0, F.array(geo.rectangle(k, k, k + 1, k + 2)))
    parcels = spark.range(0, 3000, 1, 4).select(F.col("id").alias("feature_idx"), F.concat(F.lit("0143010"), (F.col("id") % 3).cast("string")).alias("syscol"), F.lit("001").alias("section"), F.lit(None).cast("string").alias("parcelle"), F.col("id").cast("string").alias("nicad"), rings.alias("rings"))
    made = export.shapefile_archives(parcels, part_rows=100).localCheckpoint()
    assert made.count() > 20 and made.agg(F.sum("n")).first()[0] == 3000
    back = cad.zipped_shapes(made.select(F.col("name").alias("path"), "content"))
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    rows = back.collect()
    assert sorted(int(r["props"]["NICAD"]) for r in rows) == list(range(3000)) and all(r["utm28"] and r["props"]["PARCELLE"] == "" for r in rows)
    for r in rows:
        v = int(r["props"]["NICAD"])
        assert r["rings"] == ([[[v, v], [v + 1, v], [v + 1, v + 2], [v, v + 2], [v, v]]] if v % 31 else []) and r["geom_type"] == ("Polygon" if v % 31 else None)
        assert r["path"].startswith(f"parcelles_0143010{v % 3}_")
    n = 60_000
    table = pa.RecordBatch.from_pydict({"syscol": ["1"] * n, "part": pa.array([v // 500 for v in range(n)], pa.int32()), "rings": pa.array([[[[v, 0.0], [v + 1.0, 0.0], [v + 1.0, 1.0], [v, 0.0]]] for v in map(float, range(n))], cad.RINGS), "nicad": ["a"] * n, "section": ["b"] * n, "parcelle": [None] * n})
    start = time.process_time()
    files = [pa.RecordBatch.from_arrays([b["name"], b["content"]], names=["path", "content"]) for b in export._archived(iter([table]))]
    assert sum(b.num_rows for b in cad._unzipped(iter(files))) == n
    assert time.process_time() - start < 3
