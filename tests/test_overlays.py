"""Dissolved overlays, unions, repairs, contacts, gaps, projection and batches of corrections on cases made by hand and at random."""

import math
import random
import resource

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelspark.functions import geometry as geo
from parcelspark.functions import planar
from parcelspark.operators import batch, correction, quality
from parcelspark.operators.spatial import with_box

KIND = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def box(x0, y0, x1, y1):
    return [[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)], [float(x0), float(y0)]]


def of(*geometries):
    return pa.array(geometries, KIND)


def shoelace(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) / 2


def test_results_are_clean_rings():
    a = of([[box(0, 0, 4, 4)]], [[box(0, 0, 4, 4)]], [[box(0, 0, 4, 4)]], [[box(0, 0, 2, 2)]], [[box(0, 0, 10, 10)]], None)
    b = of([[box(2, 2, 6, 6)]], [[box(4, 0, 8, 4)]], [[box(1, 1, 2, 2)]], [[box(2, 2, 4, 4)]], [[box(2, 0, 4, 10)]], [[box(0, 0, 1, 1)]])
    union, less = planar.pieces(a, b, "union").to_pylist(), planar.pieces(a, b, "difference").to_pylist()
    assert [len(g) for g in union] == [1, 1, 1, 2, 1, 1] and len(union[1][0]) == 1 and union[1][0][0] == box(0, 0, 8, 4) and len(union[0][0][0]) == 9
    assert [len(r) for r in less[0][0]] == [7] and less[1] == [[box(0, 0, 4, 4)]] and [len(r) for r in less[2][0]] == [5, 5] and [len(g) for g in less] == [1, 1, 1, 1, 2, 0]
    assert all(shoelace(p[0]) > 0 and all(shoelace(h) < 0 for h in p[1:]) for g in union + less for p in g)


def test_rings_at_random_have_the_areas_of_their_results():
    rng = np.random.default_rng(8)
    made = lambda: [[[[float(v) for v in p] for p in rng.integers(0, 30, (rng.integers(3, 9), 2))] for _ in range(rng.integers(1, 3))] for _ in range(rng.integers(1, 3))]
    a, b = of(*[made() for _ in range(300)]), of(*[made() for _ in range(300)])
    for operation in planar.KEEP:
        want = planar.areas(a, b, operation)
        for area, g in zip(want, planar.pieces(a, b, operation).to_pylist(), strict=True):
            assert math.isclose(sum(shoelace(r) for p in g for r in p), area, abs_tol=1e-6) and all(shoelace(p[0]) > 0 for p in g)


def test_long_outlines_do_not_meet_edge_by_edge():
    t = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    r = 100 + 5 * np.sin(37 * t)
    outline = lambda dx: [[[[float(x), float(y)] for x, y in zip(dx + r * np.cos(t), r * np.sin(t), strict=True)]]]
    a, b = of(outline(0)), of(outline(30.3))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    both, either, own = planar.areas(a, b, "intersection")[0], planar.areas(a, b, "union")[0], planar.areas(a, b, "first")[0]
    exact = 20_000 / 2 * math.sin(2 * math.pi / 20_000) * (100**2 + 5**2 / 2)
    assert abs(own - exact) < 1.0 and math.isclose(both + either, 2 * own, rel_tol=1e-9)
    union = planar.pieces(a, b, "union").to_pylist()[0]
    assert math.isclose(sum(shoelace(x) for p in union for x in p), either, rel_tol=1e-9) and len(union[0][0]) > 20_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_slivers_that_overlap_count_once(spark):
    rows = [(1, [[box(0, 0, 10, 10)]], False), (2, [[box(10, 0, 10.9, 1)]], True), (3, [[box(10, 0, 10.9, 1)]], True)]
    layer = with_box(spark.createDataFrame(rows, f"feature_idx long, parts {planar.PARTS}, is_sliver boolean")).withColumn("area", planar.area(F.col("parts")))
    got = correction.merge_slivers(layer).collect()
    assert len(got) == 1 and math.isclose(got[0]["area"], 100.9) and got[0]["merged"] == 2 and [len(r) for r in got[0]["parts"][0]] == [7]


def test_all_rings_of_a_neighbour_count(spark):
    rows = [(1, [[box(0, 0, 10, 0.1)]], True), (2, [[box(50, 50, 60, 60)], [box(0, 0.1, 10, 5)]], False), (3, [[box(10, 0, 30, 30)]], False), (4, [[box(-20, -20, 60, 60), box(-10, -10, 40, 40)]], False)]
    layer = with_box(spark.createDataFrame(rows, f"feature_idx long, parts {planar.PARTS}, is_sliver boolean")).withColumn("area", planar.area(F.col("parts")))
    got = {r["sliver_idx"]: (r["neighbour_idx"], round(r["shared"], 3)) for r in correction.best_neighbours(layer, tolerance=0.5).collect()}
    assert got == {1: (2, 20.0)}
    # Without the second parcel the third one remains; the fourth one's box touches, but its hole keeps it away.
    got = {r["sliver_idx"]: r["neighbour_idx"] for r in correction.best_neighbours(layer.filter("feature_idx <> 2"), tolerance=0.01).collect()}
    assert got == {1: 3}


def test_boxes_without_end_and_huge_ones_have_a_union(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 0.0, float("inf"), 10.0), (3, None, 0.0, 1.0, 1.0), (4, 5.0, 5.0, 15.0, 15.0)]
    schema = "feature_idx long, x0 double, y0 double, x1 double, y1 double"
    assert quality.union_area(spark.createDataFrame(rows, schema)).first()[0] == 175.0
    huge = [*rows, (5, 0.0, 0.0, 1e6, 2e6), (6, 1e6, 0.0, 1e6 + 3, 1.0)]
    assert math.isclose(quality.union_area(spark.createDataFrame(huge, schema)).first()[0], 2e12 + 3)
    copies = [(k, 0.0, 0.0, 10.0, 10.0) for k in range(6000)]
    assert quality.union_area(spark.createDataFrame(copies, schema)).first()[0] == 100.0
    assert quality.union_area(spark.createDataFrame([], schema)).first()[0] == 0.0


def test_voids_across_cells(spark):
    """A ring of boxes around a void that several cells share, and one in a corner of the hull."""
    boxes = [(0, 0, 500, 20), (0, 480, 500, 500), (0, 20, 20, 480), (480, 20, 500, 480), (500, 0, 520, 500), (520, 0, 530, 100)]
    frame = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(boxes)], "feature_idx long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((round(r["area"], 3), round(r["x"], 3), round(r["y"], 3)) for r in quality.voids(frame, cell=120.0).collect())
    assert got == [(2000.0, round(520 + 10 / 3, 3), round(100 + 400 / 3, 3)), (460.0**2, 250.0, 250.0)]
    assert quality.voids(frame.filter("feature_idx < 0")).collect() == []


def test_repairs(spark):
    rows = [(1, [[[[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0], [0.0, 0.0]]]]), (2, [[box(0, 0, 4, 4), box(3, 1, 5, 3)]]), (3, [[box(0, 0, 4, 4)], [box(2, 2, 6, 6)]]), (4, [[box(0, 0, 4, 4), box(1, 1, 2, 2)]]), (5, None)]
    layer = spark.createDataFrame(rows, f"feature_idx long, parts {planar.PARTS}")
    got = {r["feature_idx"]: (r["faulty"], sum(shoelace(x) for p in r["parts"] or [] for x in p), len(r["parts"] or [])) for r in quality.repaired(layer).collect()}
    assert got == {1: (True, 8.0, 2), 2: (True, 16.0, 2), 3: (True, 28.0, 1), 4: (False, 15.0, 1), 5: (True, 0, 0)}


def test_projection_and_geodesics(spark):
    points = [(-17.45, 14.69), (-15.0, 0.0), (-12.1, 16.6), (-15.0, 15.0), (-14.0, -5.0)]
    frame = spark.createDataFrame(points, "lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = geo.to_wgs84(F.col("x"), F.col("y"))
    rows = frame.withColumn("x", x).withColumn("y", y).withColumn("lon2", lon).withColumn("lat2", lat).collect()
    assert all(abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9 for r in rows)
    assert (rows[1]["x"], rows[1]["y"]) == (500000.0, 0.0)
    # The length of a meridian's arc, by steps along the ellipsoid.
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    steps = np.linspace(0, math.radians(15), 200_001)
    radius = geo.AXIS * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5
    assert abs(rows[3]["y"] - 0.9996 * np.trapezoid(radius, steps)) < 1e-3
    d = spark.range(1).select(geo.geodesic(F.lit(-17.0), F.lit(14.0), F.lit(-17.0), F.lit(14.01)).alias("n"), geo.geodesic(F.lit(-17.0), F.lit(14.0), F.lit(-16.99), F.lit(14.0)).alias("e")).first()
    assert abs(d["n"] - 0.01 * math.pi / 180 * geo.AXIS * (1 - e2) / (1 - e2 * math.sin(math.radians(14.005)) ** 2) ** 1.5) < 1e-4
    assert abs(d["e"] - 0.01 * math.pi / 180 * geo.AXIS * math.cos(math.radians(14)) / math.sqrt(1 - e2 * math.sin(math.radians(14)) ** 2)) < 1e-4


def one_by_one(layer, requests, boundary):
    """The batch, one request after the other in plain Python."""
    layer, outcomes = dict(layer), {}
    over = lambda a, b, how: planar.pieces(of(a), of(b), how).to_pylist()[0]
    for id_, kind, action, k, other, gap in sorted(requests):
        refused = None
        if action not in correction.ACTIONS.get(kind, []):
            refused = "action not allowed"
        elif action != "ignore":
            two = action in ("clip_first", "clip_second", "merge_neighbor")
            if k not in layer or (two and other not in layer):
                refused = "not found"
            elif action in ("clip_first", "clip_second"):
                mine, with_ = (k, other) if action == "clip_first" else (other, k)
                layer[mine] = over(layer[mine], layer[with_], "difference")
                if not layer[mine]:
                    del layer[mine]
            elif action == "merge_neighbor":
                layer[other] = over(layer[other], layer.pop(k), "union")
            elif action == "delete":
                del layer[k]
            elif action == "assign_to_neighbor":
                layer[k] = over(layer[k], gap, "union")
            else:
                cut = over(layer[k], boundary, "intersection")
                refused, layer[k] = (None, cut) if cut else ("no intersection", layer[k])
        outcomes[id_] = refused
    return {k: round(planar.areas(of(g), of(None), "first")[0], 6) for k, g in layer.items()}, outcomes


def test_a_batch_is_as_one_after_the_other(spark):
    rng = random.Random(11)
    layer = [(k, [[box(k % 6 * 8, k // 6 * 8, k % 6 * 8 + 10, k // 6 * 8 + 10)]]) for k in range(30)]
    requests = []
    for id_ in range(60):
        kind = rng.choice(["OVERLAP", "OVERLAP", "SLIVER", "GAP", "BOUNDARY_CROSS", "INVALID_GEOM"])
        action = rng.choice([*correction.ACTIONS[kind][:2], "delete"] if rng.random() < 0.9 else ["ignore"])
        k = rng.randrange(31)
        requests.append((id_, kind, action, k, (k + rng.choice([1, 6])) % 30, [[box(k % 6 * 8 + 9, k // 6 * 8, k % 6 * 8 + 11, k // 6 * 8 + 4)]]))
    boundary = [[box(5, 5, 20, 20)]]
    frame = spark.createDataFrame(layer, f"feature_idx long, parts {planar.PARTS}")
    asked = spark.createDataFrame(requests, f"request_id long, error_type string, action string, feature_idx long, other_idx long, gap {planar.PARTS}")
    after, outcomes = batch.apply(frame, asked, spark.createDataFrame([(1, boundary)], f"k long, b {planar.PARTS}"))
    got = {r["feature_idx"]: round(r["a"], 6) for r in after.select("feature_idx", planar.area(F.col("parts")).alias("a")).collect()}
    want, refused = one_by_one(layer, requests, boundary)
    assert {r["request_id"]: r["refused"] for r in outcomes.collect()} == refused and len({*refused.values()}) >= 3
    assert got == want


def test_no_arrays_of_single_rings(monkeypatch):
    """Overlays of many rows make arrays for all of them, none for a ring or a row."""
    kind = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
    box = lambda x, y, w, h: [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]]
    a, b = (pa.array([box(40.0 * k + d, 0.0, 44.0, 30.0) for k in range(500)], kind) for d in (0.0, 40.0))
    calls = []
    for name in ("roll", "concatenate"):
        of = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *args, of=of, **how: calls.append(1) or of(*args, **how))
    left = planar.pieces(a, b, "difference").to_pylist()
    assert len(calls) < 500
    assert [sorted(map(tuple, g[0][0][:-1])) for g in left] == [sorted([(40.0 * k, 0.0), (40.0 * k + 40, 0.0), (40.0 * k + 40, 30.0), (40.0 * k, 30.0)]) for k in range(500)]


def test_operations_by_row():
    """Rows of different operations are worked out together and come back in their order."""
    kind = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
    box = lambda x: [[[[x, 0.0], [x + 4, 0.0], [x + 4, 2.0], [x, 2.0], [x, 0.0]]]]
    hows = ["union", None, "difference", "intersection", "difference", "union"]
    a, b = pa.array([box(10.0 * k) for k in range(6)], kind), pa.array([box(10.0 * k + 1) if k != 4 else None for k in range(6)], kind)
    got = planar.mixed_pieces(a, b, pa.array(hows)).to_pylist()
    want = [planar.pieces(a.slice(k, 1), b.slice(k, 1), h).to_pylist()[0] if h else None for k, h in enumerate(hows)]
    assert got == want
    assert planar.mixed_pieces(a, b, pa.nulls(6, pa.string())).to_pylist() == [None] * 6
