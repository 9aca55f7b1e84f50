"""Faces of networks of lines, components and running counts, against plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelspark.operators import components, lineage, network
from parcelspark.operators.components import connected
from parcelspark.operators.grouping import groups_up_to
from parcelspark.operators.network import polygonize
from parcelspark.operators.running import running
from parcelspark.operators.spatial import box_join

LINES = "net string, points array<array<double>>"


def faces(spark, nets, **how):
    """Area, rings and points of the outer ring of the faces of each net, all from one call."""
    rows = spark.createDataFrame([(n, None if line is None else [[float(x), float(y)] for x, y in line]) for n, lines in nets.items() for line in lines], LINES)
    found = {n: [] for n in nets}
    for r in polygonize(rows, **how).collect():
        found[r["net"]].append((round(r["area"], 6), len(r["rings"]), len(r["rings"][0])))
    return {n: sorted(f) for n, f in found.items()}


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_known_networks(spark):
    nets = {
        "cut": ([box(0, 0, 4, 4), [(2, -1), (2, 5)], [(9, 9), (9.5, 9.5)]], [(8.0, 1, 5), (8.0, 1, 5)]),
        "a bow-tie, whose crossing is no node yet": ([[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]], [(4.0, 1, 4), (4.0, 1, 4)]),
        "islands within an island": ([box(0, 0, 30, 30), box(5, 5, 25, 25), box(10, 10, 12, 12)], [(4.0, 1, 5), (396.0, 2, 5), (500.0, 2, 5)]),
        "a bridge, and a line that ends inside": ([box(0, 0, 2, 2), box(5, 0, 7, 2), [(2, 1), (5, 1)], [(6, 2), (6, 1)]], [(4.0, 1, 6), (4.0, 1, 7)]),
        "lines that overlap or repeat backwards": ([[(0, 0), (3, 0)], [(5, 0), (1, 0)], [(5, 0), (5, 5)], [(5, 5), (0, 0)], [(0, 0), (5, 5)]], [(12.5, 1, 6)]),
        "odd": ([[(0, 0), (float("nan"), 1), (3, 3)], [(1, 1)], [(2, 2), (2, 2)], None], []),
        "the same as another": ([box(0, 0, 4, 4)], [(16.0, 1, 5)]),
    }
    assert faces(spark, {n: lines for n, (lines, _) in nets.items()}) == {n: want for n, (_, want) in nets.items()}


def test_limits_of_area(spark):
    nets = {"n": [box(0, 0, 4, 4), box(10, 0, 12, 2), box(20, 0, 30, 30)]}
    assert faces(spark, nets, least=5.0, most=100.0) == {"n": [(16.0, 1, 5)]}


def plain_faces(lines):
    """Areas of the faces of long lines that cross each other: a walk over exact fractions of half-edges."""
    cut = defaultdict(set)
    for i, (p, q) in enumerate(lines):
        for j, (r, s) in enumerate(lines):
            d, e = (q[0] - p[0], q[1] - p[1]), (s[0] - r[0], s[1] - r[1])
            turn = d[0] * e[1] - d[1] * e[0]
            if i != j and turn:
                t, u = (((r[0] - p[0]) * f[1] - (r[1] - p[1]) * f[0]) / turn for f in (e, d))
                if 0 <= t <= 1 and 0 <= u <= 1:
                    cut[i].add(t)
    around = defaultdict(list)
    for i, (p, q) in enumerate(lines):
        nodes = [(round(p[0] + t * (q[0] - p[0]), 3), round(p[1] + t * (q[1] - p[1]), 3)) for t in sorted(cut[i])]
        for a, b in zip(nodes, nodes[1:], strict=False):
            if a != b:
                around[a].append(b)
                around[b].append(a)
    for a, others in around.items():
        others.sort(key=lambda b, a=a: math.atan2(b[1] - a[1], b[0] - a[0]))
    seen, areas = set(), []
    for a in around:
        for b in around[a]:
            ring, at = [], (a, b)
            while at not in seen:
                seen.add(at)
                ring.append(at[0])
                others = around[at[1]]
                at = (at[1], others[others.index(at[0]) - 1])
            area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
            if area > 1e-3:
                areas.append(area)
    return sorted(areas)


def test_random_lines(spark):
    rng = random.Random(4)
    lines = [((rng.uniform(0, 5), rng.uniform(0, 100)), (rng.uniform(95, 100), rng.uniform(0, 100))) for _ in range(12)] + [((rng.uniform(0, 100), rng.uniform(0, 5)), (rng.uniform(0, 100), rng.uniform(95, 100))) for _ in range(12)]
    lines = [tuple((round(x, 3), round(y, 3)) for x, y in line) for line in lines]
    got = [a for a, _, _ in faces(spark, {"n": lines}, size=10.0, least=1e-3)["n"]]
    want = plain_faces(lines)
    assert len(got) == len(want) > 80 and all(abs(a - b) < 0.5 for a, b in zip(got, want, strict=True)) and abs(sum(got) - sum(want)) < 0.5


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 3)
    name = lambda c: F.unhex(F.md5(F.concat(F.col(c).cast("string"))))
    pairs = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(i, 100) for i in range(100, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links = spark.createDataFrame(pairs, "x long, y long").select(name("x").alias("a"), name("y").alias("b"))
    ids = spark.createDataFrame([(x,) for x in {v for p in pairs for v in p}], "x long").select("x", name("x").alias("id"))
    groups = defaultdict(set)
    for r in connected(links).join(ids, "id").collect():
        groups[bytes(r["root"])].add(r["x"])
    assert sorted(map(sorted, groups.values())) == sorted([list(range(0, 20)), list(range(20, 40)), list(range(40, 60)), list(range(100, 130)), [200, 201, 202], [300]])


def test_running_values(spark):
    rows = [(g, i, i % 3 if i % 5 else None) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, v long").withColumn("bucket", F.floor(F.col("i") / 7))
    got = running(df, ["g"], "bucket", ["i"], sums={"s": F.col("v")}, latest={"m": F.when(F.col("v") == 2, F.col("i"))}).orderBy("g", "i").collect()
    for g in "ab":
        s, m = 0, None
        for r in (r for r in got if r["g"] == g):
            s, m = s + (r["v"] or 0), r["i"] if r["v"] == 2 else m
            assert (r["s"], r["m"]) == (s, m)


def test_components_leave_one_table(spark, tmp_path, monkeypatch):
    """What rounds have written is deleted when it has been read; only the result stays."""
    written = tmp_path / "shared"
    written.mkdir()
    monkeypatch.setattr(lineage, "shared_dir", lambda _: str(written))
    monkeypatch.setattr(components, "FEW", 50)
    name = lambda v: F.unhex(F.md5(v.cast("string")))
    out = connected(spark.range(2000).filter("id % 20 <> 19").select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b")))
    assert len(list(written.iterdir())) == 1
    assert out.groupBy("root").count().filter("count = 20").count() == 100


def test_shared_ends_are_no_cuts(spark):
    """Segments that only share an end cut nothing; one that ends on another, or crosses it, does."""
    segs = spark.createDataFrame([("n", 0, 0, 100, 0), ("n", 0, 0, 0, 100), ("n", 50, 0, 50, 80), ("n", 0, 40, 90, 40)], "net string, ax long, ay long, bx long, by long")
    boxes = segs.select("net", F.struct(*network.ENDS).alias("seg"), *[F.col(f"{e}{c}").cast("double").alias(f"{c}{k}") for k, e in enumerate("ab") for c in "xy"])
    pairs = box_join(boxes, boxes, 60.0, self_join_on="seg", by=["net"]).select("l_net", "l_seg", "r_seg")
    assert {(r.ax, r.ay, r.x, r.y) for r in network._cuts(pairs).collect()} == {(0, 0, 50, 0), (0, 0, 0, 40), (0, 40, 50, 40), (50, 0, 50, 40)}


def field(n, x0=0.0, y0=0.0):
    """Cells of 10 by 10 whose sides neighbours repeat, an island in each, a line through all of them, and one that ends in a cell."""
    lines = [[(x + x0, y + y0) for x, y in line] for i in range(n) for j in range(n) for line in (box(10 * i, 10 * j, 10 * i + 10, 10 * j + 10), box(10 * i + 2, 10 * j + 2, 10 * i + 4, 10 * j + 5))]
    return lines + [[(x0, y0 + 6), (x0 + 10 * n, y0 + 6)], [(x0 + 5, y0 + 10), (x0 + 5, y0 + 9)]]


def field_faces(n):
    return sorted([(100.0 - 6, 2, 5)] * (n * n - n) + [(60.0 - 6, 2, 5)] * n + [(40.0, 1, 5)] * n + [(6.0, 1, 5)] * (n * n))


def test_faces_across_tiles(spark, monkeypatch):
    """Outlines in one tile take no part in the components; faces and holes of several tiles come out whole."""
    sizes = []
    monkeypatch.setattr(network, "connected", lambda links: sizes.append(links.count()) or connected(links))
    got = faces(spark, {"n": field(20)}, size=2.0)["n"]
    # Points that neighbours have on a side are nodes of the cells beside the long line only.
    assert sorted((a, r) for a, r, _ in got) == sorted((a, r) for a, r, _ in field_faces(20))
    assert len(sizes) == 1 and 0 < sizes[0] < 20 * 20 * 8 / 3


def test_tiles_with_too_many_rows(spark, monkeypatch):
    """They go through joins and windows, with the same faces."""
    calls = []
    monkeypatch.setattr(network, "MOST", 20)
    monkeypatch.setattr(network, "ROWS", 10)
    cuts = network._cuts
    monkeypatch.setattr(network, "_cuts", lambda pairs: calls.append(1) or cuts(pairs))
    got = faces(spark, {"n": field(6), "small": [box(0, 0, 4, 4), [(2, -1), (2, 5)]]}, size=1.0)
    assert sorted((a, r) for a, r, _ in got["n"]) == sorted((a, r) for a, r, _ in field_faces(6))
    assert got["small"] == [(8.0, 1, 5), (8.0, 1, 5)] and calls


def test_drawings_far_north(spark):
    """A drawing that goes on beyond 4,000 km keeps its lines."""
    nets = {f"{y}": field(2, 250_000.0, y) for y in (3_749_990.0, 17_800_000.0, -9_000_000.0)}
    for got in faces(spark, nets).values():
        assert sorted((a, r) for a, r, _ in got) == sorted((a, r) for a, r, _ in field_faces(2))


def test_groups_in_parts():
    """Groups come whole, and in parts where they are too large; null is a group of its own."""
    keys = ["a"] * 3 + ["b"] * 50 + ["c"] * 2 + [None] * 4 + ["d"] * 25 + ["e"]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 7], pa.string()), "v": list(range(i, min(i + 7, len(keys))))}) for i in range(0, len(keys), 7)]
    rows, whole, large = [], [], []
    for t, group in groups_up_to(iter(batches), ["k"], 6, 20):
        rows += t["v"].to_pylist()
        assert t.num_rows <= 20 + 7 + 6
        if group is None:
            large += t["k"].to_pylist()
        else:
            names = t["k"].to_pylist()
            assert len({(g, n) for g, n in zip(group.tolist(), names, strict=True)}) == len(np.unique(group)) == len(set(names))
            whole += [n for n, first in zip(names, np.append(True, group[1:] != group[:-1]), strict=True) if first]
    assert rows == list(range(len(keys))) and whole == ["a", "c", None, "e"] and large == ["b"] * 50 + ["d"] * 25
