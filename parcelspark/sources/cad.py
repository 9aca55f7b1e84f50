"""Binary files: shapefiles and archives. One file is one task's work; files are spread over tasks."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions.geometry import to_wgs84

SHAPES = "path string, feature_idx long, geom_type string, rings array<array<array<double>>>, props map<string,string>, utm28 boolean"
#: Formats in an archive, the first that it holds counts (fixed values).
PRECEDENCE = ["dxf", "dgn", "geojson", "json", "shp"]
RINGS = pa.list_(pa.list_(pa.list_(pa.float64())))
COLUMNS = pa.schema([("path", pa.string()), ("feature_idx", pa.int64()), ("geom_type", pa.string()), ("rings", RINGS), ("props", pa.map_(pa.string(), pa.string())), ("utm28", pa.bool_())])
#: Features that are handed on together.
FEATURES = 10_000


def polygon_records(data: bytes) -> Iterator[list[list[list[float]]]]:
    """Rings of each record of a .shp file; none for a null shape."""
    at = 100
    while at + 12 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        if struct.unpack("<i", body[:4])[0] in (3, 5):
            parts, points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            yield [[[xy[2 * i], xy[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        elif struct.unpack("<i", body[:4])[0] == 1:
            yield [[list(struct.unpack("<dd", body[4:20]))]]
        else:
            yield []
        at += 8 + size


def dbf_rows(data: bytes) -> list[dict[str, str]]:
    count, head, width = struct.unpack("<IHH", data[4:12])
    fields = [(data[k : k + 11].split(b"\0")[0].decode("latin-1"), data[k + 16]) for k in range(32, head - 1, 32)]
    rows = []
    for i in range(count):
        at, row = head + i * width + 1, {}
        for name, n in fields:
            row[name] = data[at : at + n].decode("latin-1").strip()
            at += n
        rows.append(row)
    return rows


def _lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, elements) of an array of lists."""
    o = lists.offsets.to_numpy().astype(np.int64)
    return o - o[0], lists.values.slice(o[0], o[-1] - o[0])


def shp_bytes(polygons: list | pa.Array) -> tuple[bytes, bytes]:
    """(.shp, .shx) of polygons (rings of points); one without points is a null shape. All records are laid out at once, in words of four bytes."""
    rows = polygons if isinstance(polygons, pa.Array) else pa.array([[[p[:2] for p in r] for r in rings] for rings in polygons], RINGS)
    of, rings = _lists(rows)
    at, points = _lists(rings)
    o = points.offsets.to_numpy()
    flat = points.values.to_numpy(zero_copy_only=False)
    xy = np.stack([flat[o[:-1]], flat[o[:-1] + 1]], axis=1).astype("<f8")
    first = at[of]
    n = np.diff(first)
    filled = np.flatnonzero(n)
    parts = np.where(n > 0, np.diff(of), 0)
    size = np.where(n > 0, 11 + parts + 4 * n, 1)
    start = 25 + np.cumsum(2 + size) - (2 + size)
    words = np.zeros(25 + int((2 + size).sum()), "<i4")
    words[start], words[start + 1] = np.arange(1, len(n) + 1).astype("<i4").byteswap(), (2 * size).astype("<i4").byteswap()
    body = start[filled] + 2
    words[body], words[body + 9], words[body + 10] = 5, parts[filled], n[filled]
    box = np.zeros((0, 4))
    if len(filled):
        box = np.concatenate([f.reduceat(xy, first[filled]) for f in (np.minimum, np.maximum)], axis=1)
        words[body[:, None] + np.arange(1, 9)] = np.ascontiguousarray(box, "<f8").view("<i4")
        row = np.repeat(np.arange(len(n)), np.diff(of))
        words[(start[row] + 13 + np.arange(len(row)) - of[row])[n[row] > 0]] = (at[:-1] - first[row])[n[row] > 0]
        row = np.repeat(np.arange(len(n)), n)
        words[(start[row] + 13 + parts[row] + 4 * (np.arange(len(row)) - first[row]))[:, None] + np.arange(4)] = xy.view("<i4").reshape(-1, 4)
    whole = (*box[:, :2].min(axis=0), *box[:, 2:].max(axis=0)) if len(box) else (0.0,) * 4
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + 2 * n) + struct.pack("<ii8d", 1000, 5, *whole, 0, 0, 0, 0)
    index = np.stack([2 * start, 2 * size], axis=1).astype(">i4")
    return head(len(words) - 25) + words[25:].tobytes(), head(2 * len(n)) + index.tobytes()


def _field(values: pa.Array, n: int) -> np.ndarray:
    """Texts in latin-1, cut or filled with blanks, as rows of n bytes."""
    def parts(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, o, data = raw.buffers()
        return np.frombuffer(o, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64), np.frombuffer(data or b"", np.uint8)

    if not len(values):
        return np.zeros((0, n), np.uint8)
    o, data = parts(values.cast(pa.string()).fill_null("").cast(pa.binary()))
    if (data[o[0] : o[-1]] > 127).any():
        o, data = parts(pa.array([(v or "").encode("latin-1", "replace") for v in values.to_pylist()], pa.binary()))
    size = np.minimum(np.diff(o), n)
    out = np.full((len(values), n), 32, np.uint8)
    row = np.repeat(np.arange(len(values)), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, k] = data[o[:-1][row] + k]
    return out


def dbf_table(columns: list[pa.Array], fields: list[tuple[str, int]]) -> bytes:
    """Character fields of fixed width in latin-1, cut or filled with blanks, from a column of texts for each."""
    count, width = len(columns[0]), 1 + sum(n for _, n in fields)
    head = struct.pack("<B3BIHH20x", 3, 124, 1, 1, count, 32 + 32 * len(fields) + 1, width)
    head += b"".join(name.encode("latin-1")[:11].ljust(11, b"\0") + b"C" + bytes(4) + bytes([n, 0]) + bytes(14) for name, n in fields) + b"\r"
    return head + np.concatenate([np.full((count, 1), 32, np.uint8), *[_field(c, n) for c, (_, n) in zip(columns, fields, strict=True)]], axis=1).tobytes() + b"\x1a"


def dbf_bytes(rows: list[dict[str, str | None]], fields: list[tuple[str, int]]) -> bytes:
    """As dbf_table, from a dict for each row."""
    return dbf_table([pa.array([row.get(name) for row in rows], pa.string()) for name, _ in fields], fields)


def _properties(data: bytes, n: int) -> pa.Array:
    """The rows of a .dbf as n maps of names to texts, empty beyond its end."""
    count, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = {}, 1
    for k in range(32, head - 1, 32):
        fields[data[k : k + 11].split(b"\0")[0].decode("latin-1")] = (at, data[k + 16])
        at += data[k + 16]
    rows = min(count, n)
    cells = np.frombuffer(data, np.uint8, min(rows * width, max(len(data) - head, 0)), head)
    if not fields or len(cells) < rows * width or at > width or ((cells < 32) | (cells > 126)).any():
        # Other letters than those of ASCII, control characters or cut files are read value by value.
        return pa.array([list(r.items()) for r in dbf_rows(data)[:n]] + [[]] * (n - rows), COLUMNS.field("props").type)
    cells = cells.reshape(rows, width)
    texts = []
    for at, size in fields.values():
        flat = pa.py_buffer(np.ascontiguousarray(cells[:, at : at + size]))
        texts.append(pc.utf8_trim(pa.StringArray.from_buffers(rows, pa.py_buffer((np.arange(rows + 1) * size).astype(np.int32)), flat), " "))
    k = len(fields)
    values = pa.concat_arrays(texts).take(pa.array((np.arange(rows)[:, None] + rows * np.arange(k)).ravel()))
    names = pa.array(list(fields), pa.string()).take(pa.array(np.tile(np.arange(k), rows)))
    return pa.MapArray.from_arrays(pa.array(np.minimum(np.arange(n + 1), rows) * k, pa.int32()), names, values)


def _records(data: bytes) -> pa.Array:
    """Rings of all records of a .shp file; none for a null shape."""
    starts, at, sizes = [], 100, struct.Struct(">i")
    while at + 12 <= len(data):
        starts.append(at + 8)
        at += 8 + 2 * sizes.unpack_from(data, at + 4)[0]
    start = np.array(starts, np.int64)
    if not len(start) or (start % 4).any() or at > len(data):
        return pa.array(list(polygon_records(data)), RINGS)
    words, start = np.frombuffer(data, "<i4", len(data) // 4), start // 4
    kind = words[start]
    shape, point = np.isin(kind, (3, 5)), kind == 1
    parts, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    parts[shape], n[shape] = words[start[shape] + 9], words[start[shape] + 10]
    row = np.repeat(np.arange(len(start)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = words[start[row] + 11 + k].astype(np.int64)
    end = np.append(begin[1:], 0)
    last = k == parts[row] - 1
    end[last] = n[row[last]]
    if (begin < 0).any() or (end < begin).any() or (end > n[row]).any():
        return pa.array(list(polygon_records(data)), RINGS)
    # Points are one ring of one point.
    size, at = end - begin, start[row] + 11 + parts[row] + 4 * begin
    if point.any():
        row, size, at = np.append(row, np.flatnonzero(point)), np.append(size, np.ones(point.sum(), np.int64)), np.append(at, start[point] + 1)
        order = np.argsort(row, kind="stable")
        row, size, at = row[order], size[order], at[order]
    of = np.repeat(at - 4 * (np.cumsum(size) - size), size) + 4 * np.arange(size.sum())
    xy = np.ascontiguousarray(words[of[:, None] + np.arange(4)]).view("<f8").ravel()
    ends = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
    points = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * 2, pa.int32()), pa.array(xy))
    return pa.ListArray.from_arrays(ends(np.bincount(row, minlength=len(start))), pa.ListArray.from_arrays(ends(size), points))


def features(path: str, by: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    """The features of a shapefile from its parts (shp, dbf, prj); the columns of a file are read at once."""
    if "shp" not in by:
        return
    rings, prj = _records(by["shp"]), (by.get("prj") or b"").decode("latin-1").upper()
    n = len(rings)
    props = _properties(by["dbf"], n) if by.get("dbf") else pa.array([[]] * n, COLUMNS.field("props").type)
    of, lines = _lists(rings)
    size = np.diff(_lists(lines)[0])
    first = np.append(size, 0)[of[:-1]]
    kind = pa.array(np.where(np.diff(of) == 0, 2, np.where(first > 1, 0, 1)))
    kind = pa.array(["Polygon", "Point", None]).take(kind)
    whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), n), pa.array(np.arange(n)), kind, rings, props, pa.repeat(pa.scalar("UTM" in prj and "28" in prj), n)], schema=COLUMNS)
    for k in range(0, n, FEATURES):
        yield whole.slice(k, FEATURES)


def shapes(parts: DataFrame) -> DataFrame:
    """Features of shapefiles from their parts (stem, kind, content: shp, dbf, prj); the parts of one meet in one task by its stem."""

    def parse(t: pa.Table) -> pa.Table:
        by = dict(zip(t["kind"].to_pylist(), t["content"].to_pylist(), strict=True))
        return pa.Table.from_batches(features(t["stem"][0].as_py(), by), COLUMNS)

    return parts.select("stem", "kind", "content").groupBy("stem").applyInArrow(parse, SHAPES)


def read_shapefiles(spark: SparkSession, folder: str) -> DataFrame:
    """All shapefiles of a folder (.shp with .dbf and .prj of the same name beside it)."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content").filter(F.col("path").rlike(r"(?i)\.(shp|dbf|prj)$"))
    return shapes(files.withColumn("stem", F.regexp_replace("path", r"(?i)\.[a-z]+$", "")).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))))


def _unzipped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (path, content) of zips to the features of their shapefiles, one shapefile after the other."""
    made, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                stems: dict[str, dict[str, str]] = {}
                for name, kind in counted(z):
                    if kind in ("shp", "dbf", "prj"):
                        stems.setdefault(name.rpartition(".")[0], {})[kind] = name
                for stem, names in stems.items():
                    for part in features(f"{path.as_py()}/{stem}", {k: z.read(n) for k, n in names.items()}):
                        made.append(part)
                        held += part.num_rows
                        if held >= FEATURES:
                            yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                            made, held = [], 0
    if made:
        yield from pa.Table.from_batches(made).combine_chunks().to_batches()


def zipped_shapes(archives: DataFrame) -> DataFrame:
    """Features of all shapefiles in archives (path, content). The parts of a shapefile lie in one archive, so they are read where it is unpacked."""
    return archives.select("path", "content").mapInArrow(_unzipped, SHAPES)


def in_degrees(features: DataFrame) -> DataFrame:
    """Features with rings in longitudes and latitudes: those of UTM zone 28, vertex by vertex; the others as they are."""
    point = lambda p: F.array(*to_wgs84(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    moved = F.transform("rings", lambda r: F.transform(r, point))
    return features.withColumn("rings", F.when(F.col("utm28"), moved).otherwise(F.col("rings")))


MEMBERS = pa.schema([("path", pa.string()), ("member", pa.string()), ("kind", pa.string()), ("content", pa.binary())])
#: Bytes of unpacked members that a task holds before it hands them on.
HELD = 8 << 20


def counted(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(member, kind) of what counts in a zip: the first format of PRECEDENCE that it holds, of shapefiles all parts; names without regard to case."""
    names = {n: n.rsplit(".", 1)[-1].lower() for n in z.namelist() if "." in n and not n.startswith("__MACOSX")}
    kind = next((k for k in PRECEDENCE if k in names.values()), None)
    wanted = {"shp", "dbf", "prj"} if kind == "shp" else {"geojson", "json"} if kind in ("geojson", "json") else {kind}
    return [(n, k) for n, k in sorted(names.items()) if k in wanted]


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (path, content) of zips to their members that count. Archives are unpacked one after the other and handed on, so a task holds no more of them than HELD and one member, however many a batch has."""
    rows, held = [], 0
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), MEMBERS, strict=True)], schema=MEMBERS)
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                for n, k in counted(z):
                    rows.append((path.as_py(), n, k, z.read(n)))
                    held += len(rows[-1][-1])
                    if held >= HELD:
                        yield made(rows)
                        rows, held = [], 0
    if rows:
        yield made(rows)


def members(archives: DataFrame) -> DataFrame:
    """archives (path, content) to (path, member, kind, content) of what counts in each zip: the first format of PRECEDENCE that it holds, of shapefiles all parts; names without regard to case."""
    return archives.select("path", "content").mapInArrow(unpacked, "path string, member string, kind string, content binary")


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """The members that count of a folder's zips."""
    return members(spark.read.format("binaryFile").load(folder).filter(F.lower("path").endswith(".zip")))


#: Formats of uploaded files, the first that fits the name counts (fixed values).
FORMATS = ["shp", "zip", "geojson", "json", "kml", "csv", "dgn", "dxf"]


def format_of(path: Column) -> Column:
    """The format that a file is read as, by its ending; null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending.isin(FORMATS), F.when(ending == "json", "geojson").otherwise(ending))
