"""Shapefiles as a data source: tasks read ranges of records, which the index (.shx) finds in the geometries (.shp) and which have a fixed width in the attributes (.dbf); so one large file is read by several tasks. Tasks write files of their own, which appear when all of them are done."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from parcelspark.sources.cad import SHAPES, dbf_bytes, dbf_rows, polygon_records, shp_bytes

#: Records that a task reads at a time, and that a file which is written has at most; tasks that read, at least, before they take several ranges each.
RECORDS, WRITTEN, TASKS = 50_000, 50_000, 256
UTM28 = b'PROJCS["WGS 84 / UTM zone 28N"]'
#: SHAPES in Arrow: batches of columns cross to Spark as they are, rows would be turned one value at a time. Rows of a batch.
COLUMNS = pa.schema([("path", pa.string()), ("feature_idx", pa.int64()), ("geom_type", pa.string()), ("rings", pa.list_(pa.list_(pa.list_(pa.float64())))), ("props", pa.map_(pa.string(), pa.string())), ("utm28", pa.bool_())])
BATCH = 10_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Range(InputPartition):
    """Records [first, last) of one file, in steps that are read one after the other; last None: all, where there is no index."""

    stem: str
    names: dict[str, str]
    first: int
    last: int | None
    step: int = RECORDS


def _bytes(store: fs.FileSystem, name: str, at: int = 0, size: int | None = None) -> bytes:
    with store.open_input_file(name) as f:
        return f.read_at(f.size() - at if size is None else size, at)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.records, self.tasks = options["path"], int(options.get("records", RECORDS)), int(options.get("tasks", TASKS))

    def partitions(self) -> list[Range]:
        store, root = _store(self.path)
        kind = store.get_file_info(root).type
        found = [root] if kind == fs.FileType.File else [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File]
        stems: dict[str, dict[str, str]] = {}
        for name in sorted(found if kind != fs.FileType.File else [i.path for i in store.get_file_info(fs.FileSelector(root.rsplit("/", 1)[0])) if i.path.rsplit(".", 1)[0] == root.rsplit(".", 1)[0]]):
            stem, _, ending = name.rpartition(".")
            if ending.lower() in ("shp", "shx", "dbf", "prj"):
                stems.setdefault(stem, {})[ending.lower()] = name
        out = []
        counts = {stem: (store.get_file_info(names["shx"]).size - 100) // 8 for stem, names in stems.items() if "shx" in names}
        # Where there are many ranges, a task reads several in a row.
        each = self.records * max(1, -(-sum(-(-n // self.records) for n in counts.values()) // self.tasks))
        for stem, names in stems.items():
            if "shx" in names:
                n = counts[stem]
                out += [Range(stem, names, k, min(k + each, n), self.records) for k in range(0, n, each)]
            elif "shp" in names:
                out.append(Range(stem, names, 0, None))
        return [r for r in out if "shp" in r.names]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.last is None:
            yield from self._read(partition, partition.first, None)
        else:
            for first in range(partition.first, partition.last, partition.step):
                yield from self._read(partition, first, min(first + partition.step, partition.last))

    def _read(self, partition: Range, first: int, last: int | None) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        names = partition.names
        prj = _bytes(store, names["prj"]).decode("latin-1") if "prj" in names else ""
        utm = "UTM" in prj.upper() and "28" in prj
        if last is None:
            shp = _bytes(store, names["shp"])
        else:
            index = _bytes(store, names["shx"], 100 + 8 * first, 8 * (last - first))
            begin, (end, size) = struct.unpack(">i", index[:4])[0] * 2, struct.unpack(">ii", index[-8:])
            shp = bytes(100) + _bytes(store, names["shp"], begin, end * 2 + size * 2 + 8 - begin)
        props = []
        if "dbf" in names:
            head = _bytes(store, names["dbf"], 0, 32)
            count, start, width = struct.unpack("<IHH", head[4:12])
            upto = count if last is None else min(last, count)
            fields = _bytes(store, names["dbf"], 0, start)
            rows = _bytes(store, names["dbf"], start + first * width, max(upto - first, 0) * width)
            props = dbf_rows(fields[:4] + struct.pack("<I", max(upto - first, 0)) + fields[8:] + rows)
        records, k = polygon_records(shp), 0
        while shapes := list(islice(records, BATCH)):
            kinds = ["Polygon" if rings and len(rings[0]) > 1 else "Point" if rings else None for rings in shapes]
            named = [list(props[i].items()) if i < len(props) else [] for i in range(k, k + len(shapes))]
            columns = [[partition.stem] * len(shapes), range(first + k, first + k + len(shapes)), kinds, shapes, named, [utm] * len(shapes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COLUMNS, strict=True)], schema=COLUMNS)
            k += len(shapes)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    """Rows of rings (array of rings) and props (a map of texts); options: path, fields as name:width, separated by commas."""

    def __init__(self, options, schema):
        self.path, self.columns = options["path"], schema.names
        self.fields = [(f.split(":")[0], int(f.split(":")[1])) for f in options["fields"].split(",")]
        self.folder = f"_temporary-{uuid.uuid4().hex}"

    def _flush(self, rows: list[tuple]) -> str:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.folder}")
        name = f"part-{uuid.uuid4().hex}"
        shp, shx = shp_bytes([r[0] or [] for r in rows])
        for ending, data in (("shp", shp), ("shx", shx), ("dbf", dbf_bytes([r[1] or {} for r in rows], self.fields)), ("prj", UTM28)):
            with store.open_output_stream(f"{root}/{self.folder}/{name}.{ending}") as f:
                f.write(data)
        return name

    def write(self, iterator) -> Written:
        rings, props, held, names = self.columns.index("rings"), self.columns.index("props"), [], []
        for batch in iterator:
            held += zip(batch.column(rings).to_pylist(), [dict(m or ()) for m in batch.column(props).to_pylist()], strict=True)
            while len(held) >= WRITTEN:
                names.append(self._flush(held[:WRITTEN]))
                held = held[WRITTEN:]
        return Written(names + ([self._flush(held)] if held else []))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for name in [n for m in messages if m is not None for n in m.names]:
            for ending in ("shp", "shx", "dbf", "prj"):
                store.move(f"{root}/{self.folder}/{name}.{ending}", f"{root}/{name}.{ending}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.folder}")


class Shapefiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SHAPES

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def read(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """The features of a shapefile, or of all in a folder: path, feature_idx, geom_type, rings, props, utm28."""
    spark.dataSource.register(Shapefiles)
    return spark.read.format("shapefile").option("records", records).option("tasks", max(TASKS, 8 * spark.sparkContext.defaultParallelism)).load(path)


def write(df: DataFrame, path: str, fields: list[tuple[str, int]]) -> None:
    """Shapefiles of df (rings, props), one or more from each task; fields: names and widths of the attributes."""
    df.sparkSession.dataSource.register(Shapefiles)
    df.select("rings", "props").write.format("shapefile").mode("append").option("fields", ",".join(f"{n}:{w}" for n, w in fields)).save(path)
