"""Exports: CSV, JSON, and shapefile archives, one per commune, written by the tasks that hold their rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.grouping import groups_up_to
from parcelspark.sources.cad import dbf_table, shp_bytes
from parcelspark.sources.geojson import feature_text

#: Fields of the attribute table and their widths.
FIELDS = [("NICAD", 16), ("SYSCOL", 8), ("SECTION", 3), ("PARCELLE", 5)]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep=";", header=True, quote='"', escape='"')


def json_lines(df: DataFrame, geometry: str | None = None) -> DataFrame:
    """Rows as JSON, one text each, without the geometry column unless it is wanted. A time is written in UTC, nulls are left in."""
    df = df.drop(geometry) if geometry else df
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, geometry: str | None = None) -> None:
    json_lines(df, geometry).write.text(path)


def feature_lines(df: DataFrame, rings: str, columns: list[str]) -> DataFrame:
    """Rows as GeoJSON features, one text each: polygons with the given columns as properties, by their names."""
    props = F.create_map(*[c for name in columns for c in (F.lit(name), F.col(name).cast("string"))])
    return df.select(feature_text(F.lit("Polygon"), F.col(rings), props).alias("value"))


def _archived(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From parcels in the order of their archives (syscol, part) to the archives."""
    for t, group in groups_up_to(batches, ["syscol", "part"], 20_000, 1 << 62):
        begins = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), t.num_rows).tolist()
        whole, rows = {c: t[c].combine_chunks() for c in t.column_names}, []
        for a, b in zip(begins, begins[1:], strict=False):
            of = {c: v.slice(a, b - a) for c, v in whole.items()}
            syscol, part = of["syscol"][0].as_py(), of["part"][0].as_py()
            shp, shx = shp_bytes(of["rings"])
            out, name = io.BytesIO(), f"parcelles_{syscol}_{part}"
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for kind, data in (("shp", shp), ("shx", shx), ("dbf", dbf_table([of[n.lower()] for n, _ in FIELDS], FIELDS)), ("prj", b'PROJCS["WGS 84 / UTM zone 28N"]')):
                    z.writestr(zipfile.ZipInfo(f"{name}.{kind}"), data)
            rows.append((syscol, part, f"{name}.zip", b - a, out.getvalue()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["syscol", "part", "name", "n", "content"])


def shapefile_archives(parcels: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """Geometries are rings of one polygon, or parts (polygons), whose rings then stand side by side in one record.

    (syscol, part, name, n, content): a zip of .shp, .shx, .dbf and .prj for each commune; parcels of a commune beyond part_rows go to further parts, so that none is too large for a task. parcels: feature_idx, syscol, section, parcelle, nicad, rings."""
    if "parts" in parcels.columns:
        parcels = parcels.withColumn("rings", F.flatten("parts")).drop("parts")
    width = max(1, int(parcels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = parcels.groupBy("syscol").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    dealt = parcels.join(F.broadcast(sizes), "syscol").withColumn("part", F.pmod(F.xxhash64("feature_idx"), "parts").cast("int"))  # communes
    dealt = dealt.select("feature_idx", "syscol", "part", "rings", *[n.lower() for n, _ in FIELDS if n != "SYSCOL"])
    return dealt.repartition(width, "syscol", "part").sortWithinPartitions("syscol", "part", "feature_idx").mapInArrow(_archived, "syscol string, part int, name string, n long, content binary")
