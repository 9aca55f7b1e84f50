"""CSV with loose rules, points, and KML, as expressions over lines and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A number at the start of a text, as a lenient parser reads it.
LEADING = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def leading_number(c: Column) -> Column:
    """The number that a text starts with; null if none."""
    return F.regexp_extract(c, LEADING, 1).try_cast("double")


def separator(header: str) -> str:
    """; before tab before comma."""
    return ";" if ";" in header else "\t" if "\t" in header else ","


def unquoted(c: Column) -> Column:
    """Trimmed, without one quote at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^[\"']", ""), r"[\"']$", "")


def records(lines: DataFrame, header: str, line: str = "value") -> DataFrame:
    """Lines split by the header's separator, as a map of names to values in ``record``; a missing value is empty."""
    sep = separator(header)
    names = [h.strip().strip("\"'") for h in header.split(sep)]
    parts = F.split(F.col(line), "\\" + sep if sep != "\t" else "\t", -1)
    values = [x for k, n in enumerate(names) for x in (F.lit(n), F.coalesce(unquoted(F.get(parts, F.lit(k))), F.lit("")))]
    return lines.withColumn("record", F.create_map(*values))


def csv_points(lines: DataFrame, header: str, line: str = "value") -> DataFrame:
    """Points from comma-separated lines with a column of longitudes (lon, longitude, lng, x) and one of latitudes (lat, latitude, y); rows without two numbers are dropped."""
    names = [h.strip().strip('"').lower() for h in header.split(",")]
    at = {k: next(i for i, n in enumerate(names) if n in known) for k, known in (("x", ("lon", "longitude", "lng", "x")), ("y", ("lat", "latitude", "y")))}
    parts = F.split(F.col(line), ",", -1)
    out = lines.withColumns({k: leading_number(F.regexp_replace(F.get(parts, F.lit(i)), '"', "")) for k, i in at.items()})
    return out.filter("x is not null and y is not null")


def placemarks(documents: DataFrame, text: str = "value") -> DataFrame:
    """Polygons of KML: for each Placemark its first name and first coordinates, closed; those with fewer than 3 points are dropped."""
    marks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<Placemark[^>]*>(.*?)</Placemark>"), F.lit(1))
    rows = documents.select(*[c for c in documents.columns if c != text], F.posexplode(marks).alias("mark_idx", "mark"))
    points = F.filter(F.split(F.trim(F.regexp_extract("mark", r"(?s)<coordinates>(.*?)</coordinates>", 1)), r"\s+"), lambda s: F.contains(s, F.lit(",")))
    ring = F.transform(points, lambda s: F.transform(F.slice(F.split(s, ","), 1, 2), lambda v: v.try_cast("double")))
    rows = rows.select("*", F.trim(F.regexp_extract("mark", r"(?s)<name>(.*?)</name>", 1)).alias("name"), F.filter(ring, lambda p: F.forall(p, lambda v: v.isNotNull())).alias("ring")).filter(F.size("ring") >= 3)
    first, last = F.get("ring", F.lit(0)), F.get("ring", F.size("ring") - 1)
    return rows.withColumn("ring", F.when(first == last, F.col("ring")).otherwise(F.concat("ring", F.array(first)))).drop("mark")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return placemarks(spark.read.text(path, wholetext=True))


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with ; and doubled quotes."""
    return spark.read.schema(schema).csv(path, sep=";", quote='"', escape='"', header=True)


def quoted_records(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """lines with ``record``, the fields of a line separated by semicolons, quoted or not, quotes doubled inside."""
    return lines.withColumn("record", F.from_csv(F.col(line), schema, {"sep": ";", "quote": '"', "escape": '"'})).drop(line)


#: Boxes of the regions: name, code, least and most longitude, least and most latitude (fixed values).
REGIONS = [
    ("Dakar", "DK", -17.52, -17.15, 14.63, 14.83),
    ("Thiès", "TH", -17.40, -16.30, 14.60, 15.10),
    ("Diourbel", "DB", -16.60, -15.50, 14.50, 15.00),
    ("Fatick", "FK", -16.80, -15.70, 13.80, 14.60),
    ("Kaolack", "KL", -16.40, -15.00, 13.60, 14.40),
    ("Kaffrine", "KF", -15.80, -14.20, 13.50, 14.30),
    ("Tambacounda", "TC", -15.00, -11.50, 12.00, 14.00),
    ("Kolda", "KD", -16.00, -14.00, 12.20, 13.40),
    ("Sédhiou", "SD", -16.20, -14.80, 12.40, 13.20),
    ("Ziguinchor", "ZG", -16.80, -15.00, 12.20, 13.00),
    ("Saint-Louis", "SL", -16.80, -13.80, 15.00, 16.70),
    ("Louga", "LG", -17.20, -14.80, 14.80, 16.00),
    ("Matam", "MT", -14.50, -12.00, 14.50, 16.00),
    ("Kédougou", "KG", -12.80, -11.20, 12.00, 13.00),
]


def region_boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "name string, code string, x0 double, x1 double, y0 double, y1 double")
