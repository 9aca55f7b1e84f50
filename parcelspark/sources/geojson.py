"""GeoJSON: one document per row in, features out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "STRUCT<type: STRING, geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>"
DOCUMENT = f"STRUCT<type: STRING, features: ARRAY<{FEATURE}>, geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>"
RINGS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"


def features(documents: DataFrame, text: str = "value", strict: bool = True) -> DataFrame:
    """Documents (any columns and a text) to their features: feature_idx, geom_type, coordinates (JSON), rings (of polygons), parts (of polygons and multipolygons, as an array of polygons), props.

    A FeatureCollection gives its features without the null ones, a lone Feature with a geometry itself; other documents are an error if strict, else each is taken for one feature, whatever it lacks. Properties are a map, since their names differ by case only."""
    root = F.from_json(F.col(text), DOCUMENT)
    lone = F.struct(root["type"].alias("type"), root["geometry"].alias("geometry"), root["properties"].alias("properties"))
    bad = F.raise_error(F.lit("invalid GeoJSON: a FeatureCollection or a Feature is needed")).cast(f"ARRAY<{FEATURE}>") if strict else F.array(lone)
    found = F.when(root["type"] == "FeatureCollection", F.filter(F.coalesce(root["features"], F.array().cast(f"ARRAY<{FEATURE}>")), lambda f: f.isNotNull())).when((root["type"] == "Feature") & root["geometry"].isNotNull(), F.array(lone)).otherwise(bad)
    rest = [c for c in documents.columns if c != text]
    rows = documents.select(*rest, F.posexplode(found).alias("feature_idx", "f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygon = F.when(kind == "Polygon", F.from_json(coordinates, RINGS))
    parts = F.when(kind == "Polygon", F.array(F.from_json(coordinates, RINGS))).when(kind == "MultiPolygon", F.from_json(coordinates, f"ARRAY<{RINGS}>"))
    return rows.select(*rest, F.col("feature_idx").cast("bigint").alias("feature_idx"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), polygon.alias("rings"), parts.alias("parts"), F.coalesce("f.properties", F.create_map().cast("MAP<STRING, STRING>")).alias("props"))


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """rows (props) with some of their properties as columns of the given types; null where a text is none of its type."""
    return rows.withColumns({name: F.try_element_at(F.col("props"), F.lit(name)).try_cast(kind) for name, kind in types.items()})


def vertices(geom_type: Column, coordinates: Column) -> Column:
    """All vertices of a geometry of any type, from the JSON of its coordinates; null for collections of geometries."""
    of = lambda depth: F.from_json(coordinates, "ARRAY<" * depth + "DOUBLE" + ">" * depth)
    return F.when(geom_type == "Point", F.array(of(1))).when(geom_type.isin("MultiPoint", "LineString"), of(2)).when(geom_type.isin("MultiLineString", "Polygon"), F.flatten(of(3))).when(geom_type == "MultiPolygon", F.flatten(F.flatten(of(4))))


def multi_text(parts: Column, srid: int = 4326) -> Column:
    """A geometry as the text that spatial databases load, always of several polygons."""
    number = lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number(F.get(p, F.lit(0))), number(F.get(p, F.lit(1))))), ","), F.lit(")"))
    polygon = lambda g: F.concat(F.lit("("), F.array_join(F.transform(g, ring), ","), F.lit(")"))
    return F.concat(F.lit(f"SRID={srid};MULTIPOLYGON("), F.array_join(F.transform(parts, polygon), ","), F.lit(")"))


def collection(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Documents of many features, one for each group: groups and value. rows: feature (JSON) and an order feature_idx; a group's features become one text, so groups are to be small."""
    item = F.array_sort(F.collect_list(F.struct("feature_idx", "feature")))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(item, lambda f: f["feature"]), ","), F.lit("]}"))
    return rows.groupBy(*groups).agg(text.alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return features(spark.read.text(path, wholetext=True))


def feature_text(geom_type: Column, rings: Column, props: Column) -> Column:
    """A feature as JSON."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(geom_type.alias("type"), rings.alias("coordinates")).alias("geometry"), props.alias("properties")))


def write(df: DataFrame, path: str) -> None:
    """One feature a line (newline-delimited GeoJSON), in parallel; df has geom_type, rings, props."""
    df.select(feature_text(F.col("geom_type"), F.col("rings"), F.col("props"))).write.text(path)
