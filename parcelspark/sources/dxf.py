"""DXF drawings as rows: lines become pairs of a code and a value, pairs entities, entities features, all by joins and running counts, so that one drawing is shared by all tasks.

A pair of code 0 begins an entity, one of code 10 a vertex: their numbers are running counts. What an entity stands in, a section or a block, and which polyline a vertex belongs to, is the latest such mark before it. Inserts of blocks are expanded level by level, at most ``DEEPEST`` times: each is a row with the six numbers of its placement and the layer that its block's layer 0 takes, joined to what its block holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.operators.lineage import materialise, tidy
from parcelspark.operators.running import running

DEEPEST = 16
#: Pairs, and entities, that are numbered together.
RANGE = 1 << 16
#: Entities that stand for a mark in a drawing, not for something drawn (fixed values of the format).
SCOPES = ["SECTION", "ENDSEC", "BLOCK", "ENDBLK"]
DRAWN = ["TEXT", "MTEXT", "POINT", "LINE", "LWPOLYLINE", "POLYLINE"]
PLACEMENT = ["m00", "m01", "m10", "m11", "tx", "ty"]


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """path, i, code, value of the files at a path, read in splits. Lines are numbered within their split, and splits by the sums of those before."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # Written once: the ids of rows hold while they are read again.
    lines = running(materialise(lines), ["path"], "block", ["at"], sums={"n": F.lit(1).cast("long")})
    line = F.col("n") - 1
    rows = lines.groupBy("path", F.floor(line / 2).cast("long").alias("i")).agg(F.max(F.when(line % 2 == 0, F.col("value"))).alias("code"), F.max(F.when(line % 2 == 1, F.col("value"))).alias("value"))
    return rows.select("path", "i", F.trim("code").alias("code"), "value").filter("value is not null")


def pairs_of(files: DataFrame) -> DataFrame:
    """path, i, code, value of files (path, content)."""
    lines = F.split(F.decode(F.col("content"), "ISO-8859-1"), r"\r\n|\r|\n", -1)
    rows = files.select("path", F.explode(F.array(lines)).alias("l")).select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("l") / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.get("l", 2 * k).alias("code"), F.get("l", 2 * k + 1).alias("value")))).alias("i", "p"))
    return rows.select("path", F.col("i").cast("long").alias("i"), F.trim("p.code").alias("code"), "p.value").filter("value is not null")


def _last(code: str, value: Column | None = None) -> Column:
    return F.max_by(F.col("value") if value is None else value, F.when(F.col("code") == code, F.col("i")))


def _said(code: str) -> Column:
    """The values of a code in their order, as one text."""
    found = F.array_sort(F.collect_list(F.when(F.col("code") == code, F.struct("i", "value"))))
    return F.array_join(F.transform(found, lambda p: p["value"]), "")


def entities(pairs: DataFrame) -> DataFrame:
    """One row per entity: path, ent (its number), kind, scope and owner (the latest marks before it), layer, name, label, closed, x and y of codes 10 to 21, scales and angle, points (its own vertices)."""
    zero, ten = (F.when(F.col("code") == c, F.lit(1).cast("long")) for c in ("0", "10"))
    rows = running(pairs.withColumn("bucket", F.floor(F.col("i") / RANGE)), ["path"], "bucket", ["i"], sums={"ent": zero, "vertex": ten}).filter("ent > 0").drop("bucket")
    rows = materialise(rows)
    number = F.trim("value").try_cast("double")
    one = rows.groupBy("path", "ent").agg(
        F.trim(_last("0")).alias("kind"), F.trim(_last("8")).alias("layer"), F.trim(_last("2")).alias("name"), _said("1").alias("said"), _said("3").alias("more"), _last("70", F.trim("value").try_cast("double")).alias("flags"),
        *[_last(c, number).alias(n) for c, n in (("10", "x"), ("20", "y"), ("11", "u"), ("21", "v"), ("41", "sx"), ("42", "sy"), ("50", "angle"))],
    )
    corner = rows.filter("code in ('10', '20')").groupBy("path", "ent", "vertex").agg(_last("10", number).alias("x"), _last("20", number).alias("y"), F.max(F.col("code") == "10").alias("begun")).filter("begun")
    corner = corner.groupBy("path", "ent").agg(F.array_sort(F.collect_list(F.struct("vertex", "x", "y"))).alias("corners"))
    text = F.when(F.col("kind") == "MTEXT", F.concat("more", "said")).otherwise(F.col("said"))
    closed = F.coalesce(F.col("flags").cast("long").bitwiseAND(1) == 1, F.lit(False))
    one = one.join(corner, ["path", "ent"], "left").select("path", "ent", "kind", "layer", "name", text.alias("label"), closed.alias("closed"), "x", "y", "u", "v", "sx", "sy", "angle", F.transform(F.coalesce("corners", F.array().cast("array<struct<vertex: long, x: double, y: double>>")), lambda c: F.array(c["x"], c["y"])).alias("points"))
    one = one.withColumn("bucket", F.floor(F.col("ent") / RANGE))
    mark = F.struct("ent", "kind", "name")
    return running(one, ["path"], "bucket", ["ent"], latest={"scope": F.when(F.col("kind").isin(SCOPES), mark), "owner": F.when(F.col("kind").isin([*SCOPES, "POLYLINE", "SEQEND"]), mark)}).drop("bucket")


def _finite(p: Column) -> Column:
    return F.forall(p, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))


def _shapes(every: DataFrame) -> DataFrame:
    """path, ent, block (null: the drawing itself), kind, layer, label, closed, points of what is drawn."""
    stands = every.filter("(scope.kind = 'SECTION' and scope.name = 'ENTITIES') or scope.kind = 'BLOCK'")
    own = stands.filter(F.col("kind").isin(DRAWN))
    vertex = stands.filter("kind = 'VERTEX' and owner.kind = 'POLYLINE' and x is not null and y is not null")
    drawn = vertex.groupBy("path", F.col("owner.ent").alias("ent")).agg(F.array_sort(F.collect_list(F.struct(F.col("ent").alias("k"), "x", "y"))).alias("vertices"))
    # A polyline that another one follows before it has ended is lost.
    begins = running(every.filter(F.col("kind").isin([*SCOPES, "POLYLINE", "SEQEND"])).select("path", "ent", "kind").withColumn("bucket", F.floor(F.col("ent") / RANGE)), ["path"], "bucket", ["ent"], sums={"k": F.lit(1).cast("long")})
    lost = begins.filter("kind = 'POLYLINE'").select("path", "ent", "k").join(begins.filter("kind = 'POLYLINE'").select("path", (F.col("k") - 1).alias("k")), ["path", "k"]).select("path", "ent")
    own = own.join(drawn, ["path", "ent"], "left").join(lost, ["path", "ent"], "left_anti")
    x, u = F.coalesce("x", F.lit(0.0)), F.coalesce("u", F.lit(0.0))
    line = F.when(F.col("y").isNotNull() & F.col("v").isNotNull(), F.array(F.array(x, F.col("y")), F.array(u, F.col("v"))))
    many = F.when(F.col("kind") == "LINE", line).when(F.col("kind") == "POLYLINE", F.transform("vertices", lambda p: F.array(p["x"], p["y"]))).otherwise(F.col("points"))
    lines = F.filter(many, _finite)
    first = F.slice("points", 1, 1)
    points = F.when(F.col("kind").isin("TEXT", "MTEXT", "POINT"), F.when(F.forall(first, _finite) & (F.size(first) > 0), first)).otherwise(F.when(F.size(lines) >= 2, lines))
    return own.select("path", "ent", F.when(F.col("scope.kind") == "BLOCK", F.col("scope.ent")).alias("block"), "kind", "layer", "label", "closed", points.alias("points")).filter("points is not null")


def _placed(p: Column) -> Column:
    x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.array(F.col("m00") * x + F.col("m01") * y + F.col("tx"), F.col("m10") * x + F.col("m11") * y + F.col("ty"))


def _layer(own: str, inherited: Column) -> Column:
    return F.when(F.coalesce(own, F.lit("")).isin("", "0"), F.coalesce(inherited, F.lit("0"))).otherwise(F.col(own))


@tidy
def features(pairs: DataFrame) -> DataFrame:
    """path, feature_idx, geom_type, layer, label, points of the drawings' features: texts and points are points, lines lines, closed ones of three points or more polygons. Drawings without a section of entities have none."""
    every = materialise(entities(pairs))
    shapes = materialise(_shapes(every))
    blocks = every.filter("kind = 'BLOCK' and name is not null and name <> ''").groupBy("path", "name").agg(F.max_by(F.struct(F.col("ent").alias("block"), F.coalesce("x", F.lit(0.0)).alias("base_x"), F.coalesce("y", F.lit(0.0)).alias("base_y")), "ent").alias("b")).select("path", "name", "b.*")
    angle = F.radians(F.coalesce("angle", F.lit(0.0)))
    scale = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    turned = {"a": scale("sx") * F.cos(angle), "b": -scale("sy") * F.sin(angle), "c": scale("sx") * F.sin(angle), "d": scale("sy") * F.cos(angle)}
    inserts = every.filter("kind = 'INSERT' and ((scope.kind = 'SECTION' and scope.name = 'ENTITIES') or scope.kind = 'BLOCK')").join(blocks, ["path", "name"]).withColumns(turned)
    inserts = materialise(inserts.select("path", F.when(F.col("scope.kind") == "BLOCK", F.col("scope.ent")).alias("inside"), F.col("ent").alias("at"), F.col("layer").alias("own"), "block", "a", "b", "c", "d", (F.coalesce("x", F.lit(0.0)) - F.col("a") * F.col("base_x") - F.col("b") * F.col("base_y")).alias("e"), (F.coalesce("y", F.lit(0.0)) - F.col("c") * F.col("base_x") - F.col("d") * F.col("base_y")).alias("f")))
    out = shapes.filter("block is null").select("path", F.array("ent").alias("place"), "kind", _layer("layer", F.lit(None)).alias("layer"), "label", "closed", "points")
    held = shapes.filter("block is not null").withColumnRenamed("layer", "own")
    level = inserts.filter("inside is null").select("path", "block", F.array("at").alias("place"), _layer("own", F.lit(None)).alias("layer"), *[F.col(c).alias(n) for c, n in zip("abcdef", PLACEMENT, strict=True)])
    for depth in range(DEEPEST):
        level = materialise(level)
        if level.isEmpty():
            break
        put = level.join(held, ["path", "block"])
        out = out.unionByName(put.select("path", F.concat("place", F.array("ent")).alias("place"), "kind", _layer("own", F.col("layer")).alias("layer"), "label", "closed", F.transform("points", _placed).alias("points")))
        if depth + 1 < DEEPEST:
            deeper = level.withColumnRenamed("block", "inside").join(inserts, ["path", "inside"])
            m00, m01, m10, m11, tx, ty = map(F.col, PLACEMENT)
            a, b, c, d, e, f = map(F.col, "abcdef")
            made = [m00 * a + m01 * c, m00 * b + m01 * d, m10 * a + m11 * c, m10 * b + m11 * d, m00 * e + m01 * f + tx, m10 * e + m11 * f + ty]
            level = deeper.select("path", "block", F.concat("place", F.array("at")).alias("place"), _layer("own", F.col("layer")).alias("layer"), *[v.alias(n) for v, n in zip(made, PLACEMENT, strict=True)])
    polygon = F.col("closed") & (F.size("points") >= 3) & F.col("kind").isin("LWPOLYLINE", "POLYLINE")
    text = F.col("kind").isin("TEXT", "MTEXT")
    geom = F.when(text | (F.col("kind") == "POINT"), "Point").when(polygon, "Polygon").otherwise("LineString")
    label = F.when(text, F.trim(F.replace(F.col("label"), F.lit("\\P"), F.lit("\n")))).otherwise("")
    out = materialise(out.select("path", "place", F.floor(F.get("place", F.lit(0)) / 4096).alias("bucket"), geom.alias("geom_type"), "layer", label.alias("label"), F.when(polygon, F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points")).alias("points")))
    numbered = running(out, ["path"], "bucket", ["place"], sums={"n": F.lit(1).cast("long")})
    return numbered.select("path", (F.col("n") - 1).alias("feature_idx"), "geom_type", "layer", "label", "points")


def dxf_features(files: DataFrame) -> DataFrame:
    """Of files (path, content)."""
    return features(pairs_of(files))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Of the drawings at a path; a large one is read by several tasks."""
    return features(read_pairs(spark, path))
