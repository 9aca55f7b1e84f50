"""What meets on the way to pairs of a layer."""

from pyspark.sql import functions as F

from parcelspark.operators import correction, quality, spatial


def _layer(spark):
    """100 boxes side by side in ten rows, of which 0 and 1 overlap."""
    x, y = (F.col("id") % 10).cast("double") * 10, F.floor(F.col("id") / 10).cast("double") * 10
    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("feature_idx"), x.alias("x0"), y.alias("y0"), (x + F.when(F.col("id") == 0, 12.0).otherwise(10.0)).alias("x1"), (y + 10).alias("y1"))
    return correction.with_parts(rows)


def _met(monkeypatch, module):
    met = []

    def join(*args, **kwargs):
        met.append(spatial.box_join(*args, **kwargs))
        return met[-1]

    monkeypatch.setattr(module, "box_join", join)
    return met


def test_shared_areas_are_measured_once_for_each_pair(spark, monkeypatch):
    met = _met(monkeypatch, correction)
    got = correction.overlap_partners(_layer(spark)).collect()
    assert {tuple(r) for r in got} == {(0, 1, 20.0), (1, 0, 20.0)}
    assert [m.count() for m in met] == [1]


def test_boxes_that_only_touch_are_no_overlaps(spark, monkeypatch):
    met = _met(monkeypatch, quality)
    assert [tuple(r) for r in quality.partial_overlaps(_layer(spark)).collect()] == [(0, 1)]
    assert [m.count() for m in met] == [1]


def test_boxes_that_touch_intersect_without_their_geometries(spark, monkeypatch):
    met = _met(monkeypatch, quality)
    layer = _layer(spark)
    # A triangle whose box meets that of 12, but not 12 itself, and one that touches 0 in a corner.
    far = spark.sql("SELECT 100L feature_idx, 25D x0, 15D y0, 45D x1, 45D y1, array(array(array(array(45D, 15D), array(45D, 45D), array(25D, 45D), array(45D, 15D)))) parts UNION ALL SELECT 101L, -9D, -9D, 0D, 0D, array(array(array(array(-9D, -9D), array(0D, 0D), array(-9D, 0D), array(-9D, -9D))))")
    both = layer.filter("feature_idx in (0, 1, 2, 12)").unionByName(far)
    got = {(r["l_feature_idx"], r["r_feature_idx"]) for r in quality.intersecting(both, both, self_join_on="feature_idx").collect()}
    assert got == {(0, 1), (1, 2), (1, 12), (2, 12), (0, 101)}
    assert met[0].filter("l_feature_idx < 100 and (l_parts is not null)").count() == 0
