"""A batch of corrections applied to a layer, as if one after the other in the order of their ids.

Requests that touch no feature in common do not depend on each other. So each round carries out, all at once, those requests that come first for every feature they touch; their results are the state that the next round reads. There are as many rounds as the longest chain of requests that share features, however many requests there are. Only features that a request touches are read and written, the rest of the layer joins at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import planar
from parcelspark.operators.correction import allowed, with_parts
from parcelspark.operators.lineage import materialise

OVERLAPPING = ["clip_first", "clip_second"]
OUTCOME = "request_id", "corrected", "refused"


def _carried_out(ready: DataFrame, state: DataFrame) -> DataFrame:
    """Requests with the geometry that they give a feature: request_id, changed (the feature), made (null: it is deleted), gone (another one that is), refused."""
    met = ready.join(state.select(F.col("feature_idx"), F.col("parts").alias("a")), "feature_idx", "left").join(state.select(F.col("feature_idx").alias("other_idx"), F.col("parts").alias("b")), "other_idx", "left")
    action = F.col("action")
    clip, merge, assign, cut = action.isin(OVERLAPPING), action == "merge_neighbor", action == "assign_to_neighbor", action == "truncate"
    # The geometry that changes, and the one that changes it.
    other = (action == "clip_second") | merge
    mine, with_ = F.when(other, F.col("b")).otherwise(F.col("a")), F.when(assign, F.col("gap")).when(cut, F.col("boundary")).when(other, F.col("a")).otherwise(F.col("b"))
    how = F.when(clip, "difference").when(merge | assign, "union").when(cut, "intersection")
    made = planar.overlay_each(F.when(how.isNotNull(), mine), F.when(how.isNotNull(), with_), how)
    rows = met.select("request_id", "action", F.when(other, F.col("other_idx")).otherwise(F.col("feature_idx")).alias("changed"), F.when(merge, F.col("feature_idx")).alias("gone"), made.alias("made"), F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"), with_.isNull().alias("none"))
    empty = F.coalesce(F.size("made") == 0, F.lit(True))
    two = F.col("action").isin(*OVERLAPPING, "merge_neighbor")
    refused = F.when(F.col("no_a") | (two & F.col("no_b")), "not found").when(F.col("action").isin("assign_to_neighbor", "truncate") & F.col("none"), "no geometry").when((F.col("action") == "truncate") & empty, "no intersection")
    return rows.select("request_id", "changed", "gone", F.when(~empty & (F.col("action") != "delete"), F.col("made")).alias("made"), refused.alias("refused"))


def apply(layer: DataFrame, requests: DataFrame, boundary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the layer afterwards: feature_idx, parts; outcomes: request_id, corrected, refused).

    requests: request_id, error_type, action, feature_idx, other_idx (the second feature of an overlap, or the neighbour that takes a sliver), gap (the geometry that a feature takes). boundary: the first row by k has the geometry b that features are truncated to. An action that its kind of error does not allow is refused, as is one whose feature is not there any more; what is ignored counts as corrected. A feature of which nothing is left is gone. Ids of requests are to be unique: of those that repeat, one counts."""
    layer = with_parts(layer).select("feature_idx", F.col("parts").cast(planar.PARTS).alias("parts"))
    requests = requests.select("request_id", "error_type", "action", "feature_idx", "other_idx", F.col("gap").cast(planar.PARTS).alias("gap")).dropDuplicates(["request_id"])
    may = F.coalesce(allowed(F.col("error_type"), F.col("action")), F.lit(False))
    outcomes = requests.select("request_id", may.alias("corrected"), F.when(~may, "action not allowed").alias("refused")).filter("refused is not null")
    outcomes = outcomes.unionByName(requests.filter(may & (F.col("action") == "ignore")).select("request_id", F.lit(True).alias("corrected"), F.lit(None).cast("string").alias("refused")))
    pending = requests.filter(may & (F.col("action") != "ignore"))
    if boundary is not None:
        pending = pending.join(F.broadcast(boundary.orderBy("k").limit(1).select(F.col("b").cast(planar.PARTS).alias("boundary"))), how="left")  # one row
    else:
        pending = pending.withColumn("boundary", F.lit(None).cast(planar.PARTS))
    two = F.col("action").isin(*OVERLAPPING, "merge_neighbor")
    pending = materialise(pending.withColumn("touches", F.array_compact(F.array_distinct(F.array("feature_idx", F.when(two, F.col("other_idx")))))))
    touched = pending.select(F.explode("touches").alias("feature_idx")).distinct()
    touched = materialise(touched)
    state = layer.join(touched, "feature_idx", "left_semi")
    while not pending.isEmpty():
        each = pending.select("request_id", F.explode_outer("touches").alias("f"))
        first = each.groupBy("f").agg(F.min("request_id").alias("first"))
        ready = each.join(first, each["f"].eqNullSafe(first["f"])).groupBy("request_id").agg(F.min(F.col("request_id") == F.col("first")).alias("ready")).filter("ready or ready is null").select("request_id")
        ready = materialise(ready)
        done = materialise(_carried_out(pending.join(ready, "request_id", "left_semi"), state))
        outcomes = outcomes.unionByName(done.select("request_id", F.col("refused").isNull().alias("corrected"), "refused"))
        right = done.filter("refused is null")
        changed = right.select(F.col("changed").alias("feature_idx"), F.col("made").alias("parts"))
        moved = changed.select("feature_idx").unionByName(right.filter("gone is not null").select(F.col("gone").alias("feature_idx")))
        state = materialise(state.join(moved, "feature_idx", "left_anti").unionByName(changed.filter("parts is not null")))
        pending = materialise(pending.join(ready, "request_id", "left_anti"))
    return layer.join(touched, "feature_idx", "left_anti").unionByName(state), outcomes
