"""Connected components of a graph that is held in a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise


#: Parts in which the ids of one component meet what becomes of it.
SALT = 32


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b of any one type that can be ordered. Returns id, root for every id in a link; root is the smallest id of its component.

    Every round maps each node to the smallest of itself and its neighbours, and goes on with the links between the nodes mapped to. A node that is not the smallest around it vanishes, so few rounds are needed: a star or a clique is done in one. Nothing is gathered: a round is an aggregation of least neighbours and two joins on node ids, by sorting: its tables grow with the links, so none is sent whole to every task. Links with a null end and links of a node with itself count for nothing; an empty table has no components."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links = materialise(links)
    found = None
    while found is None or not links.isEmpty():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        if found is None:
            found = near.select(F.col("node").alias("id"), F.col("to").alias("root"))
        else:
            found = found.hint("merge").join(near, found["root"] == near["node"], "left").select("id", F.coalesce("to", "root").alias("root"))
            found = materialise(found)
        left = links.hint("merge").join(near.withColumnRenamed("to", "a_to"), F.col("a") == F.col("node")).drop("node")
        left = left.hint("merge").join(near.withColumnRenamed("to", "b_to"), F.col("b") == F.col("node"))
        links = materialise(left.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).filter("a < b").distinct())
    return found


def further(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, root) after more links (a, b): only the links between components are worked on, as links of their roots."""
    for c in ("a", "b"):
        links = links.hint("merge").join(roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    more = connected_components(links)
    # A component may hold a third of all ids: what becomes of it is repeated, so that they learn it in SALT tasks.
    to = more.select(F.col("id").alias("root"), F.col("root").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    old = roots.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).hint("merge").join(to, ["root", "salt"], "left").select("id", F.coalesce("to", "root").alias("root"))
    new = more.hint("merge").join(roots.select("id"), "id", "left_anti")
    return materialise(old.unionByName(new.hint("merge").join(roots.select(F.col("root").alias("id")).distinct(), "id", "left_anti").select("id", "root")))
