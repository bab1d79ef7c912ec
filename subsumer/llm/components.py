"""Connected components of a distributed edge list by alternating large and small stars.

Every round is a few joins and aggregations; hubs are handled by minima (which combine on the map
side), never by collecting a node's neighbours.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs, in any direction and number -> (node, root): the least node of its component.

    Nodes that have no edge to another node don't appear.  Edges with a null are ignored.
    """
    now = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        old, now, before = now, stage(small, "edges"), state
        discard(old)
        state = _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
