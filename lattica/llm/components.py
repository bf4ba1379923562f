"""Connected components by contraction, in DataFrame functions; nothing is collected, and a hot vertex is only a hot join key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); component is the smallest id reachable.

    Each round every vertex points at its smallest neighbour if that is smaller, pointers are followed twice doubled,
    and edges are renamed by them. Edges shrink by a multiple each round and stop when none joins two names.
    """
    left = edges.select("a", "b").filter("a <> b")
    labels, spent = None, []
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        parent = written(parent.select("id", F.least("id", "near").alias("parent")), "pointers")
        up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        two = parent.join(up, "parent", "left").select("id", F.coalesce("grand", "parent").alias("parent"))
        again = two.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        four = written(two.join(again, "parent", "left").select("id", F.coalesce("grand", "parent").alias("component")), "pointers")
        new = four if labels is None else written(
            labels.join(four.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select(
                "id", F.coalesce("next", "component").alias("component")
            ),
            "labels",
        )
        renamed = left.join(four.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(
            four.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b"
        )
        left = written(renamed.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).filter("a <> b").distinct(), "edges")
        spent += [x for x in (parent, labels) if x is not None]
        if labels is not None:
            spent.append(four)
        labels = new
        spent.append(left)
        if left.isEmpty():
            for x in spent:
                forget(x)
            return labels
