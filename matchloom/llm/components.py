"""Connected components of a table of links, by contraction in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node that its links reach; for each node of `links` (a, b).

    In each round every node joins its least neighbour if that is less, and the links are drawn anew
    between the joined nodes; at least half of the nodes with links go, so rounds grow with the
    logarithm of the longest path.  Each round is written to the shared folder.
    """
    links = checkpointed(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
        parent = checkpointed(parent, "parents")
        if labels is None:
            labels = parent
        else:
            step = parent.toDF("label", "_next")
            labels = checkpointed(labels.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label")), "labels")
        a = parent.toDF("a", "_a")
        b = parent.toDF("b", "_b")
        joined = links.join(a, "a").join(b, "b").where("_a <> _b")
        links = checkpointed(joined.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
