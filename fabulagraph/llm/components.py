"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulagraph.operators.lineage import Tables


def components(links: DataFrame) -> DataFrame:
    """(node, label): the same label for nodes that ``links`` (a, b) connect.

    Each round points every node at its least neighbour, follows pointers twice, and
    replaces the ends of links by what they point at; links inside one node vanish, so
    the table at least halves in nodes.  Tables are written and read again by the round.  Nulls make no link.  All of it stays
    distributed; an empty table has no components.
    """
    c = F.col
    t = Tables(links.sparkSession)
    rest = t.write("rest", links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not rest.isEmpty():
        both = rest.select("a", "b").unionByName(rest.select(c("b").alias("a"), c("a").alias("b")))
        parent = both.groupBy(c("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        parent = t.write("parent", parent)
        for _ in range(2):
            over = parent.select(c("node").alias("up"), c("up").alias("next"))
            parent = parent.join(over, "up").select("node", c("next").alias("up"))
        parent = t.write("parent", parent)
        if labels is None:
            labels = parent.select("node", c("up").alias("label"))
        else:
            over = parent.select(c("node").alias("label"), "up")
            labels = labels.join(over, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = t.write("labels", labels)
        for end in ("a", "b"):
            over = parent.select(c("node").alias(end), c("up").alias(f"{end}_up"))
            rest = rest.join(over, end).withColumn(end, c(f"{end}_up")).drop(f"{end}_up")
        rest = t.write("rest", rest.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if labels is None:
        labels = rest.select(c("a").alias("node"), c("b").alias("label"))
    return labels
