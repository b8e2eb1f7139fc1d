"""Components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes of the edges.

    In each round a node takes the smallest label of its neighbours, then the label of its label, so labels travel
    twice as far as in the round before. Rounds are written; they end when no label changes. Tables are joined where they
    are, by a merge: a broadcast would pass the labels through the driver in every round.
    """
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        found = cut(step.join(jump.hint("merge"), "to").select("node", "was", F.least("to", "next").alias("component")), "labels")
        labels = found.select("node", "component")
        if found.filter("was <> component").isEmpty():
            return labels
