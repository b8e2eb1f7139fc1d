"""Which open clusters a cluster may be merged with, by the similarity of titles.

Clusters of a known company are offered all others of it, the most similar first; one without is offered whatever is
similar enough. Work is done for titles, not for clusters: of one title only the first ids can be among the best, and
only the best few titles of each pair of parts leave a task, so no step holds or writes all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.functions import keys

from .similar import nearest
from .snapshot import cut

MOST = 20


def _first(rows: DataFrame, most: int, by: list[str], *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def merge_candidates(clusters: DataFrame, most: int = MOST) -> DataFrame:
    """``cluster_id``, ``other_id``, ``sim``, ``n``: the best ``most`` open others of each cluster; ties go to the smaller id.

    ``clusters`` has cluster_id, company_norm, title_norm and open. Clusters without company need a similarity above
    that for suggesting; the others take any, down to 0. A title without letters or digits is similar to nothing.
    """
    rows = cut(clusters.select("cluster_id", F.coalesce("company_norm", F.lit("")).alias("block"), F.coalesce("title_norm", F.lit("")).alias("title"), "open"), "clusters")
    own = F.col("block") != ""
    # the probe itself may be among the first, so one more
    targets = cut(_first(rows.filter("open"), most + 1, ["block", "title"], "cluster_id").select("block", "title", "cluster_id"), "targets")
    anywhere = _first(targets, most + 1, ["title"], "cluster_id").select(F.lit("").alias("block"), "title", "cluster_id")

    # of the titles before a title in (similarity, smallest id) each has a cluster before its own, so the best titles have the best clusters
    known = targets.filter(own).unionByName(anywhere)
    ids = known.withColumn("to", F.min("cluster_id").over(Window.partitionBy("block", "title"))).select("block", "to", F.col("cluster_id").alias("other_id"))
    near = nearest(rows, known, "block", "title", "cluster_id", most + 1).filter(own | (F.col("sim") > keys.SUGGESTING))
    offered = cut(_first(near.join(ids, ["block", "to"]), most + 1, ["block", "title"], F.col("sim").desc(), "other_id").drop("to"), "offered")
    mine = rows.select("cluster_id", "block", "title").join(offered, ["block", "title"]).filter("cluster_id <> other_id")
    order = Window.partitionBy("cluster_id").orderBy(F.col("sim").desc(), "other_id")
    return mine.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("cluster_id", "other_id", "sim", F.col("n").cast("long").alias("n"))
