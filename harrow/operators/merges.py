"""Merging clusters by a sequence of requests, each of which sees what those before it did.

A request (source, target) is refused if both are one, if one of them is unknown or gone by then, or if both together
have more than one application by then. What it decides depends on earlier requests about its two clusters only:

1. requests that no order can change are settled by a join: the source is in no other request and has no application,
   and the target is never a source. So a target of very many such requests is no single task's work;
2. the others fall into components of clusters, whose requests are replayed in order by a function that holds one
   component's clusters, not its requests;
3. accepted requests form trees, as a cluster is a source once; pointer jumping finds every cluster's root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import numbers

from .actions import patched
from .graph import components
from .snapshot import cut


def _replay(schema: pa.Schema):
    """Records sorted by component, kind and place (0: clusters, 1: requests) -> requests with their reasons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, standing = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["component"] != name:
                    name, standing = r["component"], {}
                if r["kind"] == 0:
                    standing[r["target"]] = r["apps"]
                    continue
                source, target, reason = r["source"], r["target"], None
                if source == target:
                    reason = "VALIDATION"
                elif source not in standing or target not in standing:
                    reason = "NOT_FOUND"
                elif standing[source] + standing[target] > 1:
                    reason = "CONFLICT"
                else:
                    standing[target] += standing.pop(source)
                out.append({"source": source, "target": target, "reason": reason})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def decided(clusters: DataFrame, apps: DataFrame, requests: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``source``, ``target``, ``reason`` (null: accepted) of each request."""
    from pyspark.sql.pandas.types import to_arrow_schema

    has = apps.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("apps"))
    known = clusters.select("cluster_id").distinct().join(has, "cluster_id", "left").select("cluster_id", F.coalesce("apps", F.lit(0)).alias("apps"))
    rows = requests.select("source", "target", F.struct(*order).alias("place"))
    unnamed = rows.filter("source is null or target is null").select("source", "target", F.lit("NOT_FOUND").alias("reason"))
    ends = rows.select(F.col("source").alias("cluster_id"), F.lit(1).alias("out")).unionByName(rows.select(F.col("target").alias("cluster_id"), F.lit(0).alias("out")))
    ends = ends.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("ends"), F.max("out").alias("out"))
    side = lambda name: ends.join(known, "cluster_id", "left").select(F.col("cluster_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("ends", "out", "apps")))
    rows = cut(rows.join(side("source"), "source").join(side("target"), "target"), "requests")
    simple = (F.col("source_ends") == 1) & (F.col("source_apps") == 0) & (F.col("target_out") == 0) & F.col("target_apps").isNotNull()
    settled = rows.filter(simple).select("source", "target", F.lit(None).cast("string").alias("reason"))
    left = rows.filter(~F.coalesce(simple, F.lit(False)))
    groups = components(left, "source", "target")
    records = left.join(groups, left["source"] == groups["node"]).select("component", F.lit(1).alias("kind"), "source", "target", F.lit(0).cast("long").alias("apps"), "place")
    states = known.join(groups, F.col("cluster_id") == F.col("node")).select("component", F.lit(0).alias("kind"), F.col("cluster_id").alias("target"), "apps")
    records = states.unionByName(records, allowMissingColumns=True).repartition("component").sortWithinPartitions("component", "kind", "place")
    return cut(settled.unionByName(unnamed).unionByName(records.mapInArrow(_replay(to_arrow_schema(settled.schema)), settled.schema)), "decided")


def roots(moves: DataFrame) -> DataFrame:
    """``cluster_id`` and ``root`` of every source of moves (source, target): each round every pointer jumps over its target."""
    found = cut(moves.select(F.col("source").alias("cluster_id"), F.col("target").alias("root")), "roots")
    while True:
        on = found.select(F.col("cluster_id").alias("root"), F.col("root").alias("next"))
        jumped = cut(found.join(on, "root", "left").select("cluster_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = jumped.select("cluster_id", "root")
        if jumped.filter("moved").isEmpty():
            return found


def merge_clusters(
    jobs: DataFrame, clusters: DataFrame, apps: DataFrame, requests: DataFrame, order: tuple[str, ...] = ("source", "target")
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs, clusters, applications, refused) after requests (source, target), one after the other by ``order``.

    Postings and applications of a merged cluster go to its target, or to where that was merged later. A target keeps
    the furthest state of triage. ``refused`` has source, target and reason. Null clusters are unknown ones.
    """
    rows = decided(clusters, apps, requests, order)
    to = roots(rows.filter("reason is null"))
    moves = to.withColumnRenamed("root", "_to")
    moved = lambda table: table.join(moves, "cluster_id", "left").select(
        *[F.coalesce("_to", "cluster_id").alias("cluster_id") if c == "cluster_id" else F.col(f"`{c}`") for c in table.columns]
    )
    ranks = clusters.select("cluster_id", numbers.triage_rank(F.col("triage")).alias("rank"))
    of_root = to.join(ranks, "cluster_id").select("root", "rank").unionByName(ranks.join(to.select("root").distinct(), F.col("cluster_id") == F.col("root")).select("root", "rank"))
    triage = of_root.groupBy(F.col("root").alias("cluster_id")).agg(numbers.triage_of_rank(F.max("rank")).alias("triage"))
    left = clusters.join(moves, "cluster_id", "left_anti")
    return moved(jobs), patched(left, triage, "cluster_id"), moved(apps), rows.filter("reason is not null")
