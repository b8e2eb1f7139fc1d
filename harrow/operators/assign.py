"""Which cluster a new posting belongs to: one with its key, one with a similar title, or a new one, in order of arrival.

A posting joins the open cluster with its key that was last joined or seen; else, of the five clusters of its company with
the most similar titles that hold no posting of its source, the first with equal qualifiers; else it starts a cluster. So
its place depends on postings that came before it, but only on those whose keys are linked to its own by similar titles:

1. a similarity join links the keys of the batch that no open cluster has with those of open clusters and of the batch;
2. keys without links are settled by joins: the first posting starts the cluster, the others follow it;
3. linked keys fall into components, which do not depend on each other. Within one, postings are replayed in order, a
   component after the other in each partition, by a function that holds the clusters of one component and no postings;
4. of one key and source only as many postings are replayed as there are clusters that they could join one by one, and
   one more: by then the key has a cluster, which the rest join. So a popular key costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.functions import keys, times

from .graph import components
from .similar import similar_pairs
from .snapshot import cut

#: Similar clusters of which the first with equal qualifiers is taken.
CANDIDATES = 5
KEY = ["external_id", "source_id"]


def cluster_table(jobs: DataFrame) -> DataFrame:
    """One row per cluster of placed postings: key, company, title, last_seen, open, sources."""
    company = [F.min("company_id").alias("company_id")] if "company_id" in jobs.columns else []
    return jobs.filter("cluster_id is not null").groupBy("cluster_id").agg(
        F.min("dedup_key").alias("dedup_key"), F.min("company_norm").alias("company_norm"), F.min("title_norm").alias("title_norm"), *company,
        F.max("last_seen").alias("last_seen"), F.bool_or(F.col("closed_at").isNull()).alias("open"), F.collect_set("source_id").alias("sources"),
    )


def _links(probes: DataFrame, targets: DataFrame, blocks: tuple[str, ...]) -> DataFrame:
    """``node``, ``to`` (a node of ``targets``), ``sim``, ``same`` (qualifiers): similar titles with one of ``blocks`` in common."""
    found = []
    for block in blocks:
        named = lambda rows, block=block: rows.filter(F.coalesce(F.col(block).cast("string"), F.lit("")) != "")
        own, other = named(probes), named(targets)
        titles = similar_pairs(own, other, block, "title_norm", keys.GROUPING)
        pairs = own.select(block, F.col("title_norm").alias("a"), "node").join(titles, [block, "a"])
        pairs = pairs.join(other.select(block, F.col("title_norm").alias("b"), F.col("node").alias("to")), [block, "b"])
        found.append(pairs.select("node", "to", "sim", (keys.title_qualifiers(F.col("a")) == keys.title_qualifiers(F.col("b"))).alias("same")))
    return reduce(DataFrame.unionByName, found).distinct()


class _Component:
    """The clusters of a component while its postings are replayed."""

    def __init__(self) -> None:
        self.clock = 0
        self.held: dict[str, dict] = {}  # key -> cluster -> when it was last joined
        self.home: dict[object, str] = {}  # cluster -> key
        self.sources: dict[object, set] = {}
        self.standing: dict[str, list] = {}  # node -> clusters
        self.links: dict[str, list] = {}

    def stand(self, cluster: object, key: str, node: str, sources: list) -> None:
        self.clock += 1
        self.held.setdefault(key, {})[cluster] = self.clock
        self.home[cluster], self.sources[cluster] = key, set(sources)
        self.standing.setdefault(node, []).append(cluster)

    def place(self, r: dict) -> tuple[object, str]:
        """The cluster of a posting and how it was found."""
        if own := self.held.get(r["dedup_key"]):
            cluster, way = max(own, key=own.get), "exact"
        else:
            near = {c: (-sim, c, same) for to, sim, same in self.links.get(r["node"], ()) for c in self.standing.get(to, ()) if r["source_id"] not in self.sources[c]}
            cluster, way = next((c for _, c, same in sorted(near.values())[:CANDIDATES] if same), None), "similar"
            if cluster is None:
                cluster, way = r["external_id"], "new"
                self.stand(cluster, r["dedup_key"], r["node"], [])
        self.clock += 1
        self.held[self.home[cluster]][cluster] = self.clock
        self.sources[cluster].add(r["source_id"])
        return cluster, way


def _replay(schema: pa.Schema):
    """Records sorted by component, kind and place -> the places of their postings.

    Kind 0 are clusters, the least recently seen first; 1 the links of a node; 2 postings in order of arrival.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, _Component()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["component"] != name:
                    name, state = r["component"], _Component()
                if r["kind"] == 0:
                    state.stand(r["cluster_id"], r["dedup_key"], r["node"], r["sources"])
                elif r["kind"] == 1:
                    state.links.setdefault(r["node"], []).append((r["to"], r["sim"], r["same"]))
                else:
                    cluster, way = state.place(r)
                    out.append({"external_id": r["external_id"], "source_id": r["source_id"], "dedup_key": r["dedup_key"], "cluster_id": cluster, "way": way})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _linked(marked: DataFrame, fresh: DataFrame, blocks: tuple[str, ...]) -> DataFrame:
    """Places of the postings of linked keys, of each as many as it takes until their key has a cluster."""
    from pyspark.sql.pandas.types import to_arrow_schema

    free = marked.filter("latest is null")
    names = ["node", "dedup_key", "company_id", "company_norm", "title_norm"]
    probes = cut(free.select(*names).distinct(), "names")
    standing = fresh.select(*names).distinct()
    links = _links(probes.filter("coalesce(company_norm, '') <> ''"), probes.unionByName(standing), blocks)
    key_of = lambda node: F.split_part(F.col(node), F.lit("\x01"), F.lit(1))
    links = cut(links.withColumns({"key": key_of("node"), "to_key": key_of("to")}).filter("key <> to_key"), "links")
    groups = components(links, "key", "to_key").select(F.col("node").alias("dedup_key"), "component")
    # what a node's postings could join one by one: clusters that stand, and one for each key of the batch
    could = fresh.select("node").unionByName(probes.select("node")).groupBy(F.col("node").alias("to")).agg(F.count(F.lit(1)).alias("could"))
    limits = links.join(could, "to").groupBy("node").agg((F.sum("could") + 1).alias("limit"))
    rows = marked.join(groups, "dedup_key").join(limits, "node", "left")
    one = F.when(F.col("latest").isNull(), F.coalesce("limit", F.lit(1))).when(F.col("standing") == 1, 1)
    rows = rows.withColumn("limit", one)
    most = limits.agg(F.max("limit")).first()[0] or 1
    order = Window.partitionBy("node", "source_id").orderBy("place")
    # the number bounds what each task hands on of a group, before the groups meet
    few = rows.filter("limit is not null").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= int(most)).filter("nth <= limit")
    postings = few.drop("nth").unionByName(rows.filter("limit is null"))
    records = postings.select("component", F.lit(2).alias("kind"), "dedup_key", "node", "external_id", "source_id", "place")
    clusters = fresh.join(groups, "dedup_key").select("component", F.lit(0).alias("kind"), "dedup_key", "node", "cluster_id", "sources", "last_seen")
    edges = links.join(groups.withColumnRenamed("dedup_key", "key"), "key").select("component", F.lit(1).alias("kind"), "node", "to", "sim", "same")
    records = clusters.unionByName(edges, allowMissingColumns=True).unionByName(records, allowMissingColumns=True)
    records = records.repartition("component").sortWithinPartitions("component", "kind", "last_seen", "cluster_id", "place")
    out = marked.select(*KEY, "dedup_key", F.col("latest").alias("cluster_id"), F.lit("").alias("way")).schema
    return cut(records.mapInArrow(_replay(to_arrow_schema(out)), out), "replayed")


def assign(new: DataFrame, clusters: DataFrame, as_of: Column, arrival: tuple[str, ...] = ("external_id", "source_id")) -> DataFrame:
    """``external_id``, ``source_id``, ``cluster_id``, ``way`` (exact, similar or new), ``previous_id`` of new postings.

    Postings arrive in the order of the columns ``arrival``. Clusters take postings while they are open and were seen
    within the horizon; what joins one makes it the last seen. A cluster takes any posting of its key, and by similarity
    one posting of each source. A new cluster has the id of its first posting; the latest cluster with that key, in
    whatever state, is the one before. Of clusters seen at one time the larger id is the later; of equally similar
    ones the smaller id comes first. Postings without a company's name start clusters of their own, which others may join
    by ``company_id``; that column of postings and clusters may be missing.
    """
    company = lambda rows: rows if "company_id" in rows.columns else rows.withColumn("company_id", F.lit(None).cast("long"))
    node = F.concat_ws("\x01", "dedup_key", "company_id").alias("node")
    clusters = cut(company(clusters).select("*", node), "clusters")
    fresh = clusters.filter(F.col("open") & (F.col("last_seen") > times.days_before(as_of, keys.HORIZON_DAYS)))
    newest = F.max_by("cluster_id", F.struct("last_seen", "cluster_id"))
    held = fresh.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("standing"), newest.alias("latest"))
    own = F.when(F.coalesce("company_norm", F.lit("")) != "", F.col("dedup_key"))
    rows = company(new).withColumn("dedup_key", F.coalesce(own, keys.anonymous_key(F.col("source_id"), F.col("external_id"))))
    rows = rows.select(*KEY, "dedup_key", "company_id", "company_norm", "title_norm", node, F.struct(*arrival).alias("place"))
    marked = cut(rows.join(held, "dedup_key", "left"), "new")
    blocks = ("company_norm", "company_id") if "company_id" in new.columns else ("company_norm",)
    replayed = _linked(marked, fresh, blocks)
    left = marked.join(replayed.select(*KEY), KEY, "left_anti")
    of_held = left.filter("latest is not null").select(*KEY, F.col("latest").alias("cluster_id"), F.lit("exact").alias("way"), "dedup_key")
    alone = left.filter("latest is null")
    begun = replayed.filter("way = 'new'").select("dedup_key", F.col("cluster_id").alias("_to"), F.lit(None).cast(marked.schema["source_id"].dataType).alias("_by"))
    first = alone.join(begun.select("dedup_key"), "dedup_key", "left_anti").groupBy("dedup_key").agg(F.min_by(F.struct(*KEY), "place").alias("f"))
    starts = begun.unionByName(first.select("dedup_key", F.col("f.external_id").alias("_to"), F.col("f.source_id").alias("_by")))
    starter = F.col("external_id").eqNullSafe(F.col("_to")) & F.col("source_id").eqNullSafe(F.col("_by"))
    followers = alone.join(starts, "dedup_key").select(*KEY, F.col("_to").alias("cluster_id"), F.when(starter, "new").otherwise("exact").alias("way"), "dedup_key")
    found = replayed.select(*KEY, "cluster_id", "way", "dedup_key").unionByName(of_held).unionByName(followers)
    before = clusters.groupBy("dedup_key").agg(newest.alias("previous_id")).withColumn("way", F.lit("new"))
    return found.join(before, ["dedup_key", "way"], "left").select(*KEY, "cluster_id", "way", "previous_id")
