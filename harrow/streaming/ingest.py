"""One ingestion step, its bookkeeping, and the stream that runs it for every batch of new payload files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import times
from harrow.operators import assign, rules
from harrow.operators.snapshot import cut
from harrow.sources.registry import clamped_interval

from .table import BucketTable

KEY = ["source_id", "external_id"]
#: Columns by which a posting is identified again: where they change, so may its cluster.
IDENTITY = ("title_norm", "company_name")


@dataclass(frozen=True)
class Step:
    """The next snapshot of postings, each posting's change, and the clusters to be refreshed."""

    jobs: DataFrame
    changes: DataFrame
    refresh: DataFrame


def first_of_each(items: DataFrame, order: str) -> DataFrame:
    """The first item of each posting in a fetch; overlapping windows repeat some."""
    rest = [c for c in items.columns if c not in KEY]
    return items.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("v")).select(*KEY, "v.*")


def step(old: DataFrame, fetched: DataFrame, as_of: Column, complete: bool, days: int = 30, clusters: DataFrame | None = None) -> Step:
    """The snapshot after a fetch of all sources of ``old``.

    ``fetched`` has one row per posting, judged, with the columns of ``old`` but ``cluster_id``, ``first_seen``,
    ``last_seen`` and ``closed_at``. New, changed and reopened postings are written over; unchanged ones are only seen
    again, so a change outside the content hash does not reach them. Postings that a complete listing lacks are closed,
    or that no listing had for ``days`` days. A posting keeps its cluster unless it is new or its title or company changed.
    The same fetch again changes nothing but ``last_seen``. ``clusters`` are those that new postings may join, if there
    are others than those of ``old``.
    """
    names = [c for c in old.columns if c not in (*KEY, "cluster_id", "first_seen", "last_seen", "closed_at")]
    was = old.select(*KEY, F.struct(*[c for c in old.columns if c not in KEY]).alias("was"))
    now = fetched.select(*KEY, F.struct(*names).alias("now"))
    both = was.join(now, KEY, "full_outer")
    change = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), "missing")
        .when(F.col("was.closed_at").isNotNull(), "reopened")
        .when(F.col("was.content_hash") != F.col("now.content_hash"), "changed")
        .otherwise("unchanged")
    )
    both = both.withColumn("change", change)
    unseen = (F.col("change") == "missing") & F.col("was.closed_at").isNull()
    if not complete:
        unseen = unseen & (F.col("was.last_seen") < as_of - F.make_dt_interval(F.lit(days)))
    written = F.col("change").isin("new", "changed", "reopened")
    moved = F.lit(False)
    for c in IDENTITY:
        moved = moved | ~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}"))
    both = both.withColumns({"closing": unseen, "moved": (F.col("change") == "new") | (written & moved)})
    merged = both.select(
        *KEY,
        *[F.when(written, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in names],
        F.when(~F.col("moved"), F.col("was.cluster_id")).alias("cluster_id"),
        F.coalesce("was.first_seen", as_of).alias("first_seen"),
        F.when(F.col("now").isNotNull(), as_of).otherwise(F.col("was.last_seen")).alias("last_seen"),
        F.when(F.col("closing"), as_of).when(F.col("now").isNull(), F.col("was.closed_at")).alias("closed_at"),
        F.col("was.cluster_id").alias("_before"),
        "change",
        "closing",
        "moved",
    )
    rows = cut(merged, "merged")
    # a posting that is identified again still stands in its old cluster, which so has its source already
    places = assign.assign(rows.filter("moved"), assign.cluster_table(old) if clusters is None else clusters, as_of)
    placed = rows.join(places.select(*KEY, F.col("cluster_id").alias("_place")), KEY, "left").withColumn("cluster_id", F.coalesce("cluster_id", "_place"))
    placed = cut(placed, "placed")
    touched = placed.filter("moved or closing or change in ('changed', 'reopened')")
    refresh = touched.select(F.explode(F.array_compact(F.array("cluster_id", "_before"))).alias("cluster_id")).distinct()
    return Step(placed.select(*old.columns), placed.select(*KEY, "change", "closing", "moved"), refresh)


def succeeded(sources: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Sources after runs (source_id, failed_items): no failures, due after their interval; ``partial`` if an item failed."""
    done = runs.select("source_id", F.when(F.col("failed_items") > 0, "partial").otherwise("ok").alias("_status"))
    rows = sources.join(done, "source_id", "left")
    ran = F.col("_status").isNotNull()
    wait = F.make_dt_interval(F.lit(0), F.lit(0), clamped_interval(F.col("kind"), F.col("interval_minutes")))
    changes = {
        "failures": F.when(ran, 0).otherwise(F.col("failures")),
        "next_run": F.when(ran, as_of + wait).otherwise(F.col("next_run")),
        "last_status": F.col("_status"),
    }
    return rows.withColumns(changes).drop("_status")


def failed(sources: DataFrame, runs: DataFrame, as_of: Column, boards: Column) -> DataFrame:
    """Sources after failed runs (source_id, status_code, error, aborted): the next run waits longer with each failure.

    An aborted run does not count. A board (``boards``: a condition) that is gone (404) is disabled. Errors are cut to 500.
    """
    bad = runs.select("source_id", F.struct("status_code", "error", "aborted").alias("_run"))
    rows = sources.join(bad, "source_id", "left")
    ran = F.col("_run").isNotNull()
    failures = F.col("failures") + F.when(ran & ~F.col("_run.aborted"), 1).otherwise(0)
    rows = rows.withColumn("failures", failures)
    delay = times.source_backoff(F.col("interval_minutes"), F.col("failures")).cast("int")
    gone = ran & (F.col("_run.status_code") == 404) & boards
    changes = {
        "next_run": F.when(ran, as_of + F.make_dt_interval(F.lit(0), F.lit(0), delay)).otherwise(F.col("next_run")),
        "enabled": F.col("enabled") & ~F.coalesce(gone, F.lit(False)),
        "last_error": F.when(ran, F.left(F.col("_run.error"), F.lit(500))),
    }
    return rows.withColumns(changes).drop("_run")


def advance(cursors: DataFrame, windows: DataFrame, as_of: Column, overlap_days: int = 1, initial_days: int = 14) -> DataFrame:
    """Per source the window to fetch (``since``) and the cursor after it: moved only by a complete fetch.

    ``windows`` has source_id and complete; ``cursors`` source_id and last_creation.
    """
    rows = windows.join(cursors, "source_id", "left")
    since = F.coalesce(F.col("last_creation") - F.make_dt_interval(F.lit(overlap_days)), times.days_before(as_of, initial_days))
    return rows.select("source_id", since.alias("since"), F.when(F.col("complete"), as_of).otherwise(F.coalesce("last_creation", since)).alias("last_creation"))


def stale(jobs: DataFrame, criteria: rules.Criteria) -> Column:
    """Is a posting to be judged again? Open, with a description and, where verdicts are stamped, with another stamp."""
    again = F.col("closed_at").isNull() & (F.coalesce("description", F.lit("")) != "")
    return again & ~F.col("criteria_stamp").eqNullSafe(F.lit(criteria.stamp)) if "criteria_stamp" in jobs.columns else again


def refilter(jobs: DataFrame, criteria: rules.Criteria) -> tuple[DataFrame, DataFrame]:
    """(jobs, clusters to refresh): the rules again over postings that are ``stale``; all their clusters are refreshed.

    With a column ``criteria_stamp`` a posting is judged once by each version of the criteria.
    """
    again = stale(jobs, criteria)
    base = jobs.drop("reasons", "flags", "rule_score", "matched", "status")
    new = rules.evaluate(base.filter(again), criteria, advisory=(F.col("source_kind") == "capture") | F.col("forced_pass"))
    if "criteria_stamp" in jobs.columns:
        new = new.withColumn("criteria_stamp", F.lit(criteria.stamp))
    return new.select(*jobs.columns).unionByName(jobs.filter(~again)), jobs.filter(again).select("cluster_id").distinct()


def run_stream(
    spark: SparkSession, folder: str, schema: str, checkpoint: str, read: Callable[[DataFrame], DataFrame], jobs: BucketTable, as_of: Callable[[], Column], complete: bool,
    criteria: Callable[[], rules.Criteria] | None = None,
) -> None:
    """Runs ``step`` for every batch of payload files that are new in ``folder``, then stops.

    ``jobs`` is in buckets by source. A batch reads and writes the buckets of its sources; of the others it reads what
    clusters need. Only postings of its sources can be closed. A batch that is replayed after a failure finds its version
    published and leaves it. With ``criteria``, asked for at each batch, stored postings with another stamp are judged
    again in the same version; buckets without such ones are left.
    """

    def batch(payloads: DataFrame, number: int) -> None:
        if jobs.has(number):
            return
        # the position of an item in its fetch decides between repeats
        fetched = cut(first_of_each(read(payloads), "at"), "fetched")
        listed = payloads.select("source_id").filter("source_id is not null").distinct()
        wanted = criteria() if criteria else None
        touched = set(jobs.touched(listed))
        if wanted:
            touched |= set(jobs.touched(jobs.read().filter(stale(jobs.read(), wanted))))
        old = jobs.read(only=sorted(touched))
        own, rest = (old.join(listed, "source_id", how).select(*old.columns) for how in ("left_semi", "left_anti"))
        done = step(own, fetched, as_of(), complete, clusters=assign.cluster_table(jobs.read()))
        rows = done.jobs.unionByName(rest)
        jobs.commit(number, refilter(rows, wanted)[0] if wanted else rows, touched)
        jobs.vacuum()

    stream = spark.readStream.schema(schema).json(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def refreshed(jobs: DataFrame, refresh: DataFrame, rank: Column) -> DataFrame:
    """Canonical posting, dates and states of the clusters to be refreshed, from all their members. Clusters without members are gone."""
    rows = jobs.join(refresh, "cluster_id", "left_semi").withColumn("rank", rank)
    order = F.struct("rank", "first_seen", "source_id", "external_id")
    return rows.groupBy("cluster_id").agg(
        F.min_by("external_id", order).alias("canonical_id"), F.count(F.lit(1)).alias("members"), F.max("last_seen").alias("last_seen"),
        F.bool_or(F.col("status") == "passed").alias("any_passed"), F.bool_and(F.col("closed_at").isNotNull()).alias("all_closed"),
    )
