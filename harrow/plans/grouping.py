"""Keys, duplicate groups, similarity joins and the state of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.functions import keys, numbers, times
from harrow.operators import companies, similar, state
from harrow.session import table

from . import derive
from .read_models import as_of, canonical, day, members, scored


def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the items that share an external id, here the text's hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("external_id"))
    first = Window.partitionBy("external_id").orderBy("doc_id")
    return docs.withColumn("n", F.row_number().over(first)).filter("n = 1").select("doc_id", "external_id")


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.jobs(spark, sf_dir).select("external_id", "content_hash", keys.title_qualifiers(F.col("title_norm")).alias("qualifiers"))


def hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.jobs(spark, sf_dir).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("external_id").alias("first_id"))
    return rows.filter("n > 1")


def exact_key_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each posting the newest other open one with its key, whatever its source, seen within the horizon."""
    rows = derive.jobs(spark, sf_dir).select("external_id", "source_id", "dedup_key", "last_seen", "closed_at")
    fresh = rows.filter(F.col("closed_at").isNull() & (F.col("last_seen") > times.days_before(as_of(), keys.HORIZON_DAYS)))
    fresh = fresh.select("dedup_key", F.struct("last_seen", "external_id").alias("seen"))
    # the newest two are enough, so a hot key is joined with one row
    newest = fresh.groupBy("dedup_key").agg(F.max("seen").alias("one"))
    second = fresh.join(newest, "dedup_key").filter("seen < one").groupBy("dedup_key").agg(F.max("seen").alias("two"))
    found = rows.join(newest, "dedup_key").join(second, "dedup_key", "left")
    best = F.when(F.col("one.external_id") != F.col("external_id"), F.col("one.external_id")).otherwise(F.col("two.external_id"))
    return found.select("external_id", best.alias("match_id")).filter("match_id is not null")


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of one company that are similar and agree in their qualifiers."""
    rows = derive.jobs(spark, sf_dir).filter("company_norm is not null and company_norm != '' and closed_at is null")
    pairs = similar.similar_pairs(rows, None, "company_norm", "title_norm", keys.GROUPING)
    same = keys.title_qualifiers(F.col("a")) == keys.title_qualifiers(F.col("b"))
    return pairs.filter(same).select("company_norm", "a", "b", F.round("sim", 6).alias("sim"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar five names for each part name, of those above the suggesting threshold."""
    names = table(spark, sf_dir, "part").select(F.lit("part").alias("block"), F.col("p_name").alias("name")).distinct()
    pairs = similar.similar_pairs(names, names, "block", "name", keys.SUGGESTING).filter("a <> b")
    return similar.top(pairs, 5).select(F.col("a").alias("name"), F.col("b").alias("other"), F.round("sim", 6).alias("sim"), F.col("n").cast("long").alias("n"))


def canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(members(spark, sf_dir)).select("cluster_id", "external_id", "source_kind", F.col("rank").cast("int").alias("rank"))


def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cluster: dates, company, states of triage and scoring, from its members and canonical posting."""
    rows = members(spark, sf_dir)
    named = F.when(F.col("company_name").isNotNull(), F.struct("rank", "external_id", "company_name"))
    per = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("members"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.bool_or(F.col("status") == "passed").alias("any_passed"), F.bool_and(F.col("closed_at").isNotNull()).alias("all_closed"),
        F.bool_and(F.col("status") == "rejected").alias("all_rejected"), F.min(named)["company_name"].alias("any_company"),
    )
    head = scored(spark, sf_dir, canonical(rows)).select("cluster_id", F.col("external_id").alias("canonical_id"), "company_name", "score", "score_state", "attempts")
    status = (
        F.when(~F.col("any_passed"), "not_needed")
        .when(F.col("score_state") == "ok", "done")
        .when((F.col("score_state") == "failed") & (F.col("attempts") >= 2), "failed")
        .otherwise("pending")
    )
    return per.join(head, "cluster_id").select(
        "cluster_id", "canonical_id", "members", day("first_seen").alias("first_seen"), day("last_seen").alias("last_seen"),
        "all_closed", "all_rejected", F.coalesce("company_name", "any_company").alias("company"), status.alias("score_status"),
        F.when(status == "done", F.col("score")).cast("double").alias("best_score"),
    )


def republished_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the latest earlier one of their key, and whether they start a new, linked cluster after the horizon."""
    order = Window.partitionBy("dedup_key").orderBy("first_seen", "external_id")
    rows = derive.jobs(spark, sf_dir).select("external_id", "dedup_key", "first_seen", "last_seen")
    rows = rows.withColumns({"previous_id": F.lag("external_id").over(order), "_seen": F.lag("last_seen").over(order)})
    gap = F.date_diff("first_seen", "_seen")
    return rows.filter("previous_id is not null").select("external_id", "previous_id", gap.alias("gap_days"), (gap > keys.HORIZON_DAYS).alias("new_cluster"))


def company_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers found among companies by their number, else by domain, else by name."""
    s = F.col("s_suppkey")
    probe = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(s % 3 == 0, F.lpad((s * 31 * 7919 % 1_000_000_000).cast("string"), 9, "0")).alias("siren"),
        F.when(s % 3 <= 1, F.concat(F.lit("c"), (s * 17).cast("string"), F.lit(".example.com"))).alias("domain"),
        F.concat(F.lit("customer#"), F.lpad((s * 3 % 997).cast("string"), 9, "0")).alias("name_norm"),
    )
    rows = companies.find(probe, derive.companies(spark, sf_dir))
    return rows.select("s_suppkey", F.col("found.company_id").cast("double").alias("company_id"), F.col("found.name").alias("name"), "way")


def triage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging all clusters of a company keeps the furthest triage state and moves the members."""
    rows = derive.clusters(derive.jobs(spark, sf_dir)).filter("company_norm is not null and company_norm != ''")
    per = rows.groupBy("company_norm").agg(
        F.min("cluster_id").alias("target"), F.count_distinct("cluster_id").alias("merged"), F.max(numbers.triage_rank(F.col("triage"))).alias("rank"), F.count(F.lit(1)).alias("postings")
    )
    return per.select("company_norm", "target", "merged", numbers.triage_of_rank(F.col("rank")).alias("triage"), "postings")


# ---- snapshots -------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was stored (no ids of 5k + 4) and what is fetched now (no 7k; every 6k has changed)."""
    rows = derive.jobs(spark, sf_dir).select("source_id", "external_id", "content_hash", "last_seen", "closed_at")
    old = rows.filter("external_id % 5 != 4")
    changed = F.when(F.col("external_id") % 6 == 0, F.sha2(F.concat("content_hash", F.lit("*")), 256)).otherwise(F.col("content_hash"))
    return old, rows.filter("external_id % 7 != 0").withColumn("content_hash", changed).select("source_id", "external_id", "content_hash")


def cdc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return state.changes(old, new, ["source_id", "external_id"]).select("source_id", "external_id", "change")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return state.counters(state.changes(old, new, ["source_id", "external_id"]), "source_id")


def closures(complete: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        old, new = snapshots(spark, sf_dir)
        rows = state.close_missing(old, new, ["source_id", "external_id"], as_of(), complete)
        return rows.filter("closed_now").select("external_id", day("closed_at").alias("closed_on"))

    return query


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    rows = state.upsert(old.select("source_id", "external_id", "content_hash"), new, ["source_id", "external_id"])
    return rows.groupBy("source_id", "inserted").agg(F.count(F.lit(1)).alias("n"))


def cursor_overlap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two half windows that overlap by a day, as one without repeats."""
    log = derive.application_events(spark, sf_dir)
    first, second = log.filter(day("occurred_at") <= "2024-01-16"), log.filter(day("occurred_at") >= "2024-01-15")
    rows = first.unionByName(second).dropDuplicates(["event_id"])
    return rows.groupBy(day("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    pairs = ["external_id", "content_hash"]
    parts = (("kept", old.select(pairs).intersect(new.select(pairs))), ("gone", old.select(pairs).exceptAll(new.select(pairs))), ("fresh", new.select(pairs).exceptAll(old.select(pairs))))
    out = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next_run(derive.sources(spark, sf_dir))
    due = F.col("next_run") < as_of() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10))
    rows = rows.filter("enabled and kind != 'capture'").filter(due)
    return rows.orderBy("next_run", "source_id").select("source_id", F.col("next_run").cast("timestamp_ntz").alias("next_run"))


def with_next_run(rows: DataFrame) -> DataFrame:
    delay = times.source_backoff(F.col("interval_minutes"), F.col("failures"))
    return rows.withColumn("next_run", F.col("last_run") + F.make_dt_interval(F.lit(0), F.lit(0), delay.cast("int")))


def backoff_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next_run(derive.sources(spark, sf_dir))
    delay = times.source_backoff(F.col("interval_minutes"), F.col("failures")).cast("int")
    return rows.select("source_id", delay.alias("delay_minutes"), times.http_backoff_ms(F.col("failures")).cast("long").alias("http_ms"))


def retention_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs to keep and to delete, sixty days before the last one."""
    rows = derive.runs(spark, sf_dir)
    last = rows.agg(F.max("started_at").alias("last"))
    old = F.col("started_at") < times.days_before(F.col("last"), 60)
    return rows.crossJoin(last).groupBy(old.alias("expired")).agg(F.count(F.lit(1)).alias("n"))  # the right side is one row


def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a rule, by rule: applications without target, repeated keys, unknown states."""
    apps = derive.applications(spark, sf_dir)
    runs = derive.runs(spark, sf_dir)
    tests = (
        ("application has a cluster or a title", apps.filter("cluster_id is null and external_title is null")),
        ("application is known", apps.filter("status not in ('to_apply', 'applied', 'followed_up', 'interview', 'offer', 'withdrawn', 'ghosted')")),
        ("run id is unique", runs.groupBy("run_id").count().filter("count > 1")),
        ("run has a source", runs.join(derive.jobs(spark, sf_dir).select("source_id").distinct(), "source_id", "left_anti")),
    )
    out = None
    for rule, bad in tests:
        row = bad.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.application_events(spark, sf_dir)
    k = F.from_json("props", "k int")["k"]
    return rows.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def scheduled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.application_events(spark, sf_dir)
    stale = times.worker_stale(F.col("occurred_at"), F.col("occurred_at") + F.make_dt_interval(F.lit(0), F.lit(3)))
    return rows.groupBy(times.last_window(F.col("occurred_at")).alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.count_if(stale).alias("stale"))
