"""The list, count, audit and overview queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.functions import keys, numbers, times
from harrow.operators.rules import hidden_by_verdict
from harrow.operators.snapshot import written
from harrow.session import table

from . import derive

INBOX_ROWS, REJECTED_ROWS, OUTSIDE = 300, 1000, -1


def as_of() -> Column:
    return F.lit(derive.AS_OF).cast("timestamp")


def day(moment: Column | str) -> Column:
    """yyyy-MM-dd as text, so that results compare alike in every engine."""
    return F.to_date(moment).cast("string")


def text(array: Column) -> Column:
    return F.array_join(array, "|")


# ---- clusters and their canonical posting ----------------------------------------------------------


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with cluster, triage and the rank by which a cluster's canonical posting is chosen, without their texts."""
    return written(spark, sf_dir, "members", lambda: placed(derive.jobs(spark, sf_dir)))


def placed(jobs: DataFrame) -> DataFrame:
    rows = derive.clusters(jobs.drop("description", "tags", "matched"))
    rank = F.when(F.col("status") == "passed", 0).otherwise(10) + F.when(F.col("closed_at").isNotNull(), 5).otherwise(0)
    return rows.withColumn("rank", rank + keys.source_priority(F.col("source_kind")))


def canonical(rows: DataFrame) -> DataFrame:
    """The member with the lowest rank; then the first seen, the source and the id decide.

    A minimum of structs combines before the shuffle, where a window would sort every member.
    """
    order = ["rank", "first_seen", "source_id", "external_id"]
    rest = [c for c in rows.columns if c not in ("cluster_id", *order)]
    best = rows.groupBy("cluster_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("v"), F.min(F.struct(*order)).alias("o"))
    return best.select("cluster_id", "o.*", "v.*")


def score_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "scores", lambda: derive.scores(spark, sf_dir, derive.jobs(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str, rows: DataFrame, how: str = "left") -> DataFrame:
    """Joins the score cache of the current prompt and model; those two constants are filtered before the join."""
    cache = score_cache(spark, sf_dir)
    cache = cache.filter((F.col("prompt_version") == derive.PROMPT) & (F.col("model") == derive.MODEL))
    return rows.join(cache.drop("prompt_version", "model"), "content_hash", how)


def inbox(
    spark: SparkSession, sf_dir: str, triage: str = "new", min_score: int | None = None, max_age_days: int | None = None,
    kind: str | None = None, include_hidden: bool = False,
) -> DataFrame:
    """Open, passed clusters by triage state; arguments that are None filter nothing."""
    rows = members(spark, sf_dir)
    head = scored(spark, sf_dir, canonical(rows))
    hidden = hidden_by_verdict(F.col("remote_verdict"), F.col("contract_verdict"), F.col("flags"))
    tests = [F.col("triage") == triage, F.col("status") == "passed", F.col("closed_at").isNull()]
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    if max_age_days is not None:
        tests.append(F.col("first_seen") > times.days_before(as_of(), max_age_days))
    if not include_hidden:
        tests.append(~hidden)
    head = head.filter(reduce(lambda a, b: a & b, tests))
    if kind is not None:
        head = head.join(rows.filter(F.col("source_kind") == kind).select("cluster_id"), "cluster_id", "left_semi")
    return head


INBOX_COLUMNS = ("cluster_id", "external_id", "title", "company_name", "source_kind", "remote_policy", "contract_type", "rule_score")


def inbox_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inbox(spark, sf_dir)
    order = [F.col("score").desc_nulls_last(), F.col("rule_score").desc(), F.col("first_seen").desc(), F.col("cluster_id")]
    level = numbers.score_level(F.col("score")).alias("level")
    return rows.orderBy(*order).limit(INBOX_ROWS).select(*INBOX_COLUMNS, F.col("score").cast("double").alias("score"), level, text(F.col("flags")).alias("flags"))


def inbox_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def inbox_filtered_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox(spark, sf_dir, min_score=60, max_age_days=75, include_hidden=True).select("cluster_id", "score", "rule_score")


def inbox_by_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with a posting from one kind of source, and all their kinds."""
    rows = members(spark, sf_dir)
    kinds = rows.groupBy("cluster_id").agg(F.sort_array(F.collect_set("source_kind")).alias("kinds"))
    return inbox(spark, sf_dir, kind="lever", include_hidden=True).join(kinds, "cluster_id").select("cluster_id", text(F.col("kinds")).alias("kinds"))


def score_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that only a verdict hides; unscored ones would come first."""
    head = scored(spark, sf_dir, canonical(members(spark, sf_dir)), "inner")
    hidden = hidden_by_verdict(F.col("remote_verdict"), F.col("contract_verdict"), F.col("flags"))
    rows = head.filter((F.col("status") == "passed") & (F.col("triage") == "new") & hidden)
    shown = numbers.remote_fact(F.col("remote_policy"), F.col("remote_verdict"))
    return rows.orderBy(F.col("score").desc_nulls_first(), "cluster_id").select("cluster_id", "score", shown["label"].alias("remote"), shown["tone"].alias("tone"))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected postings first seen in the last sixty days."""
    recent = F.col("first_seen") > times.days_before(as_of(), 60)
    return derive.jobs(spark, sf_dir).filter((F.col("status") == "rejected") & recent)


def rejected_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rejected(spark, sf_dir).orderBy(F.col("rule_score").desc(), "external_id").limit(REJECTED_ROWS)
    return rows.select("external_id", "source_kind", "rule_score", text(F.col("reasons")).alias("reasons"))


def reason_code(reason: Column) -> Column:
    return F.split_part(reason, F.lit(":"), F.lit(1))


def reject_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = rejected(spark, sf_dir).select(F.explode("reasons").alias("reason")).select(reason_code(F.col("reason")).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason")


def reject_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("autre"))
    rows = rejected(spark, sf_dir).select(first.alias("reason"))
    return rows.groupBy(numbers.reason_label(reason_code(F.col("reason"))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected for one reason only, and not for the role."""
    only = F.element_at("reasons", 1)
    rows = rejected(spark, sf_dir).filter((F.size("reasons") == 1) & ~only.startswith("role:"))
    return rows.select("external_id", numbers.reason_label(only).alias("reason"), "rule_score")


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.jobs(spark, sf_dir)
    return rows.select("external_id", "status", "rule_score", text(F.col("reasons")).alias("reasons"), text(F.col("flags")).alias("flags"), F.size("matched").alias("matched"))


def score_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, canonical(members(spark, sf_dir)))
    fact = numbers.contract_fact(F.col("contract_type"), F.col("contract_verdict"))
    level = F.coalesce(numbers.score_level(F.col("score")), F.lit("unscored"))
    return rows.groupBy(level.alias("level"), fact["label"].alias("contract"), fact["tone"].alias("tone")).agg(F.count(F.lit(1)).alias("n"))


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: fetched and passed postings and the titles of the best three."""
    rows = derive.jobs(spark, sf_dir)
    totals = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("status") == "passed").alias("passed"))
    best = Window.partitionBy("source_id").orderBy(F.col("rule_score").desc(), "external_id")
    top = rows.filter("status = 'passed'").withColumn("n", F.row_number().over(best)).filter("n <= 3")
    titles = top.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("n", "external_id"))).alias("top"))
    shown = F.array_join(F.transform("top", lambda x: x["external_id"].cast("string")), "|")
    return totals.join(titles, "source_id", "left").select("source_id", "fetched", "passed", F.coalesce(shown, F.lit("")).alias("samples"))


# ---- companies, sources, pipeline ------------------------------------------------------------------


def companies_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with counts of contacts and open postings, whether there is a draft, and the last application."""
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy(F.col("o_custkey").alias("company_id")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("contacts"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_applied"),
    )
    drafts = orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("company_id")).distinct().withColumn("has_draft", F.lit(True))
    rows = derive.companies(spark, sf_dir).join(per, "company_id", "left").join(drafts, "company_id", "left")
    shown = F.when(F.col("outreach") == "none", "to_contact").otherwise(F.col("outreach"))
    return rows.orderBy((F.col("outreach") == "none").desc(), "name", "company_id").select(
        "company_id", "name", "city", shown.alias("outreach"),
        F.coalesce("open_jobs", F.lit(0)).alias("open_jobs"), F.coalesce("contacts", F.lit(0)).alias("contacts"),
        F.coalesce("has_draft", F.lit(False)).alias("has_draft"), day("last_applied").alias("last_applied"),
    )


def sources_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = derive.jobs(spark, sf_dir).filter("status = 'passed' and closed_at is null").groupBy("source_kind").agg(F.count(F.lit(1)).alias("passed"))
    rows = derive.sources(spark, sf_dir).join(derive.companies(spark, sf_dir).select("company_id", "name"), "company_id", "left")
    rows = rows.join(passed, F.col("kind") == F.col("source_kind"), "left")
    order = [(F.col("kind") == "capture").desc(), F.col("failures").desc(), F.col("label")]
    return rows.orderBy(*order).select("source_id", "kind", "label", F.col("name").alias("company"), "enabled", "failures", F.coalesce("passed", F.lit(0)).alias("passed"))


def source_runs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    rows = derive.runs(spark, sf_dir).withColumn("n", F.row_number().over(latest)).filter("n <= 20")
    return rows.select("source_id", "run_id", day("started_at").alias("day"), "status", F.col("n").cast("long").alias("n"))


def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.runs(spark, sf_dir).groupBy(day("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "partial").alias("partial"), F.sum("created").alias("created"), F.sum("failed_items").alias("failed_items"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of the score cache."""
    rows = score_cache(spark, sf_dir)
    tokens_in, tokens_out = (F.coalesce(F.sum(c), F.lit(0)) for c in ("input_tokens", "output_tokens"))
    return rows.agg(F.count(F.lit(1)).alias("calls"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out")).withColumn(
        "usd", F.round(numbers.cost_usd(F.col("tokens_in"), F.col("tokens_out")), 6)
    )


def nav_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five independent counts in one row."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    heads = canonical(members(spark, sf_dir))
    parts = [
        one(heads.filter("triage = 'new' and status = 'passed' and closed_at is null"), "inbox"),
        one(heads.filter("triage = 'interested'"), "interesting"),
        one(derive.applications(spark, sf_dir).filter(~F.col("status").isin(*CLOSED)), "pipeline"),
        one(derive.sources(spark, sf_dir).filter("failures > 0 and enabled"), "failing"),
        one(derive.sources(spark, sf_dir).filter("source_id like 'lever%' and not enabled"), "disabled_lever"),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def pipeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with their cluster's posting; title and company fall back to what was typed in."""
    heads = canonical(members(spark, sf_dir)).select("cluster_id", "title", "company_name")
    rows = derive.applications(spark, sf_dir).join(heads, "cluster_id", "left")
    rows = rows.join(derive.companies(spark, sf_dir).select("company_id", "name"), F.col("application_id") == F.col("company_id"), "left")
    return rows.select(
        "application_id", "status", "updated_at", F.coalesce("title", "external_title").alias("title"),
        F.coalesce("company_name", "name", F.lit("?")).alias("company"), times.next_action(F.col("status"), F.to_date("updated_at")).alias("next_action"),
    )


# The states of an application in their order, and those that end it.
STATUS_ORDER = ("to_apply", "applied", "followed_up", "interview", "offer", "rejected", "withdrawn", "ghosted")
CLOSED = ("offer", "rejected", "withdrawn", "ghosted")


def pipeline_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order of the states; empty groups are left out."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    rows = pipeline_rows(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("next_action").cast("string").alias("first_action"))
    return rows.withColumn("place", place).orderBy("place")


def due_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline_rows(spark, sf_dir).filter(times.overdue(F.col("next_action"), F.to_date(as_of())) & ~F.col("status").isin(*CLOSED))
    return rows.orderBy(F.col("next_action").asc_nulls_last(), F.col("updated_at").desc(), "application_id").select(
        "application_id", "status", "title", "company", day("next_action").alias("next_action")
    )


def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("application_id").orderBy("occurred_at", "event_id")
    rows = derive.application_events(spark, sf_dir).withColumn("from_status", F.lag("to_status").over(order))
    return rows.groupBy("from_status", "to_status").agg(F.count(F.lit(1)).alias("n"))


def triage_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown after a row is triaged: the next one, or the one before at the list's end."""
    rows = inbox_list(spark, sf_dir).select("cluster_id", "score", "rule_score")  # bounded by INBOX_ROWS
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc_nulls_last(), F.col("rule_score").desc(), "cluster_id")
    return rows.select("cluster_id", F.coalesce(F.lead("cluster_id").over(order), F.lag("cluster_id").over(order)).alias("next_id"))
