"""Ingestion steps, what users do, and upkeep of tables, each over a state made of the driver's tables.

A query's result is the state after it, as rows of (what, key, value), or the rows that its name says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.functions import keys
from harrow.functions.text import normalize_company
from harrow.operators import actions, assign, candidates, companies, merges, state
from harrow.operators.rules import Criteria
from harrow.session import table
from harrow.sources import registry
from harrow.streaming import ingest

from . import derive
from .read_models import as_of, canonical, day, members, score_cache, text

LATER = "2024-05-01"
#: Criteria that differ from the default ones.
STRICTER = Criteria(required_stack=(r"\bpython\b", r"\bspark\b"), title_exclusions=(r"\bphp\b", r"\bwordpress\b", r"\bsales\b"))


def facts(**parts: DataFrame | tuple[DataFrame, Column, Column]) -> DataFrame:
    """(what, key, value) of each part: a frame, its key and its value."""
    rows = [df.select(F.lit(name).alias("what"), key.cast("string").alias("key"), value.cast("string").alias("value")) for name, (df, key, value) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def told(*values: Column) -> Column:
    """Several values as one text; null is a dash."""
    return F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("-")) for v in values])


# ---- the state that requests meet ------------------------------------------------------------------


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cluster_id")
    rows = canonical(members(spark, sf_dir).select("cluster_id", "rank", "first_seen", "source_id", "external_id", "triage"))
    return rows.select("cluster_id", "triage", F.lit(None).cast("timestamp").alias("triaged_at"), F.when(c % 4 != 0, c % 150 + 1).alias("company_id"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every third cluster one application, and for every tenth company a spontaneous one."""
    c, start = F.col("cluster_id"), F.to_timestamp(F.lit("2024-02-01"))
    status = derive.pick(("to_apply", "applied", "followed_up", "rejected"), c)
    of_cluster = actions.shaped(
        clusters(spark, sf_dir).filter(c % 3 == 0), actions.APPLICATION,
        application_id=F.concat(F.lit("cluster:"), c.cast("string")), kind=F.lit("job"), cluster_id=c, company_id=F.col("company_id"), status=status,
        applied_at=F.when(status != "to_apply", start), notes=F.when(c % 2 == 0, "first").otherwise(""), created_at=start,
    )
    k = F.col("company_id")
    pending = F.when(k % 20 == 0, "to_apply").otherwise("applied")
    of_company = actions.shaped(
        derive.companies(spark, sf_dir).filter(k % 10 == 0), actions.APPLICATION,
        application_id=F.concat(F.lit("company:"), k.cast("string")), kind=F.lit("spontaneous"), company_id=k, contact_id=k, status=pending, notes=F.lit(""), created_at=start,
    )
    return of_cluster.unionByName(of_company)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.companies(spark, sf_dir).select("company_id", "name", "name_norm", "domain", F.concat(F.lit("https://"), "domain").alias("website"), "outreach")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact for every fifth company."""
    k = F.col("company_id")
    rows = derive.companies(spark, sf_dir).filter(k % 5 == 0)
    personal = k % 15 == 0
    return rows.select(
        k.alias("contact_id"), k.alias("company_id"), F.concat(F.when(personal, "ann").otherwise("jobs"), F.lit("@"), F.col("domain")).alias("email"),
        F.when(personal, "personal").otherwise("generic").alias("kind"), F.lit("a label").alias("label"), F.concat(F.lit("manual:card "), k.cast("string")).alias("source"),
        F.lit("b2b_legitimate_interest").alias("consent_basis"), F.lit(None).cast("timestamp").alias("info_notice_sent_at"), F.lit(None).cast("timestamp").alias("opted_out_at"),
        F.when(k % 25 == 0, F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((k % 120).cast("int"))).alias("deleted_at"),
    )


def asked(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[c.alias(name) for name, c in columns.items()])


def later() -> Column:
    return F.to_timestamp(F.lit(LATER))


def _apps(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    return df, F.col("application_id"), told(F.col("status"), F.col("cluster_id"), day("applied_at"), F.col("next_action"), F.col("notes"))


def _events(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    return df, F.col("application_id"), told(F.col("type"), F.col("from_status"), F.col("to_status"), F.col("note"))


def _triage(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    return df, F.col("cluster_id"), F.col("triage")


# ---- ACT -------------------------------------------------------------------------------------------


def act_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters(spark, sf_dir)
    c = F.col("cluster_id")
    requests = asked(rows.filter(c % 5 == 0), cluster_id=c, triage=derive.pick(("applied", "dismissed", "interested"), F.floor(c / 5)))
    out = actions.set_triage(rows, applications(spark, sf_dir), requests, later())
    return facts(cluster=_triage(out[0]), application=_apps(out[1]), event=_events(out[2]))


def act_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters(spark, sf_dir)
    c = F.col("cluster_id")
    # chains of neighbours, rounds and repeats among them, and many clusters into one
    chained = asked(rows.filter(c % 7 < 2), at=c * 37 % 1009, source=c, target=F.when(c % 21 == 0, c).otherwise(c + 1))
    starred = asked(rows.filter(c % 5 == 0), at=1009 + c * 41 % 997, source=c, target=c - c % 60 + 1)
    pairs = chained.unionByName(starred)
    placed = members(spark, sf_dir).select("cluster_id", "source_id", "external_id")
    jobs, left, apps, refused = merges.merge_clusters(placed, rows, applications(spark, sf_dir), pairs, ("at", "source", "target"))
    return facts(cluster=_triage(left), posting=(jobs, F.col("external_id"), F.col("cluster_id")), application=(apps, F.col("application_id"), F.col("cluster_id")), refused=(refused, F.col("source"), told(F.col("target"), F.col("reason"))))


def act_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters(spark, sf_dir)
    placed = members(spark, sf_dir).select("cluster_id", "external_id", "status", F.lit(False).alias("forced_pass"))
    jobs, left = actions.rescue(placed, rows, rows.filter("cluster_id % 6 = 0").select("cluster_id"))
    return facts(cluster=_triage(left), posting=(jobs, F.col("external_id"), told(F.col("status"), F.col("forced_pass"))))


def act_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications for clusters, and for postings found elsewhere."""
    rows, apps = clusters(spark, sf_dir), applications(spark, sf_dir)
    c = F.col("cluster_id")
    requests = asked(rows.filter(c % 4 == 0), cluster_id=c, status=F.when(c % 8 == 0, "applied").otherwise("to_apply"))
    left, apps, events = actions.open_applications(rows, apps, requests, later())
    s = F.col("s_suppkey")
    elsewhere = asked(
        table(spark, sf_dir, "supplier"), url=F.concat(F.lit("https://x.example/"), s.cast("string")), title=F.col("s_name"), company=F.col("s_name"),
        status=F.when(s % 2 == 0, "to_apply"), channel=F.lit("mail"), notes=F.lit(None).cast("string"),
    )
    apps, more = actions.external_applications(apps, elsewhere, later())
    return facts(cluster=_triage(left), application=_apps(apps), event=_events(events.unionByName(more)))


def act_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = applications(spark, sf_dir)
    c = F.col("cluster_id")
    requests = asked(
        apps.filter(c % 6 == 0), application_id=F.col("application_id"), to_status=derive.pick(("followed_up", "interview", "to_apply"), c), note=F.when(c % 12 == 0, "call"), at=later()
    )
    out, left, events = actions.update_status(apps, clusters(spark, sf_dir), requests)
    return facts(cluster=_triage(left), application=_apps(out), event=_events(events))


def act_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, dates of the next action and deletions, one after the other."""
    apps = applications(spark, sf_dir)
    c, a = F.col("cluster_id"), F.col("application_id")
    apps, events = actions.add_notes(apps, asked(apps.filter(c % 9 == 0), application_id=a, note=F.lit("called")), later())
    apps = actions.set_next_action(apps, asked(apps.filter(c % 15 == 0), application_id=a, next_action=F.when(c % 2 == 0, F.to_date(later()))))
    out, left = actions.delete_applications(apps, clusters(spark, sf_dir), apps.filter(c % 18 == 0).select(a))
    return facts(cluster=_triage(left), application=_apps(out), event=_events(events))


def act_find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies, one after the other: those found are filled in, the others are created and found by later ones."""
    s = F.col("s_suppkey")
    probe = table(spark, sf_dir, "supplier").select(
        s.alias("request"), F.lit(None).cast("string").alias("siren"), F.when(s % 2 == 0, F.concat(F.lit("c"), (s % 90 * 17).cast("string"), F.lit(".example.com"))).alias("domain"),
        F.concat(F.lit("customer#"), F.lpad((s % 70 * 30 % 1997).cast("string"), 9, "0")).alias("name_norm"),
    )
    known = derive.companies(spark, sf_dir).select("company_id", "name", "name_norm", F.when(F.col("company_id") % 3 == 0, F.col("domain")).alias("domain"), F.lit(None).cast("string").alias("siren"))
    answers, firms = companies.find_or_create(probe, known)
    return facts(answer=(answers, F.col("request"), told(F.col("way"), F.col("company_id"), F.col("domain"))), company=(firms, F.col("company_id"), told(F.col("name_norm"), F.col("domain"))))


def act_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names and websites, then promotion of the companies of clusters."""
    rows = targets(spark, sf_dir)
    k = F.col("company_id")
    requests = asked(
        rows.filter(k % 8 == 0), company_id=k, name=F.when(k % 16 == 0, F.concat(F.lit("New SARL "), F.col("name"))), website=F.when(k % 24 == 0, F.lit("")).when(k % 3 == 1, F.lit("http://www.New.example/x")),
        outreach=F.when(k % 32 == 0, F.lit("closed")),
    )
    rows = actions.update_companies(rows, requests)
    wanted = clusters(spark, sf_dir).filter("cluster_id % 2 = 0").select("cluster_id")
    rows = actions.promote(rows, clusters(spark, sf_dir), wanted)
    return rows.select("company_id", "name", "name_norm", "domain", "website", "outreach")


def act_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts typed in (some twice, some known), deletions, opt-outs, and the purge of old ones."""
    rows = contacts(spark, sf_dir)
    k = F.col("company_id")
    base = derive.companies(spark, sf_dir).filter(k % 2 == 0)
    requests = asked(
        base, contact_id=k + 100_000, company_id=k, email=F.concat(F.lit("JOBS@"), F.concat(F.lit("c"), (k - k % 4).cast("string"), F.lit(".example.com"))), kind=F.when(k % 3 == 0, "personal").otherwise("generic"),
        label=F.lit(""), note=F.lit("fair"),
    )
    rows = actions.add_contacts(rows, requests)
    rows = actions.mark_contacts(rows, rows.filter("contact_id % 35 = 0").select("contact_id"), "deleted_at", later())
    rows = actions.mark_contacts(rows, rows.filter("contact_id % 7 = 1").select("contact_id"), "opted_out_at", later())
    rows = actions.purge_deleted(rows, later())
    return rows.select("contact_id", "company_id", "email", "label", "source", "consent_basis", day("deleted_at").alias("deleted"), F.col("opted_out_at").isNotNull().alias("opted_out"), F.col("deleted_at").isNull().alias("active"))


def act_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.sources(spark, sf_dir).withColumn("next_run", F.col("last_run"))
    i = F.col("company_id")
    rows = actions.enable_sources(rows, asked(rows.filter(i % 3 == 0), source_id=F.col("source_id"), enabled=i % 2 == 0), later())
    rows = actions.set_intervals(rows, asked(rows.filter(i % 4 == 0), source_id=F.col("source_id"), minutes=(i * 7 % 400).cast("double")))
    gone = rows.filter(i % 11 == 0).select("source_id")
    rows, _ = state.delete_cascade(rows, rows, gone, "source_id")
    return rows.select("source_id", "enabled", "failures", "interval_minutes", F.col("next_run").cast("timestamp_ntz").alias("next_run"))


def act_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts to contacts, then the messages that were sent."""
    k = F.col("company_id")
    people = contacts(spark, sf_dir)
    requests = asked(people.filter(k % 30 != 0), company_id=k, contact_id=F.col("contact_id"), subject=F.concat(F.lit("To "), k.cast("string")), body=F.lit("  Hello.  "))
    apps, firms, events = actions.save_drafts(applications(spark, sf_dir), targets(spark, sf_dir), people, requests, "From {{source}}.", later())
    sent = apps.filter("kind = 'spontaneous' and draft_subject is not null and company_id % 4 = 0").select("application_id")
    apps, people, firms, more = actions.mark_sent(apps, people, firms, sent, later())
    draft = told(F.col("status"), F.col("draft_subject"), F.col("draft_body"), F.col("next_action"))
    spontaneous = apps.filter("kind = 'spontaneous'")
    return facts(
        application=(spontaneous, F.col("company_id"), draft), company=(firms, k, F.col("outreach")), contact=(people, F.col("contact_id"), F.col("info_notice_sent_at").isNotNull()),
        event=(events.unionByName(more), F.regexp_replace("application_id", r"^(company:\d+).*", "$1"), told(F.col("type"), F.col("to_status"), F.col("note"))),
    )


def act_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters(spark, sf_dir)
    c = F.col("cluster_id")
    requests = asked(rows.filter(c % 10 == 0), cluster_id=c, subject=F.concat(F.lit(" Cluster "), c.cast("string")), body=F.lit("Dear all "))
    left, apps, events = actions.save_letters(rows, applications(spark, sf_dir), requests, later())
    jobs = apps.filter("kind = 'job'")
    return facts(cluster=_triage(left), letter=(jobs, F.col("application_id"), told(F.col("status"), F.col("draft_subject"), F.col("draft_body"))), event=_events(events))


# ---- STR -------------------------------------------------------------------------------------------


def placed_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored postings (two of three) with clusters by key, and the others."""
    rows = derive.jobs(spark, sf_dir)
    names = ["source_id", "external_id", "source_kind", "title_norm", "company_name", "company_norm", "dedup_key", "content_hash", "status", "first_seen", "last_seen", "closed_at"]
    stored = rows.filter("external_id % 3 != 0").select(*names)
    ids = stored.groupBy("dedup_key").agg(F.min("external_id").alias("cluster_id"))
    return stored.join(ids, "dedup_key"), rows.filter("external_id % 3 = 0").select(*names)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = placed_state(spark, sf_dir)
    rows = assign.assign(new, assign.cluster_table(old), as_of())
    return rows.select("external_id", "cluster_id", "way", F.col("previous_id").cast("double").alias("previous_id"))


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters that each cluster of stored postings may be merged with."""
    old, _ = placed_state(spark, sf_dir)
    return candidates.merge_candidates(assign.cluster_table(old)).withColumn("sim", F.round("sim", 6))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetch brings: no ids of 7k, changed contents for 6k, changed titles for 12k, some items twice."""
    i = F.col("external_id")
    rows = derive.jobs(spark, sf_dir).filter(i % 7 != 0)
    title = F.when(i % 12 == 0, F.concat("title_norm", F.lit(" two"))).otherwise(F.col("title_norm"))
    rows = rows.select(
        "source_id", "external_id", "source_kind", title.alias("title_norm"), "company_name", "company_norm", "status",
        F.when(i % 12 == 0, F.coalesce(keys.dedup_key(F.col("company_norm"), title), F.col("dedup_key"))).otherwise(F.col("dedup_key")).alias("dedup_key"),
        F.when(i % 6 == 0, F.sha2(F.concat("content_hash", F.lit("*")), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.explode(F.when(i % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("at"),
    )
    return ingest.first_of_each(rows, "at")


def ingest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a step by source, change and what became of the posting."""
    old, _ = placed_state(spark, sf_dir)
    done = ingest.step(old, fetched(spark, sf_dir), as_of(), complete=False)
    rows = done.changes.join(done.jobs.select("source_id", "external_id", "closed_at"), ["source_id", "external_id"])
    return rows.groupBy("source_id", "change", "closing", F.col("closed_at").isNull().alias("open")).agg(F.count(F.lit(1)).alias("n"))


def refresh_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters that a step leaves to be refreshed, those that new postings join or start included, and their postings afterwards."""
    old, _ = placed_state(spark, sf_dir)
    done = ingest.step(old, fetched(spark, sf_dir), as_of(), complete=True)
    members = done.jobs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("closed_at").isNull()).alias("open"))
    return done.refresh.join(members, "cluster_id", "left").select("cluster_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("members", "open")))


def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the snapshot after a second, equal fetch differs from that after the first: none."""
    old, _ = placed_state(spark, sf_dir)
    items = fetched(spark, sf_dir)
    one = ingest.step(old, items, as_of(), complete=True).jobs
    two = ingest.step(one, items, as_of(), complete=True).jobs
    return one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count(F.lit(1)).alias("differing"))


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after runs that succeeded, failed, were aborted, or found their board gone."""
    rows = derive.sources(spark, sf_dir).withColumn("next_run", F.col("last_run"))
    i = F.col("company_id")
    good = asked(rows.filter(i % 3 == 0), source_id=F.col("source_id"), failed_items=i % 2)
    rows = ingest.succeeded(rows, good, as_of())
    bad = asked(rows.filter(i % 3 == 1), source_id=F.col("source_id"), status_code=F.when(i % 2 == 0, 404).otherwise(503), error=F.repeat(F.lit("x"), F.lit(600)), aborted=i % 9 == 1)
    rows = ingest.failed(rows, bad, as_of(), F.col("kind").isin(*registry.BOARDS))
    return rows.select("source_id", "enabled", F.col("failures").cast("int").alias("failures"), F.col("next_run").cast("timestamp_ntz").alias("next_run"), "last_status", F.length("last_error").cast("double").alias("error_length"))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("ft:"), i.cast("string")).alias("source_id"), i)
    known = rows.filter(i % 4 != 0).select("source_id", (F.to_timestamp(F.lit("2024-04-01")) + F.make_dt_interval(F.lit(0), (i % 48).cast("int"))).alias("last_creation"))
    out = ingest.advance(known, rows.select("source_id", (i % 3 != 0).alias("complete")), as_of())
    return out.select("source_id", F.col("since").cast("timestamp_ntz").alias("since"), F.col("last_creation").cast("timestamp_ntz").alias("last_creation"))


def refiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after stricter criteria, which only open postings get."""
    jobs = derive.jobs(spark, sf_dir).withColumns({"forced_pass": F.col("external_id") % 20 == 0, "cluster_id": F.col("external_id")})
    rows, refresh = ingest.refilter(jobs, STRICTER)
    marks = refresh.withColumn("refreshed", F.lit(True))
    rows = rows.join(marks, "cluster_id", "left")
    return rows.select("external_id", "status", text(F.col("reasons")).alias("reasons"), F.coalesce("refreshed", F.lit(False)).alias("refreshed"))


# ---- SNK, and reads that the screens do ------------------------------------------------------------


def scores_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a second scoring of every third entry: tokens add up, the later score stays."""
    old = score_cache(spark, sf_dir).select("content_hash", "score", "input_tokens", F.lit(1).alias("at"))
    hit = F.substring("content_hash", 1, 1).isin("0", "1", "2", "3", "4")
    new = old.filter(hit).select("content_hash", (F.col("score") + 1).alias("score"), (F.col("input_tokens") + 7).alias("input_tokens"), F.lit(2).alias("at"))
    return state.accumulate(old, new, ["content_hash"], ["input_tokens"], "at").select("content_hash", "score", "input_tokens")


def contacts_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or ignore."""
    old = contacts(spark, sf_dir).select("company_id", F.lit("old").alias("origin"))
    new = derive.companies(spark, sf_dir).filter("company_id % 3 = 0").select("company_id", F.lit("new").alias("origin"))
    return state.insert_missing(old, new, ["company_id"])


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.jobs(spark, sf_dir).select("source_id", "external_id", "last_seen", "closed_at")
    out = state.touch(rows, rows.filter("external_id % 4 = 0"), ["source_id", "external_id"], as_of())
    return out.select("external_id", day("last_seen").alias("last_seen"), F.col("closed_at").isNull().alias("open"))


def sources_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources go with their runs and postings; applications lose the reference to their postings."""
    rows = derive.jobs(spark, sf_dir).select("source_id", "external_id")
    gone = rows.select("source_id").distinct().filter("source_id like '%1'")
    runs = derive.runs(spark, sf_dir)
    kept, log = state.delete_cascade(rows, runs, gone, "source_id")
    lost = rows.join(gone, "source_id", "left_semi").select("external_id")
    apps = state.set_null(rows.filter("external_id % 3 = 0").select("external_id", F.col("external_id").alias("app")), lost, "external_id")
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(kept, "postings").unionByName(count(log, "runs")).unionByName(count(apps.filter("external_id is null"), "loose applications"))


def contacts_erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts(spark, sf_dir)
    old = F.col("deleted_at") < as_of() - F.make_dt_interval(F.lit(30))
    return state.erase(rows, old, ["email", "label"]).select("contact_id", "email", "label")


def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row, whose columns later writes replace; events stand for writes."""
    rows = table(spark, sf_dir, "events").select(F.lit(1).alias("id"), F.col("ts"), F.col("event_id"), F.col("event_type"))
    order = F.struct("ts", "event_id")
    return rows.groupBy("id").agg(F.max("ts").alias("last_tick"), F.max_by(F.when(F.col("event_type") == "error", F.col("event_id")), F.when(F.col("event_type") == "error", order)).alias("last_error"))


def backups_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's dumps, named by day, the newest eight."""
    rows = derive.runs(spark, sf_dir).select("source_id", F.concat(F.lit("dump-"), day("started_at"), F.lit(".sql")).alias("file")).distinct()
    newest = Window.partitionBy("source_id").orderBy(F.col("file").desc())
    return rows.withColumn("n", F.row_number().over(newest)).filter("n <= 8").select("source_id", "file")


def write_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a source in batches of a hundred, each of which is kept when a later one fails."""
    place = Window.partitionBy("source_id").orderBy("external_id")
    rows = derive.jobs(spark, sf_dir).select("source_id", "external_id").withColumn("batch", F.floor((F.row_number().over(place) - 1) / 100))
    return rows.groupBy("source_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("external_id").alias("first_id"), F.max("external_id").alias("last_id"))


def companies_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment fills what is null and overwrites nothing."""
    k = F.col("company_id")
    rows = derive.companies(spark, sf_dir).select(k, F.when(k % 2 == 0, F.col("city")).alias("city"), F.when(k % 3 == 0, F.col("domain")).alias("domain"))
    values = derive.companies(spark, sf_dir).filter(k % 5 != 0).select(k, F.lit("Elsewhere").alias("city"), F.concat(F.lit("new."), F.col("domain")).alias("domain"))
    return state.fill(rows, values, ["company_id"])


def orphans_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings without a company find it by their normalised name."""
    known = spark.createDataFrame([(i, name) for i, name in enumerate(derive.COMPANIES) if i % 2], "company_id int, name string")
    known = known.withColumn("name_norm", normalize_company(F.col("name")))
    rows = derive.jobs(spark, sf_dir).select("external_id", "company_name", F.lit(None).cast("int").alias("company_id"))
    return companies.attach_orphans(rows, known).filter("company_id is not null").select("external_id", "company_id")


def company_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that contain a word, whatever its case; accents count."""
    rows = derive.jobs(spark, sf_dir).filter(F.col("company_name").ilike("%bêta%") | F.col("company_name").ilike("%GAMMA%"))
    return rows.select("external_id", "company_name")


def company_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company by its id, with contacts in order of their kind and then address, whatever its case."""
    rows = derive.companies(spark, sf_dir).filter("company_id = 45").join(contacts(spark, sf_dir).select("company_id", "email", "kind"), "company_id", "left")
    kinds = F.array_position(F.array(F.lit("generic"), F.lit("personal")), F.col("kind"))
    return rows.orderBy(kinds, F.lower("email")).select("company_id", "name", "city", "email", "kind")


def cluster_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the clusters with several, first seen first, as structs with the kind of their source."""
    rows = members(spark, sf_dir).select("cluster_id", "external_id", "first_seen", "source_kind")
    order = F.array_sort(F.collect_list(F.struct("first_seen", "external_id", "source_kind")))
    per = rows.groupBy("cluster_id").agg(order.alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a cluster has at most a few postings of each source
    return per.select("cluster_id", F.array_join(F.transform("m", lambda m: F.concat_ws(":", m["external_id"].cast("string"), m["source_kind"])), "|").alias("members"))


def application_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three events of each application."""
    newest = Window.partitionBy("application_id").orderBy(F.col("occurred_at").desc(), F.col("event_id").desc())
    rows = derive.application_events(spark, sf_dir).withColumn("n", F.row_number().over(newest)).filter("n <= 3")
    return rows.select("application_id", "event_id", "to_status", F.col("n").cast("long").alias("n"))


def pending_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest pending spontaneous application of each company."""
    rows = applications(spark, sf_dir).filter("kind = 'spontaneous' and status = 'to_apply'")
    newest = Window.partitionBy("company_id").orderBy(F.col("created_at").desc(), F.col("application_id").desc())
    return rows.withColumn("n", F.row_number().over(newest)).filter("n = 1").select("company_id", "application_id")


def pending_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue for scoring: passed, open clusters without a score, first seen last first, five hundred of them."""
    heads = canonical(members(spark, sf_dir)).filter("status = 'passed' and closed_at is null")
    rows = heads.join(score_cache(spark, sf_dir).select("content_hash"), "content_hash", "left_anti")
    return rows.orderBy(F.col("first_seen").desc(), "cluster_id").limit(500).select("cluster_id", day("first_seen").alias("first_seen"))


def score_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by what scoring does with them: a cached result, a failure that is final, another try, or a first one."""
    rows = derive.jobs(spark, sf_dir).filter("status = 'passed'").select("content_hash").distinct()
    rows = rows.join(score_cache(spark, sf_dir).select("content_hash", "score_state", "attempts"), "content_hash", "left")
    outcome = (
        F.when(F.col("score_state") == "ok", "cached")
        .when((F.col("score_state") == "failed") & (F.col("attempts") >= 2), "failed")
        .when(F.col("score_state") == "failed", "deferred")
        .otherwise("scored")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def usage_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of the thirty days before the last posting was first seen."""
    rows = score_cache(spark, sf_dir).join(derive.jobs(spark, sf_dir).groupBy("content_hash").agg(F.max("first_seen").alias("at")), "content_hash")
    rows = rows.filter(F.col("at") > F.lit("2024-03-31").cast("timestamp") - F.make_dt_interval(F.lit(30)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return rows.agg(F.count(F.lit(1)).alias("calls"), *sums)


def rejected_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rejected postings of a screen."""
    rows = derive.jobs(spark, sf_dir).filter("status = 'rejected'").orderBy(F.col("rule_score").desc(), "external_id").limit(100)
    return rows.select("external_id", "rule_score")


NAMES = (
    "act_triage act_merge act_rescue act_apply act_status act_notes act_find_or_create act_companies act_contacts act_sources act_drafts act_letters "
    "assigned merge_candidates ingest_step refresh_set ingest_twice run_outcomes cursors refiltered scores_accumulated contacts_added touched sources_deleted contacts_erased "
    "heartbeat backups_kept write_batches companies_filled orphans_attached company_search company_detail cluster_detail application_log pending_drafts "
    "pending_scores score_outcomes usage_recent rejected_page"
)
