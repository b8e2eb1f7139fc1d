"""What users do to the state, as sets of requests: tables and requests in, tables out.

A request table has one row per key; requests for unknown keys change nothing. Joins are equi-joins on the key; Spark
broadcasts the requests where they are few. ``as_of`` is the time of the requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import numbers, times, web
from harrow.functions.text import normalize_company
from harrow.sources.registry import clamped_interval

#: Columns of applications and of their log.
APPLICATION = {
    "application_id": "string", "kind": "string", "cluster_id": "long", "company_id": "long", "contact_id": "long", "status": "string",
    "applied_at": "timestamp", "next_action": "date", "channel": "string", "draft_subject": "string", "draft_body": "string", "notes": "string",
    "external_url": "string", "external_title": "string", "external_company": "string", "created_at": "timestamp",
}
EVENT = {"application_id": "string", "type": "string", "from_status": "string", "to_status": "string", "note": "string", "occurred_at": "timestamp"}


def shaped(rows: DataFrame, columns: dict[str, str], **values: Column) -> DataFrame:
    """Rows of a table's columns; what is not given is null."""
    return rows.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``patch`` in place of theirs wherever the key is in it."""
    names = [c for c in patch.columns if c != key]
    change = patch.select(F.col(key), F.struct(*names).alias("_patch"))
    out = rows.join(change, key, "left")
    return out.select(*[F.when(F.col("_patch").isNotNull(), F.col(f"_patch.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


def log(rows: DataFrame, kind: Column | str, as_of: Column, **values: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return shaped(rows, EVENT, application_id=F.col("application_id"), type=kind, occurred_at=as_of, **values)


# ---- clusters --------------------------------------------------------------------------------------


def open_applications(clusters: DataFrame, apps: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, applications, events) after requests (cluster_id, status) for clusters that have no application yet."""
    free = requests.join(clusters.select("cluster_id", "company_id"), "cluster_id").join(apps.select("cluster_id"), "cluster_id", "left_anti")
    applied = F.col("status") != "to_apply"
    new = shaped(
        free, APPLICATION,
        application_id=F.concat(F.lit("cluster:"), F.col("cluster_id").cast("string")), kind=F.lit("job"), cluster_id=F.col("cluster_id"),
        company_id=F.col("company_id"), status=F.col("status"), applied_at=F.when(applied, as_of), next_action=times.next_action(F.col("status"), F.to_date(as_of)),
        channel=F.lit("ats"), notes=F.lit(""), created_at=as_of,
    )
    triage = free.select("cluster_id", F.when(applied, "applied").otherwise("interested").alias("triage"), as_of.alias("triaged_at"))
    return patched(clusters, triage, "cluster_id"), apps.unionByName(new), log(new, "status_change", as_of, to_status=F.col("status"))


def set_triage(clusters: DataFrame, apps: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, applications, events) after requests (cluster_id, triage); ``applied`` opens an application if there is none."""
    clusters = patched(clusters, requests.select("cluster_id", "triage", as_of.alias("triaged_at")), "cluster_id")
    wanted = requests.filter("triage = 'applied'").select("cluster_id", F.lit("applied").alias("status"))
    return open_applications(clusters, apps, wanted, as_of)


def rescue(jobs: DataFrame, clusters: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, clusters): all postings of the clusters pass whatever the rules say, and the clusters are new again."""
    ids = wanted.select("cluster_id").distinct()
    jobs = patched(jobs, ids.select("cluster_id", F.lit(True).alias("forced_pass"), F.lit("passed").alias("status")), "cluster_id")
    return jobs, patched(clusters, ids.select("cluster_id", F.lit("new").alias("triage")), "cluster_id")


# ---- applications ----------------------------------------------------------------------------------


def external_applications(apps: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(applications, events) with requests (url, title, company, status, channel, notes); a null status is ``applied``."""
    status = F.coalesce("status", F.lit("applied"))
    new = shaped(
        requests, APPLICATION,
        application_id=F.concat(F.lit("external:"), F.sha2("url", 256)), kind=F.lit("job"), external_url=F.col("url"), external_title=F.col("title"),
        external_company=F.col("company"), status=status, applied_at=F.when(status != "to_apply", as_of), next_action=times.next_action(status, F.to_date(as_of)),
        channel=F.col("channel"), notes=F.coalesce("notes", F.lit("")), created_at=as_of,
    )
    return apps.unionByName(new), log(new, "status_change", as_of, to_status=F.col("status"))


def update_status(apps: DataFrame, clusters: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applications, clusters, events) after requests (application_id, to_status, note, at).

    A request for the state that an application has and without a note changes nothing.
    """
    now = apps.select("application_id", "status", "applied_at", "cluster_id").join(requests, "application_id")
    now = now.filter((F.col("status") != F.col("to_status")) | F.col("note").isNotNull())
    applied = F.coalesce("applied_at", F.when(F.col("to_status") != "to_apply", F.col("at")))
    change = now.select(
        "application_id", F.col("to_status").alias("status"), applied.alias("applied_at"), times.next_action(F.col("to_status"), F.to_date("at")).alias("next_action")
    )
    kind = F.when(F.col("to_status") == "followed_up", "follow_up").when(F.col("to_status") == "interview", "interview_scheduled").otherwise("status_change")
    events = log(now, kind, F.col("at"), from_status=F.col("status"), to_status=F.col("to_status"), note=F.col("note"))
    reached = now.filter((F.col("to_status") != "to_apply") & F.col("cluster_id").isNotNull()).select("cluster_id").distinct()
    return patched(apps, change, "application_id"), patched(clusters, reached.withColumn("triage", F.lit("applied")), "cluster_id"), events


def add_notes(apps: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(applications, events) with requests (application_id, note) under the day's stamp, below earlier notes."""
    rows = apps.select("application_id", "notes").join(requests, "application_id")
    line = F.concat(F.lit("["), F.date_format(as_of, "dd/MM/yyyy"), F.lit("] "), F.col("note"))
    notes = F.when(F.coalesce("notes", F.lit("")) == "", line).otherwise(F.concat("notes", F.lit("\n"), line))
    return patched(apps, rows.select("application_id", notes.alias("notes")), "application_id"), log(rows, "note", as_of, note=F.col("note"))


def set_next_action(apps: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (application_id, next_action); a null date clears it."""
    return patched(apps, requests.select("application_id", "next_action"), "application_id")


def delete_applications(apps: DataFrame, clusters: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, clusters) without the applications; their clusters are interesting again."""
    lost = apps.join(gone.select("application_id"), "application_id", "left_semi").filter("cluster_id is not null").select("cluster_id").distinct()
    return apps.join(gone.select("application_id"), "application_id", "left_anti"), patched(clusters, lost.withColumn("triage", F.lit("interested")), "cluster_id")


# ---- companies, contacts, sources ------------------------------------------------------------------


def update_companies(companies: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (company_id, name, website, outreach): null leaves a column; an empty website clears it. Norm and domain follow."""
    old = companies.select("company_id", *[F.col(c).alias(f"_{c}") for c in ("name", "website", "domain", "outreach")])
    rows = requests.join(old, "company_id")
    name = F.coalesce("name", "_name")
    host = F.when(F.col("website").isNull(), F.col("_domain")).otherwise(web.domain(F.nullif(F.col("website"), F.lit(""))))
    site = F.when(F.col("website").isNull(), F.col("_website")).otherwise(F.concat(F.lit("https://"), host))
    patch = rows.select(
        "company_id", name.alias("name"), normalize_company(name).alias("name_norm"), host.alias("domain"), site.alias("website"), F.coalesce("outreach", "_outreach").alias("outreach")
    )
    return patched(companies, patch, "company_id")


def promote(companies: DataFrame, clusters: DataFrame, wanted: DataFrame) -> DataFrame:
    """The companies of clusters become targets; those further on stay where they are."""
    ids = clusters.join(wanted.select("cluster_id"), "cluster_id", "left_semi").filter("company_id is not null").select("company_id").distinct()
    marked = companies.join(ids.withColumn("_wanted", F.lit(True)), "company_id", "left")
    outreach = F.when(F.col("_wanted") & (F.col("outreach") == "none"), "to_contact").otherwise(F.col("outreach"))
    return marked.withColumn("outreach", outreach).drop("_wanted")


def add_contacts(contacts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (contact_id, company_id, email, kind, label, note); an address that is there already, or again, is ignored."""
    basis = F.when(F.col("kind") == "generic", "b2b_legitimate_interest").otherwise("legitimate_interest_candidate")
    rows = requests.select(
        "contact_id", "company_id", F.lower("email").alias("email"), "kind", F.nullif("label", F.lit("")).alias("label"),
        F.concat(F.lit("manual:"), F.col("note")).alias("source"), basis.alias("consent_basis"),
    )
    rest = [c for c in rows.columns if c != "email"]
    first = rows.filter("email is not null").groupBy("email").agg(F.min(F.struct(*rest)).alias("v")).select("email", "v.*")
    alive = contacts.filter("deleted_at is null").select("email")
    return contacts.unionByName(first.join(alive, "email", "left_anti"), allowMissingColumns=True)


def mark_contacts(contacts: DataFrame, wanted: DataFrame, column: str, as_of: Column) -> DataFrame:
    """``column`` is deleted_at or opted_out_at. An id that is wanted twice, or that several contacts have, marks each of them once."""
    return patched(contacts, wanted.select("contact_id").distinct().select("contact_id", as_of.alias(column)), "contact_id")


def active_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.filter("deleted_at is null")


def purge_deleted(contacts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Contacts deleted for more than ``days`` days lose what identifies them."""
    old = F.coalesce(F.col("deleted_at") < times.days_before(as_of, days), F.lit(False))
    return contacts.withColumns({c: F.when(~old, F.col(c)) for c in ("email", "label")})


def enable_sources(sources: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Requests (source_id, enabled); a source that is enabled starts without failures and is due."""
    old = sources.select("source_id", F.col("failures").alias("_failures"), F.col("next_run").alias("_next"))
    on = F.col("enabled")
    rows = requests.join(old, "source_id")
    patch = rows.select("source_id", "enabled", F.when(on, 0).otherwise(F.col("_failures")).alias("failures"), F.when(on, as_of).otherwise(F.col("_next")).alias("next_run"))
    return patched(sources, patch, "source_id")


def set_intervals(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (source_id, minutes); no interval is below what the kind's vendor asks for."""
    rows = sources.select("source_id", "kind").join(requests, "source_id")
    patch = rows.select("source_id", clamped_interval(F.col("kind"), F.round("minutes").cast("int")).alias("interval_minutes"))
    return patched(sources, patch, "source_id")


# ---- outreach --------------------------------------------------------------------------------------


def save_drafts(apps: DataFrame, companies: DataFrame, contacts: DataFrame, requests: DataFrame, notice: str, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applications, companies, events) after requests (company_id, contact_id, subject, body).

    The company's newest pending spontaneous application takes the draft, or a new one does. A draft to a person says
    where the address is from.
    """
    who = contacts.select("contact_id", F.col("kind").alias("_kind"), F.col("source").alias("_source"))
    rows = requests.join(who, "contact_id")
    personal = F.concat(F.trim("body"), F.lit("\n\n"), web.privacy_notice(notice, F.coalesce("_source", F.lit(""))))
    rows = rows.withColumn("body", F.when(F.col("_kind") == "personal", personal).otherwise(F.trim("body")))
    open_ = apps.filter("kind = 'spontaneous' and status = 'to_apply'").groupBy("company_id").agg(F.max_by("application_id", F.struct("created_at", "application_id")).alias("_app"))
    rows = rows.join(open_, "company_id", "left")
    found = rows.filter("_app is not null").select(F.col("_app").alias("application_id"), "contact_id", F.col("subject").alias("draft_subject"), F.col("body").alias("draft_body"), F.lit("email").alias("channel"))
    new = shaped(
        rows.filter("_app is null"), APPLICATION,
        application_id=F.concat(F.lit("company:"), F.col("company_id").cast("string"), F.lit(":"), F.unix_millis(as_of).cast("string")), kind=F.lit("spontaneous"),
        company_id=F.col("company_id"), contact_id=F.col("contact_id"), status=F.lit("to_apply"), channel=F.lit("email"), draft_subject=F.col("subject"),
        draft_body=F.col("body"), notes=F.lit(""), created_at=as_of,
    )
    targets = new.select("company_id").distinct().join(companies.filter("outreach = 'none'").select("company_id"), "company_id")
    events = log(new, "status_change", as_of, to_status=F.lit("to_apply"), note=F.lit("Brouillon généré"))
    return patched(apps, found, "application_id").unionByName(new), patched(companies, targets.withColumn("outreach", F.lit("to_contact")), "company_id"), events


def mark_sent(apps: DataFrame, contacts: DataFrame, companies: DataFrame, sent: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(applications, contacts, companies, events) after spontaneous applications (application_id) were sent."""
    rows = apps.join(sent.select("application_id"), "application_id", "left_semi").filter("kind = 'spontaneous'")
    change = rows.select("application_id", F.lit("applied").alias("status"), as_of.alias("applied_at"), times.next_action(F.lit("applied"), F.to_date(as_of)).alias("next_action"))
    told = rows.select("contact_id").distinct().join(contacts.filter("kind = 'personal'").select("contact_id"), "contact_id")
    reached = rows.filter("company_id is not null").select("company_id").distinct().withColumn("outreach", F.lit("contacted"))
    return (
        patched(apps, change, "application_id"),
        patched(contacts, told.withColumn("info_notice_sent_at", as_of), "contact_id"),
        patched(companies, reached, "company_id"),
        log(rows, "sent", as_of, from_status=F.col("status"), to_status=F.lit("applied")),
    )


def save_letters(clusters: DataFrame, apps: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, applications, events) after letters (cluster_id, subject, body): drafts on the clusters' applications, opened where missing."""
    wanted = requests.select("cluster_id", F.lit("to_apply").alias("status"))
    clusters, apps, events = open_applications(clusters, apps, wanted, as_of)
    rows = apps.select("application_id", "cluster_id").join(requests, "cluster_id")
    drafts = rows.select("application_id", F.trim("subject").alias("draft_subject"), F.trim("body").alias("draft_body"))
    return clusters, patched(apps, drafts, "application_id"), events.unionByName(log(rows, "note", as_of, note=F.lit("Lettre de motivation générée")))
