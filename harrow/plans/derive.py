"""Domain tables over the driver's tables, deterministic and without state.

The corpus has no postings, so each document becomes one: its text is the description, its first sentence and phrases
chosen by a digest of the text give title, company, location, contract, salary and policy, and its id gives the dates.
So documents with equal texts are postings with equal content.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import classify, keys
from harrow.functions.text import normalize_company, normalize_title
from harrow.operators.rules import evaluate
from harrow.operators.snapshot import spread, written
from harrow.session import table
from harrow.sources.build import build, drafted

AS_OF = datetime(2024, 4, 15)
PROMPT, MODEL = "v1", "model-a"

KINDS = ("greenhouse", "lever", "ashby", "smartrecruiters", "recruitee", "teamtailor", "france_travail", "jobicy", "capture")
COMPANIES = (
    "Alpha SAS", "Société Bêta", "Gamma Consulting", "Delta GmbH", "Epsilon Group", "Zêta Inc.", "Êta Ltd", "Theta S.A.", "Iota",
    "Kappa Holding", "Lambda Labs", "Mu & Nu", "Xi France", "Omicron BV", "Pi", "Rho Data", "Sigma SARL", "Tau", "Upsilon Co", "",
)
SUFFIXES = ("", " unit", " senior")
TITLES = (
    "Python Developer (H/F)", "Data Engineer - CDI", "Front End Developer React", "Développeuse PHP", "Sales Manager", "Lead Java Engineer",
    "Stage ingénieur Spark", "Junior Back End developer", "Head of Data", "Full stack TypeScript engineer - full remote", "WordPress Designer",
)
LOCATIONS = ("Paris, France", "Lyon, France", "Remote, Europe", "Berlin, Germany", "Madrid, Spain", "Worldwide", "US only", "Nantes", "", "Toulouse, FR", "London, United Kingdom", "Brussels, Belgium", "CH")
CONTRACTS = ("Contrat CDI", "CDD de 6 mois", "Permanent position", "", "Mission de 6 mois, TJM 400", "Alternance possible", "CDI", "temporary contract")
REMOTES = (
    "Full remote", "Hybride, 2 jours de télétravail", "Sur site uniquement", "", "Remote first", "2 days a week in the office", "Full remote or hybrid",
    "On site only", "Full remote, no remote work abroad", "100 % télétravail", "US only", "Remote within the CET zone",
)
SALARIES = ("45k - 55k EUR", "", "45 000 - 60 000 EUR", "60k", "3000 par mois", "52.000 to 58.000", "400 daily", "competitive", "48,5k gross", "38000")
EXTRAS = ("Docker and Kafka", "5 years of experience", "2 ans minimum d experience, Postgres", "1 year experience", "", "Python, Spark", "astreinte", "Write to jobs [at] alpha.example.com")

#: Robots files that sites may have.
ROBOTS = (
    "User-agent: *\nDisallow: /a\nAllow: /a/b", "User-agent: JobBot\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow:", "# none", "User-agent: *\nDisallow: /\nAllow: /p # some\nSitemap: x",
    "User-agent: jobbot\nAllow: /\nUser-agent: *\nDisallow: /",
)

def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def digits(text: Column) -> Column:
    """A number below 2**32 from the text's digest."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draft per document, with ``id``, ``source_id`` and ``source_kind``."""
    rows = spread(table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet", "doc_id", "text").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_id"),
        pick(KINDS, F.substr("source", F.lit(4)).cast("int")).alias("source_kind"),
        F.regexp_extract("text", r"^[^.\n]*", 0).alias("s"),
        "text",
        digits(F.col("text")).alias("k"),
    )
    n, k = F.length("s"), F.col("k")
    phrases = [pick(CONTRACTS, F.floor(k / 2)), pick(REMOTES, F.floor(k / 3)), pick(EXTRAS, F.floor(k / 5))]
    return drafted(
        rows,
        ("id", "source_id", "source_kind"),
        external_id=F.col("id"),
        url=F.concat(F.lit("https://jobs.example.com/"), F.col("id").cast("string")),
        title=F.concat("s", pick(SUFFIXES, k), F.lit(" "), pick(TITLES, n)),
        company_name=pick(COMPANIES, n),
        location_raw=pick(LOCATIONS, k),
        salary_raw=pick(SALARIES, F.floor(k / 7)),
        description=F.concat_ws("\n", "text", *phrases),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of postings as ingestion leaves it: normalised, keyed and judged; pushed ones are advisory."""
    return written(spark, sf_dir, "jobs", lambda: ingested(drafts(spark, sf_dir)))


def ingested(rows: DataFrame) -> DataFrame:
    """Drafts -> postings with keys, dates and verdicts."""
    i = F.col("id")
    first = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((i % 90).cast("int"))
    rows = evaluate(build(rows), advisory=F.col("source_kind") == "capture").withColumns(
        {
            "external_id": i,
            "first_seen": first,
            "last_seen": first + F.make_dt_interval((i % 40).cast("int")),
            "title_norm": normalize_title(F.col("title")),
            "company_norm": normalize_company(F.col("company_name")),
        }
    )
    rows = rows.withColumns(
        {
            "closed_at": F.when(i % 11 == 0, F.col("last_seen")),
            "content_hash": keys.content_hash(F.col("title_norm"), F.col("company_norm"), F.col("description")),
            "dedup_key": F.coalesce(
                keys.dedup_key(F.col("company_norm"), F.col("title_norm")), keys.anonymous_key(F.col("source_id"), F.col("external_id"))
            ),
        }
    )
    return rows.drop("id", "failed")


def scores(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The score cache by (content_hash, prompt_version, model); of equal keys the one of the largest id."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "external_id")
    i, quality, toxic = F.col("external_id"), F.col("quality"), F.col("toxic")
    cache = rows.select("external_id", "content_hash").join(labels, "external_id")
    cache = cache.select(
        "content_hash",
        F.struct(
            i,
            (40 + 50 * quality - 30 * toxic + i % 10).cast("int").alias("score"),
            F.when(i % 17 == 0, "failed").otherwise("ok").alias("score_state"),
            F.when(toxic == 1, "hybrid_or_onsite").when(i % 13 == 0, "remote_but_geo_incompatible").when(i % 3 == 0, "full_remote_france_ok").alias("remote_verdict"),
            F.when((quality == 0) & (i % 2 == 0), "not_cdi").when(i % 4 == 0, "cdi").alias("contract_verdict"),
            (3000 + i % 1000).alias("input_tokens"),
            (200 + i % 100).alias("output_tokens"),
            (i % 3).cast("int").alias("attempts"),
        ).alias("v"),
    )
    cache = cache.groupBy("content_hash").agg(F.max("v").alias("v")).select("content_hash", "v.*").drop("external_id")
    return cache.withColumns({"prompt_version": F.lit(PROMPT), "model": F.lit(MODEL)})


def clusters(rows: DataFrame) -> DataFrame:
    """Adds ``cluster_id`` (the smallest id with the same key) to postings, and the cluster's ``triage``.

    The keys are combined before they are shuffled; the join is broadcast if they are few and split where a key is hot.
    """
    ids = rows.groupBy("dedup_key").agg(F.min("external_id").alias("cluster_id"))
    triage = pick(("new", "new", "dismissed", "interested", "new", "applied"), F.col("cluster_id"))
    return rows.join(ids, "dedup_key").withColumn("triage", triage)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies; market segments stand for outreach states."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    states = {"AUTOMOBILE": "none", "BUILDING": "to_contact", "FURNITURE": "contacted", "HOUSEHOLD": "replied", "MACHINERY": "closed"}
    return rows.select(
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("name"),
        normalize_company(F.col("c_name")).alias("name_norm"),
        F.col("n_name").alias("city"),
        F.lpad((F.col("c_custkey") * 7919 % 1_000_000_000).cast("string"), 9, "0").alias("siren"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.com")).alias("domain"),
        F.coalesce(classify.label(F.col("c_mktsegment"), {k.lower(): v for k, v in states.items()}), F.lit("none")).alias("outreach"),
        F.col("c_acctbal").alias("balance"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources, with failures and intervals from their keys."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(pick(KINDS, k), F.lit(":"), k.cast("string")).alias("source_id"),
        pick(KINDS, k).alias("kind"),
        F.col("s_name").alias("label"),
        k.alias("company_id"),
        (k % 7 != 0).alias("enabled"),
        pick(("60", "180", "360", "720"), k).cast("int").alias("interval_minutes"),
        F.when(F.col("s_acctbal") < 0, (k % 5 + 1).cast("int")).otherwise(0).alias("failures"),
        (F.to_timestamp(F.lit("2024-04-14")) + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))).alias("last_run"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of sources."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("source_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "partial").otherwise("running").alias("status"),
        (k % 50).alias("fetched"),
        (k % 7).alias("created"),
        (k % 3).alias("failed_items"),
    )


STATUS = {"signup": "to_apply", "view": "applied", "click": "followed_up", "purchase": "interview", "error": "rejected"}


def application_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the status log of applications: one application per user."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("application_id"),
        classify.label(F.col("event_type"), STATUS).alias("to_status"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        "props",
        "value",
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state of each application: that of its latest event."""
    log = application_events(spark, sf_dir)
    last = log.groupBy("application_id").agg(F.max(F.struct("occurred_at", "event_id", "to_status")).alias("last"))
    return last.select(
        "application_id",
        F.col("last.to_status").alias("status"),
        F.col("last.occurred_at").alias("updated_at"),
        F.when(F.col("application_id") % 3 != 0, F.col("application_id")).alias("cluster_id"),
        F.concat(F.lit("External role "), F.col("application_id").cast("string")).alias("external_title"),
    )
