"""Each vendor's payloads over the documents, read back as postings; boards, seeds and capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import keys, web
from harrow.operators.snapshot import spread
from harrow.session import table
from harrow.sources import boards, capture, feeds, quarantine, registry
from harrow.sources.build import build

from . import derive
from .derive import pick
from .read_models import day, text

PAGE = 50
#: What vendors' codes are chosen from.
WORKPLACES = ("Remote", "hybrid", "On-site", "", "remote")
COMMITMENTS = ("CDI", "CDD", "Permanent", "Internship", "Contract", "Freelance", "")
LEVELS = ("senior", "mid_senior_level", "entry_level", "director", "associate", "other")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the payloads are made of; markup characters of the texts become blanks."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.floor(F.col("doc_id") / PAGE).alias("page"), "text")
    # dealt by page, so that a page's payload is made, read and built in one task without another shuffle
    rows = spread(rows, f"{sf_dir}/documents.parquet", "source_id", "page").select(
        "id", "source_id", "page", F.translate("text", "<>&", "   ").alias("t"), derive.digits(F.col("text")).alias("k")
    )
    s, k = F.regexp_extract("t", r"^[^.\n]*", 0), F.col("k")
    return rows.withColumns(
        {
            "name": F.concat(s, F.lit(" "), pick(derive.TITLES, F.length(s))),
            "place": F.nullif(pick(derive.LOCATIONS, k), F.lit("")),
            "phrase": pick(derive.CONTRACTS, F.floor(k / 2)),
            "policy": F.nullif(pick(derive.REMOTES, F.floor(k / 3)), F.lit("")),
            "pay": F.nullif(pick(derive.SALARIES, F.floor(k / 7)), F.lit("")),
            "low": (30_000 + k % 40_000).cast("double"),
            "on": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")),
            "url": F.concat(F.lit("https://board.example.com/"), F.col("id").cast("string")),
        }
    )


def bodies(rows: DataFrame, item: Column, field: str | None) -> DataFrame:
    """One JSON response for each page of a source."""
    listed = F.collect_list(item)
    body = F.to_json(F.struct(listed.alias(field)) if field else listed)
    pages = rows.groupBy("source_id", "page").agg(body.alias("body"))
    return pages.withColumns({"company": F.concat(F.lit("Company of "), F.col("source_id")), "slug": F.col("source_id")})


def shown(drafts: DataFrame) -> DataFrame:
    rows = build(drafts)
    return rows.filter(F.size("failed") == 0).select(
        "source_id", "external_id", "url", "title", "company_name", "location_raw", "country_code", "remote_policy", "remote_scope", "contract_type", "seniority",
        F.col("salary.min").cast("double").alias("low"), F.col("salary.max").cast("double").alias("high"), F.sha2("description", 256).alias("description"),
        text(F.col("tags")).alias("tags"), day("published_at").alias("published"),
    )


def _html(*paragraphs: Column) -> Column:
    return F.concat(*[F.concat(F.lit("<p>"), p, F.lit("</p>")) for p in paragraphs])


def _iso(day_column: str = "on") -> Column:
    return F.concat(F.col(day_column).cast("string"), F.lit("T08:30:00Z"))


def greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = _html(F.col("t"), F.concat("phrase", F.lit(" &amp; more")))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        markup = F.replace(markup, F.lit(plain), F.lit(escaped))
    meta = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    item = F.struct(
        "id", F.col("name").alias("title"), F.when(F.col("k") % 4 != 0, "Own Name").alias("company_name"), F.col("url").alias("absolute_url"),
        F.struct(F.col("place").alias("name")).alias("location"), markup.alias("content"), _iso().alias("first_published"),
        F.array(meta("Workplace type", F.col("policy")), meta("Salary range", F.col("pay"))).alias("metadata"),
        F.array(F.struct(F.lit("Engineering").alias("name")), F.struct(F.col("source_id").alias("name"))).alias("departments"),
    )
    return shown(feeds.greenhouse(bodies(base(spark, sf_dir), item, "jobs")))


def lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    item = F.struct(
        F.concat(F.lit("lv-"), F.col("id").cast("string")).alias("id"), F.col("name").alias("text"), F.col("url").alias("hostedUrl"),
        (F.unix_millis(F.col("on").cast("timestamp")) + 1000).alias("createdAt"), F.lit("FR").alias("country"), pick(WORKPLACES, k).alias("workplaceType"),
        F.when(k % 2 == 0, F.col("t")).alias("descriptionPlain"), _html(F.col("t")).alias("description"), F.col("policy").alias("additionalPlain"),
        F.array(F.struct(F.lit("You bring").alias("text"), F.concat(F.lit("<li>"), F.col("phrase"), F.lit("</li>")).alias("content"))).alias("lists"),
        F.struct(pick(COMMITMENTS, F.floor(k / 5)).alias("commitment"), F.col("place").alias("location"), F.lit("Data").alias("team"), F.lit("").alias("department")).alias("categories"),
        F.when(k % 3 != 0, F.struct(F.col("low").alias("min"), (F.col("low") + 5000).alias("max"), F.lit("EUR").alias("currency"), F.lit("per-year-salary").alias("interval"))).alias("salaryRange"),
    )
    return shown(feeds.lever(bodies(base(spark, sf_dir), item, None)))


def ashby(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    item = F.struct(
        F.concat(F.lit("as-"), F.col("id").cast("string")).alias("id"), F.col("name").alias("title"), F.lit("Tech").alias("department"), F.lit("Data").alias("team"),
        pick(("FullTime", "Intern", "Temporary", "Contract"), k).alias("employmentType"), F.col("place").alias("location"),
        F.array(F.struct(F.when(k % 5 == 0, "Lille, France").alias("location"))).alias("secondaryLocations"), _iso().alias("publishedAt"),
        (k % 10 != 0).alias("isListed"), (k % 6 == 0).alias("isRemote"), pick(("OnSite", "Hybrid", "", "Remote"), F.floor(k / 3)).alias("workplaceType"),
        F.struct(F.struct(pick(("France", "Germany", "", "Nowhere"), k).alias("addressCountry")).alias("postalAddress")).alias("address"),
        F.col("url").alias("jobUrl"), _html(F.col("t"), F.col("phrase")).alias("descriptionHtml"), F.struct(F.col("pay").alias("scrapeableCompensationSalarySummary")).alias("compensation"),
    )
    return shown(feeds.ashby(bodies(base(spark, sf_dir), item, "jobs")))


def smartrecruiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, and details for every second posting."""
    k, rows = F.col("k"), base(spark, sf_dir)
    name = F.concat(F.lit("sr-"), F.col("id").cast("string"))
    place = F.struct(F.lit("Lyon").alias("city"), pick(("fr", "de", "es"), k).alias("country"), (k % 5 == 0).alias("remote"), (k % 5 == 1).alias("hybrid"))
    item = F.struct(
        name.alias("id"), F.col("name"), _iso().alias("releasedDate"), F.struct(F.when(k % 2 == 0, "Listed Co").alias("name")).alias("company"), place.alias("location"),
        F.struct(pick(("permanent", "intern", "contract", "temporary"), k).alias("id")).alias("typeOfEmployment"), F.struct(pick(LEVELS, k).alias("id")).alias("experienceLevel"),
        F.struct(F.lit("Data").alias("label")).alias("department"),
    )
    section = lambda title, body: F.struct(F.lit(title).alias("title"), body.alias("text"))
    sections = F.struct(section("The job", _html(F.col("t"))).alias("jobDescription"), section("Extra", F.col("phrase")).alias("additionalInformation"))
    detail = F.to_json(F.struct(name.alias("id"), F.concat("url", F.lit("/apply")).alias("applyUrl"), F.col("url").alias("postingUrl"), F.struct(sections.alias("sections")).alias("jobAd")))
    details = rows.filter(F.col("id") % 2 == 0).select("source_id", detail.alias("body"))
    return shown(feeds.smartrecruiters(bodies(rows, item, "content"), details))


def recruitee(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    item = F.struct(
        "id", F.col("name").alias("title"), pick(("published", "draft", ""), k).alias("status"), _html(F.col("t")).alias("description"), _html(F.col("phrase")).alias("requirements"),
        F.col("place").alias("city"), pick(("FR", "DE"), k).alias("country_code"), (k % 2 == 0).alias("remote"), (k % 7 == 0).alias("hybrid"), (k % 3 == 0).alias("on_site"),
        pick(("fulltime_permanent", "freelance", "internship", "other"), F.floor(k / 2)).alias("employment_type_code"), pick(("experienced", "entry_level", "x"), k).alias("experience_code"),
        F.concat(F.col("on").cast("string"), F.lit(" 23:31:24 UTC")).alias("published_at"), F.col("url").alias("careers_url"), F.lit("Tech").alias("department"),
        F.array(F.lit("data"), F.lit("")).alias("tags"),
        F.struct(F.when(k % 4 != 0, F.col("low")).alias("min"), F.when(k % 8 != 0, F.col("low") + 9000).alias("max"), pick(("EUR", "USD", ""), k).alias("currency"), pick(("year", "month"), F.floor(k / 3)).alias("period")).alias("salary"),
    )
    return shown(feeds.recruitee(bodies(base(spark, sf_dir), item, "offers")))


def teamtailor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RSS feed with a namespace; a guid with and without attributes."""
    k, tag = F.col("k"), lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    guid = F.when(k % 2 == 0, F.concat(F.lit('<guid isPermaLink="false">tt-'), F.col("id").cast("string"), F.lit("</guid>"))).otherwise(
        F.when(k % 4 == 1, F.lit("")).otherwise(tag("guid", F.concat(F.lit("tt-"), F.col("id").cast("string"))))
    )
    places = tag("tt:locations", F.concat(tag("tt:location", F.concat(tag("tt:name", F.coalesce("place", F.lit(""))), tag("tt:country", F.lit("France")))), tag("tt:location", tag("tt:city", F.lit("Nice")))))
    markup = F.concat(F.lit("&lt;p&gt;"), F.col("t"), F.lit("&lt;/p&gt;&lt;p&gt;"), F.col("phrase"), F.lit("&lt;/p&gt;"))
    sent = F.concat(F.date_format("on", "d MMM yyyy"), F.lit(" 10:00:00 +0200"))
    item = tag("item", F.concat(
        tag("title", F.col("name")), tag("link", F.col("url")), guid, tag("description", markup), tag("pubDate", F.concat(F.lit("Mon, "), sent)),
        tag("remoteStatus", pick(("fully", "hybrid", "none", "temporary"), k)), tag("tt:department", F.lit("Tech")), places,
    ))
    rows = base(spark, sf_dir).groupBy("source_id", "page").agg(F.array_join(F.collect_list(item), "\n").alias("items"))
    body = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:tt="https://example.com/ns"><channel><title>All</title>'), F.col("items"), F.lit("</channel></rss>"))
    return shown(feeds.teamtailor(rows.select("source_id", body.alias("body"), F.concat(F.lit("Company of "), F.col("source_id")).alias("company"), F.col("source_id").alias("slug"))))


def france_travail(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    item = F.struct(
        F.concat(F.lit("ft"), F.col("id").cast("string")).alias("id"), F.col("name").alias("intitule"), F.col("t").alias("description"), _iso().alias("dateCreation"),
        F.struct(pick(("31 - TOULOUSE", "75 - Paris", ""), k).alias("libelle")).alias("lieuTravail"), F.struct(F.nullif(pick(derive.COMPANIES, k), F.lit("")).alias("nom")).alias("entreprise"),
        pick(("CDI", "MIS", "LIB", "XXX"), k).alias("typeContrat"), (k % 9 == 0).alias("alternance"), pick(("D", "E", "S"), F.floor(k / 2)).alias("experienceExige"),
        pick(("6 ans", "2 ans", "Débutant accepté"), F.floor(k / 2)).alias("experienceLibelle"), F.struct(F.col("pay").alias("libelle")).alias("salaire"),
        F.lit("Études").alias("romeLibelle"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("https://candidat.francetravail.fr/x/"), F.col("id").cast("string"))).otherwise(F.col("url")).alias("urlOrigine")).alias("origineOffre"),
    )
    return shown(feeds.france_travail(bodies(base(spark, sf_dir), item, "resultats")))


def jobicy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    item = F.struct(
        "id", "url", F.col("name").alias("jobTitle"), F.lit("Remote Co").alias("companyName"), F.array(F.lit("Engineering")).alias("jobIndustry"),
        F.array(pick(("Full-Time", "Freelance", "Internship", "permanent"), k)).alias("jobType"), pick(("France", "Europe, EMEA", "Anywhere", "USA", ""), k).alias("jobGeo"),
        pick(("Senior", "Midweight", "Any"), k).alias("jobLevel"), F.when(k % 3 != 0, _html(F.col("t"))).alias("jobDescription"), F.col("phrase").alias("jobExcerpt"),
        F.concat(F.col("on").cast("string"), F.lit(" 11:12:13")).alias("pubDate"), F.col("low").alias("salaryMin"), F.when(k % 2 == 0, F.col("low") + 4000).alias("salaryMax"),
        pick(("EUR", "USD"), F.floor(k / 3)).alias("salaryCurrency"), F.lit("yearly").alias("salaryPeriod"),
    )
    return shown(feeds.jobicy(bodies(base(spark, sf_dir), item, "jobs")))


# ---- boards, seeds, capture, windows ---------------------------------------------------------------

HOSTS = (
    "https://boards.greenhouse.io/{}/jobs/1", "https://boards.greenhouse.io/embed/job_board?for={}", "https://boards-api.greenhouse.io/v1/boards/{}/jobs",
    "https://jobs.eu.lever.co/{}/x", "https://jobs.ashbyhq.com/{}", "https://{}.recruitee.com/o/1", "https://{}.teamtailor.com/jobs", "https://www.recruitee.com/{}",
    "https://careers.smartrecruiters.com/{}", "https://jobs.lever.co/-{}", "https://example.org/{}",
)


def board_url(index: Column, slug: Column) -> Column:
    return F.replace(pick(HOSTS, index), F.lit("{}"), slug)


def board_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of made-up addresses, with their configuration."""
    slug = F.concat(F.lit("Co"), F.col("s_suppkey").cast("string"))
    found = table(spark, sf_dir, "supplier").select("s_suppkey", boards.board_of(board_url(F.col("s_suppkey"), slug)).alias("b")).filter("b is not null")
    config = F.array_join(F.transform(F.array_sort(F.map_entries("b.config")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return found.select("s_suppkey", "b.kind", "b.slug", "b.source_id", config.alias("config"))


def page_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards that pages embed: made-up links in front of the page, or a vendor's name alone."""
    i = F.col("page_id")
    first, second = board_url(i, F.concat(F.lit("p"), i.cast("string"))), board_url(i + 4, F.concat(F.lit("P"), i.cast("string")))
    links = F.concat(F.lit('<a href="'), first, F.lit('">x</a><script src="'), second, F.lit('"></script>'))
    html = F.concat(F.when(i % 3 == 0, F.lit("powered by Teamtailor")).otherwise(links), F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(boards.boards_in(html, F.col("url"))).alias("b"))
    return rows.select("page_id", "b.source_id")


def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed file made of suppliers, one address each, against the sources that are known."""
    s = F.col("s_suppkey")
    address = F.struct(board_url(s, F.concat(F.lit("S"), (s % 40).cast("string"))).alias("url"), F.col("s_name").alias("company"))
    feed = F.struct(F.concat(F.lit("feed-"), (s % 7).cast("string")).alias("id"), F.lit("jobicy").alias("kind"), F.lit(None).cast("string").alias("label"))
    rows = table(spark, sf_dir, "supplier")
    # a seed file is one document by nature
    file = rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(address)).alias("boards"), F.array_distinct(F.array_sort(F.collect_list(feed))).alias("feeds"))).alias("value"))
    known = rows.filter("s_suppkey % 5 = 0").select(boards.board_of(board_url(s, F.concat(F.lit("S"), (s % 40).cast("string"))))["source_id"].alias("source_id"))
    return registry.seed(file, known.filter("source_id is not null")).select("source_id", "kind", "label")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed pages as captures: refused ones with their reasons, repeats of known ones, and new ones with their id."""
    pushes = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("A title | Site").alias("page_title"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    pushes = pushes.withColumn("url", F.when(F.col("page_id") % 13 == 0, F.lit("ftp://x")).otherwise(F.col("url")))
    pushes = pushes.withColumn("text", F.when(F.col("page_id") % 11 == 0, F.lit("short")).otherwise(F.col("text")))
    known = pushes.filter("page_id % 5 = 0").select(keys.capture_id(web.canonical_url(F.col("url"))).alias("external_id"))
    rows = capture.received(pushes, known, ["page_id"])
    return rows.select("page_id", "outcome", text(F.col("errors")).alias("errors"), "external_id", "title")


def window_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' month cut into windows that hold few enough items."""
    log = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"))
    total = log.count()
    rows = registry.half_windows(log, "at", F.lit("2024-01-01"), F.lit("2024-01-31"), max(total // 6, 1))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each source's items: every thirteenth has no title, and some pages arrive cut off."""
    item = F.struct("id", F.when(F.col("id") % 13 != 0, F.col("name")).alias("title"), F.col("url").alias("absolute_url"), F.col("t").alias("content"))
    pages = bodies(base(spark, sf_dir), item, "jobs")
    broken = F.when(F.col("page") % 7 == 3, F.left("body", F.length("body") - 3)).otherwise(F.col("body"))
    return quarantine.counts(quarantine.listing(pages.withColumn("body", broken), "greenhouse"))
