"""Queries that show the column functions on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import classify, keys, numbers, text, times, web
from harrow.functions.text import fold, html_to_text, normalize_company, normalize_title
from harrow.session import table
from harrow.sources.boards import board_of

from . import derive


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["contract_type", "seniority", "remote_policy", "remote_scope", "country_code"]
    return derive.jobs(spark, sf_dir).select("external_id", *names)


def contract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = derive.digits(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(derive.pick(derive.CONTRACTS, F.floor(k / 2)).alias("contract_text"))
    return rows.groupBy("contract_text").agg(F.count(F.lit(1)).alias("n")).select(
        "contract_text", classify.contract_from_label(F.col("contract_text")).alias("label"), "n"
    )


def salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("salary")
    rows = derive.jobs(spark, sf_dir)
    return rows.select("external_id", s["min"].cast("double").alias("low"), s["max"].cast("double").alias("high"), numbers.format_salary(s["min"], s["max"]).alias("shown"))


def folded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded"))


def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.jobs(spark, sf_dir)
    return rows.select("external_id", F.col("title_norm"), normalize_title(F.concat("title", F.lit(" - CDI"))).alias("with_noise"))


def normalized_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), derive.pick(derive.COMPANIES, F.col("c_custkey"))).alias("name"))
    return names.select("c_custkey", normalize_company(F.col("name")).alias("name_norm"))


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(web.links(F.col("html"))).alias("href"))
    return pages.select("page_id", web.resolve(F.col("href"), F.col("url")).alias("link"))


def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(web.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_url(F.col("url")).alias("url"))


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each key; at most six pages of a host are visited."""
    from pyspark.sql.window import Window

    pages = table(spark, sf_dir, "pages").select("page_id", web.page_key(F.col("url")).alias("key"), web.domain(F.col("url")).alias("host"))
    firsts = pages.groupBy("key", "host").agg(F.min("page_id").alias("page_id"))
    order = Window.partitionBy("host").orderBy("page_id")
    return firsts.withColumn("n", F.row_number().over(order)).filter("n <= 6").select("page_id", "key", "host")


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(web.emails(F.col("text")), "|").alias("emails"))
    return rows.filter("emails != ''")


def generic_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.jobs(spark, sf_dir)
    found = web.generic_emails(F.lit(""), F.col("description"), F.lit("example.com"))
    return rows.select("external_id", F.array_join(found, "|").alias("emails")).filter("emails != ''")


def board_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of made-up URLs over the pages' hosts."""
    shapes = ("https://boards.greenhouse.io/", "https://jobs.lever.co/", "https://jobs.ashbyhq.com/", "https://careers.smartrecruiters.com/", "https://example.org/")
    slug = F.replace(web.domain(F.col("url")), F.lit("."), F.lit("-"))
    url = F.concat(derive.pick(shapes, F.col("page_id")), slug, F.lit("/jobs/1"))
    return table(spark, sf_dir, "pages").select("page_id", board_of(url)["source_id"].alias("source_id"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimming, cutting, slicing, titles of pages, templates and joins, on postings."""
    rows = derive.jobs(spark, sf_dir)
    i = F.col("external_id").cast("string")
    marked = F.concat(F.lit("menu <<"), "title", F.lit(" a>> b>> end"))
    page = F.concat("title", derive.pick((" | Site", " – Site", " - Site", "-Site", ""), F.col("external_id")))
    return rows.select(
        "external_id",
        text.non_empty(F.concat(F.lit(" "), F.coalesce("company_name", F.lit("")), F.lit(" "))).alias("company"),
        text.truncated(F.col("description"), 40).alias("start"),
        text.slice_description(marked, F.lit("<<"), derive.pick((">>", "@@", "menu"), F.col("external_id"))).alias("slice"),
        text.page_title(page).alias("page_title"),
        text.render("{{id}}: {{place}}", id=i, place=F.coalesce("location_raw", F.lit("?"))).alias("rendered"),
        text.join_present(" / ", F.col("company_name"), F.lit(""), F.col("location_raw")).alias("joined"),
        keys.company_of_key(F.col("dedup_key")).alias("key_company"),
        keys.capture_id(F.col("url")).alias("capture_id"),
        classify.resolve(F.when(F.col("external_id") % 3 == 0, "unknown").when(F.col("external_id") % 3 == 1, "hybrid"), F.col("remote_policy")).alias("resolved"),
        F.array_join(F.transform("flags", numbers.flag_label), "|").alias("flags"),
    )


def time_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as feeds write them, read back, spoken and written for an interface."""
    at, n = F.col("at"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    forms = [
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_millis(at).cast("string"), F.concat(F.lit("Mon, "), F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" +0000")),
        F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit("soon"), F.lit(""),
    ]
    written = F.element_at(F.array(*forms), (n % len(forms) + 1).cast("int"))
    now = F.to_timestamp(F.lit("2024-01-16 12:00:00"))
    read = times.parse_time(written)
    return rows.select(
        "event_id", read.cast("timestamp_ntz").alias("read"), times.ago(at, now).alias("ago"), times.until(at, now).alias("until"), times.api_time(at).alias("api"),
        times.midpoint(at, now).cast("timestamp_ntz").alias("middle"),
    )


def contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that hint at contacts by address or label, resolved; links elsewhere and mail links are left out."""
    i = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<a class=x href="/contact#form">Write</a> <a href="sub/page'), i, F.lit('">Our <b>jobs</b></a> <a href="https://other.example/contact">c</a> <a href="mailto:a@b.example">contact</a> <a href="/plain">plain</a>')
    )
    url = F.concat(F.lit("https://www.host"), i, F.lit(".example/a/b"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(web.candidate_pages(extra, url)).alias("link"))
    return rows


def mail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail links of customers, null where they are too long, and the notice of where an address was found."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("jobs@c"), F.col("c_custkey").cast("string"), F.lit(".example")).alias("to"))
    body = F.repeat(F.lit("a b"), (F.col("c_custkey") % 500).cast("int"))
    notice = web.privacy_notice("From: {{source}}.", F.concat(derive.pick(("manual:", "https://"), F.col("c_custkey")), F.lit("page")))
    return rows.select("c_custkey", web.mailto(F.col("to"), F.lit("Hello there & more"), body).alias("link"), notice.alias("notice"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages may be read, by the robots file of their site."""
    k = F.col("page_id")
    path = F.concat(F.lit("/"), derive.pick(("", "a", "a/b/", "p"), k), F.regexp_extract("url", "([^/]*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), web.robots_allowed(derive.pick(derive.ROBOTS, F.floor(k / 4)), path, "jobbot/1.0").alias("allowed"))
