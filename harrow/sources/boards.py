"""Which vendor's board an address belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
#: (kind, config, slug, source_id) of a board.
BOARD = "struct<kind:string,config:map<string,string>,slug:string,source_id:string>"


def _board(kind: str, slug: Column, **config: Column) -> Column:
    pairs = [x for name, value in config.items() for x in (F.lit(name), value)]
    return F.struct(
        F.lit(kind).alias("kind"),
        F.create_map(*pairs).alias("config"),
        slug.alias("slug"),
        F.concat(F.lit(f"{kind}:"), F.lower(slug)).alias("source_id"),
    ).cast(BOARD)


def board_of(url: Column) -> Column:
    """The board of an address by its host, or null; a slug must look like one."""
    url = F.trim(url)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parts = F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    asked = F.nullif(F.regexp_extract(url, r"[?&]for=([^&#]*)", 1), F.lit(""))
    fits = lambda slug, *but: slug.rlike(SLUG) & ~slug.isin(*but) if but else slug.rlike(SLUG)
    token = F.when(host.startswith("boards-api."), F.try_element_at(parts, F.lit(3))).otherwise(F.coalesce(asked, first))
    below = lambda domain: F.when(host.endswith(domain), F.left(host, F.length(host) - len(domain)))
    recruitee, teamtailor = below(".recruitee.com"), below(".teamtailor.com")
    region = F.when(host.contains(".eu."), "eu").otherwise("global")
    return (
        F.when(host.rlike(r"(?:^|\.)greenhouse\.io$") & fits(token, "embed"), _board("greenhouse", token, token=token))
        .when(host.isin("jobs.lever.co", "jobs.eu.lever.co") & fits(first), _board("lever", first, company=first, region=region))
        .when((host == "jobs.ashbyhq.com") & fits(first), _board("ashby", first, name=first))
        .when(fits(recruitee, "www", "api"), _board("recruitee", recruitee, company=recruitee))
        .when(fits(teamtailor, "www", "app"), _board("teamtailor", teamtailor, feedUrl=F.concat(F.lit("https://"), host, F.lit("/jobs.rss"))))
        .when(host.isin("jobs.smartrecruiters.com", "careers.smartrecruiters.com") & fits(first), _board("smartrecruiters", first, company=first))
    )


def boards_in(html: Column, url: Column) -> Column:
    """Boards that a page's addresses belong to, one per source id; a page on its own domain may only name its vendor.

    A later address with a source id of an earlier one replaces its configuration, in the earlier one's place.
    """
    urls = F.regexp_extract_all(html, F.lit(r"""https?://[^\s"'<>)]+"""), F.lit(0))
    embedded = F.nullif(F.regexp_extract(html, r"greenhouse\.io/embed/job_board(?:/js)?\?for=([A-Za-z0-9_-]+)", 1), F.lit(""))
    extra = F.when(embedded.isNotNull(), F.array(_board("greenhouse", embedded, token=embedded))).otherwise(F.array().cast(f"array<{BOARD}>"))
    found = F.concat(F.filter(F.transform(urls, board_of), lambda b: b.isNotNull()), extra)
    ids = F.array_distinct(F.transform(found, lambda b: b["source_id"]))
    last = lambda one: F.element_at(F.filter(found, lambda b: b["source_id"] == one), -1)
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    slug = F.split_part(F.regexp_replace(host, r"^(?:www\.|careers?\.|jobs\.)", ""), F.lit("."), F.lit(1))
    guess = F.array(_board("teamtailor", slug, feedUrl=F.concat(origin, F.lit("/jobs.rss"))))
    hinted = (F.size(found) == 0) & html.rlike("(?i)teamtailor") & (origin != "")
    return F.when(hinted, guess).otherwise(F.transform(ids, last))
