"""From a draft, as a feed gives it, to a posting with every normalised column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import classify, numbers, times
from harrow.functions.text import fold, non_empty, normalize_whitespace

#: A draft's columns; a feed leaves out what it does not have.
DRAFT = {
    "external_id": "string", "url": "string", "apply_url": "string", "title": "string", "company_name": "string", "location_raw": "string",
    "country": "string", "remote_policy": "string", "remote_scope": "string", "contract_type": "string", "seniority": "string",
    "salary": "struct<min:int,max:int,raw:string>", "salary_raw": "string", "description": "string", "tags": "array<string>",
    "published_at": "string", "source_updated_at": "string",
}
#: Without these a posting is counted as failed and skipped.
REQUIRED = ("external_id", "url", "title")
POLICIES = ("full_remote", "hybrid", "onsite", "unknown")


def drafted(rows: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """``rows`` as drafts, with the columns ``keep`` beside them."""
    unknown = set(columns) - set(DRAFT)
    if unknown:
        raise ValueError(f"not in a draft: {', '.join(sorted(unknown))}")
    return rows.select(*keep, *[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in DRAFT.items()])


def build(drafts: DataFrame) -> DataFrame:
    """Fills a draft's gaps by the rules that all feeds share. What a feed says goes first, unless it says ``unknown``.

    Other columns of ``drafts`` stay. Title, place and description are folded once each, and what the rules read is put
    together from those. ``failed`` lists the required columns that a draft lacks.
    """
    others = [c for c in drafts.columns if c not in DRAFT]
    text = drafts.withColumns(
        {
            "title": normalize_whitespace(F.col("title")),
            "description": normalize_whitespace(F.coalesce("description", F.lit(""))),
            "location_raw": non_empty(F.col("location_raw")),
        }
    )
    folded = text.withColumns(
        {
            "folded_title": fold(F.coalesce("title", F.lit(""))),
            "folded_place": fold(F.coalesce("location_raw", F.lit(""))),
            "folded_body": fold(F.col("description")),
        }
    )
    title, place, body = (F.col(f"folded_{c}") for c in ("title", "place", "body"))
    joined = lambda *parts: F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    folded = folded.withColumns({"folded_context": joined(title, place, body), "folded_all": joined(title, body)})
    context, every = F.col("folded_context"), F.col("folded_all")
    missing = [F.when(F.coalesce(non_empty(F.col(c)), F.lit("")) == "", F.lit(c)) for c in REQUIRED]
    return folded.select(
        *others,
        "external_id",
        "url",
        non_empty(F.col("apply_url")).alias("apply_url"),
        "title",
        non_empty(F.col("company_name")).alias("company_name"),
        "location_raw",
        F.coalesce(classify.country_code(F.col("country")), classify.country_code(classify.last_part(F.col("location_raw")))).alias("country_code"),
        classify.resolve(F.col("remote_policy"), classify.remote_of(context)).alias("remote_policy"),
        classify.resolve(F.col("remote_scope"), classify.scope_of(place, every)).alias("remote_scope"),
        classify.resolve(F.col("contract_type"), classify.contract_of(title, body)).alias("contract_type"),
        classify.resolve(F.col("seniority"), classify.seniority_of(title, body)).alias("seniority"),
        F.coalesce("salary", numbers.parse_salary(F.col("salary_raw"))).alias("salary"),
        "description",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        times.parse_time(F.col("published_at")).alias("published_at"),
        times.parse_time(F.col("source_updated_at")).alias("source_updated_at"),
        F.array_compact(F.array(*missing)).alias("failed"),
        "folded_title",
        "folded_place",
        "folded_all",
    )
