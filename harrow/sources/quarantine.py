"""A listing's postings, and beside them what could not be used: nothing that was fetched vanishes.

Items are parsed and built once and written; postings and rejected items are read from that one table. A body that does
not hold its vendor's list at all is kept as it came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from harrow.operators.snapshot import cut

from . import feeds
from .build import DRAFT, build
from .registry import ADAPTERS

#: Vendors whose bodies are JSON: what they must parse as, and where the list is.
SHAPES = {
    "greenhouse": (feeds.GREENHOUSE, "jobs"),
    "lever": (feeds.LEVER, None),
    "ashby": (feeds.ASHBY, "jobs"),
    "smartrecruiters": (feeds.SMARTRECRUITERS, "content"),
    "recruitee": (feeds.RECRUITEE, "offers"),
    "france_travail": (feeds.FRANCE_TRAVAIL, "resultats"),
    "jobicy": (feeds.JOBICY, "jobs"),
}


@dataclass(frozen=True)
class Listing:
    """``postings``; ``rejected`` (source_id, what: item or body, reason, raw); ``seen``: items and rejected items in all."""

    postings: DataFrame
    rejected: DataFrame
    seen: dict[str, int]


def readable(kind: str, body: Column) -> Column:
    """Does a body hold its vendor's list? An empty list is one."""
    if kind == "teamtailor":
        return F.coalesce(body.rlike(r"<(?:rss|channel)\b"), F.lit(False))
    schema, field = SHAPES[kind]
    parsed = F.from_json(body, schema)
    return (parsed[field] if field else parsed).isNotNull()


def listing(payloads: DataFrame, kind: str, **more: DataFrame) -> Listing:
    """Payloads (source_id, company, slug, body) of a vendor; ``more`` is what its reader takes besides.

    An item without id, address or title is rejected with the names of what it lacks. A null body is unreadable.
    """
    seen = Observation()
    built = build(ADAPTERS[kind].drafts(payloads, **more))
    lacking = F.size("failed") > 0
    fetched = cut(built.observe(seen, F.count(F.lit(1)).alias("items"), F.count_if(lacking).alias("rejected")), "fetched")
    draft = [c for c in DRAFT if c in fetched.columns]
    items = fetched.filter(lacking).select("source_id", F.lit("item").alias("what"), F.array_join("failed", ",").alias("reason"), F.to_json(F.struct(*draft)).alias("raw"))
    bodies = payloads.filter(~readable(kind, F.col("body"))).select("source_id", F.lit("body").alias("what"), F.lit("unreadable").alias("reason"), F.col("body").alias("raw"))
    return Listing(fetched.filter(~lacking), items.unionByName(bodies), seen.get)


def counts(found: Listing) -> DataFrame:
    """Per source: items ``fetched`` = ``written`` + ``rejected``, and ``unreadable`` bodies."""
    written = found.postings.select("source_id", F.lit("written").alias("what"))
    rows = written.unionByName(found.rejected.select("source_id", "what")).groupBy("source_id")
    of = lambda *what: F.count_if(F.col("what").isin(*what))
    return rows.agg(of("written", "item").alias("fetched"), of("written").alias("written"), of("item").alias("rejected"), of("body").alias("unreadable"))
