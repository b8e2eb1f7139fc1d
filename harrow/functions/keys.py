"""Keys, hashes and trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_whitespace

#: Days that a group stays open for new members, and the similarities for grouping and for suggesting a merge.
HORIZON_DAYS, GROUPING, SUGGESTING = 45, 0.75, 0.4

# Words that make two otherwise similar titles different roles.
QUALIFIERS = (
    r"\b(?:junior|jr|senior|sr|staff|lead|principal|head|manager|intern|stagiaire|alternant|french|francais|german|allemand|spanish|"
    r"espagnol|italian|italien|english|anglais|dutch|backend|frontend|fullstack|mobile|ios|android|data|ml|ai|qa)\b"
)

# Kinds of sources, the most trusted first.
BOARDS = ("greenhouse", "lever", "ashby", "smartrecruiters", "recruitee", "teamtailor")


def grams(value: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]+"), 0)
    each = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(each))


def similarity_of_grams(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of_grams(grams(a), grams(b))


def content_hash(title_norm: Column, company_norm: Column, description: Column) -> Column:
    company = F.coalesce(company_norm, F.lit(""))
    return F.sha2(F.concat(title_norm, F.lit("\n"), company, F.lit("\n"), normalize_whitespace(description)), 256)


def dedup_key(company_norm: Column, title_norm: Column) -> Column:
    """Null without a company: such rows match nothing by key."""
    return F.when(F.coalesce(company_norm, F.lit("")) != "", F.concat(company_norm, F.lit("|"), title_norm))


def company_of_key(key: Column) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(1))


def title_qualifiers(title_norm: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(title_norm, F.lit(QUALIFIERS), 0))), ",")


def source_priority(kind: Column) -> Column:
    return F.when(kind.isin(*BOARDS), 0).when(kind == "capture", 1).when(kind == "france_travail", 2).otherwise(3)


def anonymous_key(source_id: Column, external_id: Column) -> Column:
    """A key that no other row has."""
    return F.concat(F.lit("anon|"), F.sha2(F.concat_ws("|", source_id, external_id.cast("string")), 256))


def capture_id(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(40))
