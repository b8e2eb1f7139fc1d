"""The rule engine: criteria -> reasons, flags, score and verdict, as column expressions."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import astuple, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import fold, found_in

# The weights of the score.
BASE_SCORE, REQUIRED, PREFERRED, REMOTE, FRANCE, LOCAL, CDI = 40, 8, 5, 15, 5, 5, 5
SENIOR, MID, JUNIOR, EXCLUDED = 8, 3, -15, 5
EXCLUDED_CONTRACTS = ("internship", "apprenticeship", "freelance", "cdd")


@dataclass(frozen=True)
class Criteria:
    """Pattern lists on folded text. The defaults are an example."""

    role_title: tuple[str, ...] = (r"\b(?:developpeur|developer|engineer|ingenieur)\b",)
    required_stack: tuple[str, ...] = (r"\bpython\b", r"\bspark\b", r"\bjava\b", r"\btypescript\b")
    preferred_stack: tuple[str, ...] = (r"\bdocker\b", r"\bpostgres\b", r"\bkafka\b")
    title_exclusions: tuple[str, ...] = (r"\bphp\b", r"\bwordpress\b")
    description_exclusions: tuple[str, ...] = (r"\bastreinte\b", r"\bon call\b")
    seniority_exclusions: tuple[str, ...] = (r"\bhead of\b", r"\bdirector\b")
    company_exclusions: tuple[str, ...] = ("Gamma Consulting",)
    local_locations: tuple[str, ...] = (r"\blyon\b",)
    rejected_scopes: tuple[str, ...] = ("other",)

    def __post_init__(self):
        if not self.role_title or not self.required_stack:
            raise ValueError("criteria need role and stack patterns")
        for patterns in (self.role_title, self.required_stack, self.preferred_stack, self.title_exclusions):
            for pattern in patterns:
                re.compile(pattern)


    @property
    def stamp(self) -> str:
        """A digest of all lists: verdicts with another stamp are not these criteria's."""
        return hashlib.sha256(repr(astuple(self)).encode()).hexdigest()[:16]


# The names of the lists in a criteria file and here.
NAMES = {
    "roleTitlePatterns": "role_title", "requiredStack": "required_stack", "preferredStack": "preferred_stack", "titleExclusions": "title_exclusions",
    "descriptionExclusions": "description_exclusions", "seniorityTitleExclusions": "seniority_exclusions", "localLocations": "local_locations",
    "companyExclusions": "company_exclusions", "rejectRemoteScopes": "rejected_scopes",
}


@dataclass
class CriteriaFile:
    """Criteria read from JSON, and again when the file's time changes. Keys that start with ``$`` are notes."""

    path: Path
    _seen: float = field(default=-1.0, init=False)
    _criteria: Criteria | None = field(default=None, init=False)

    def load(self) -> Criteria:
        time = Path(self.path).stat().st_mtime
        if self._criteria is None or time != self._seen:
            values = json.loads(Path(self.path).read_text())
            lists = {NAMES.get(k, k): tuple(v) for k, v in values.items() if not k.startswith("$")}
            self._criteria, self._seen = Criteria(**lists), time
        return self._criteria


def _insensitive(pattern: str) -> str:
    return f"(?i){pattern}"


def _test(text: Column, pattern: str) -> Column:
    """Does a folded text match? A pattern that is plain words between borders is only tried where the words are."""
    plain = re.fullmatch(r"\\b([a-z0-9 ]+)\\b", pattern)
    return found_in(text, _insensitive(pattern), *([plain[1]] if plain else []))


def _hits(text: Column, patterns: tuple[str, ...]) -> Column:
    return sum((_test(text, p).cast("int") for p in patterns), F.lit(0))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """One test for all patterns."""
    return text.rlike(_insensitive("|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *[F.when(text.rlike(_insensitive(p)), F.lit(p)) for p in patterns])


def evaluate(rows: DataFrame, criteria: Criteria = Criteria(), advisory: Column | None = None) -> DataFrame:  # noqa: B008
    """Adds ``reasons``, ``flags``, ``rule_score``, ``matched`` and ``status`` (passed or rejected).

    Rows have title, description, company_name, location_raw, remote_policy, remote_scope, contract_type and
    seniority. Reasons come in a fixed order. An advisory row keeps its reasons and passes. Columns ``folded_title``,
    ``folded_place`` and ``folded_all`` (title and description) are used up if they are there, and made if not. Each
    pattern is tested once per row.
    """
    if "folded_all" not in rows.columns:
        title, place = (fold(F.coalesce(c, F.lit(""))) for c in ("title", "location_raw"))
        body = fold(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
        rows = rows.withColumns({"folded_title": title, "folded_place": place, "folded_all": body})
    title, place, body = (F.col(f"folded_{c}") for c in ("title", "place", "all"))
    wanted = criteria.required_stack + criteria.preferred_stack
    # what is used more than once is a column of its own
    rows = rows.withColumns(
        {
            "_local": _any(place, criteria.local_locations),
            "_stack": F.array(*[F.when(_test(body, p), F.lit(p)) for p in wanted]),
        }
    )
    local, stack, n = F.col("_local"), F.col("_stack"), len(criteria.required_stack)
    found = lambda first, count: F.size(F.array_compact(F.slice(stack, first, count)))
    remote, contract, scope = F.col("remote_policy"), F.col("contract_type"), F.col("remote_scope")
    away = remote.isin("hybrid", "onsite")
    required = found(1, n)
    excluded_company = F.coalesce(
        F.lit(None).cast("string"), *[F.when(fold(F.col("company_name")) == fold(F.lit(c)), F.lit(c)) for c in criteria.company_exclusions]
    )
    prefixed = lambda prefix, value: F.when(value.isNotNull(), F.concat(F.lit(prefix), value))
    reasons = F.array_compact(
        F.array(
            F.when(contract.isin(*EXCLUDED_CONTRACTS), F.concat(F.lit("contract:"), contract)),
            F.when(away & ~local, F.concat(F.lit("remote:"), remote)),
            F.when(scope.isin(*criteria.rejected_scopes), F.concat(F.lit("geo:"), scope)),
            F.when(~_any(title, criteria.role_title), F.lit("role:not_dev")),
            prefixed("stack_exclusion:", _first(title, criteria.title_exclusions)),
            F.when(required == 0, F.lit("stack_required:none")),
            prefixed("seniority:", _first(title, criteria.seniority_exclusions)),
            prefixed("company_exclusion:", excluded_company),
        )
    )
    flags = F.array_compact(
        F.array(
            F.when(contract == "unknown", F.lit("contract:unknown")),
            F.when((remote == "hybrid") & local, F.lit("remote:hybrid_local")),
            F.when(remote == "unknown", F.lit("remote:unknown")),
            F.when(scope == "europe", F.lit("geo:check_french_entity")),
        )
    )
    seniority = F.col("seniority")
    points = (
        F.lit(BASE_SCORE)
        + REQUIRED * F.least(required, F.lit(4))
        + PREFERRED * F.least(found(n + 1, max(len(criteria.preferred_stack), 1)), F.lit(2))
        + F.when(remote == "full_remote", REMOTE).otherwise(0)
        + F.when(scope == "france", FRANCE).otherwise(0)
        + F.when(local & ~away, LOCAL).otherwise(0)
        + F.when(contract == "cdi", CDI).otherwise(0)
        + F.when(seniority.isin("senior", "lead"), SENIOR).when(seniority == "mid", MID).when(seniority == "junior", JUNIOR).otherwise(0)
        - EXCLUDED * F.least(_hits(body, criteria.description_exclusions), F.lit(4))
    )
    rows = rows.withColumns(
        {"reasons": reasons, "flags": flags, "rule_score": F.least(F.greatest(points, F.lit(0)), F.lit(100)), "matched": F.array_compact(stack)}
    )
    free = F.lit(False) if advisory is None else advisory
    status = F.when((F.size("reasons") > 0) & ~F.coalesce(free, F.lit(False)), "rejected").otherwise("passed")
    return rows.withColumn("status", status).drop("_local", "_stack", "folded_title", "folded_place", "folded_all")


def hidden_by_verdict(remote_verdict: Column, contract_verdict: Column, flags: Column) -> Column:
    """True for rows that a model's verdict hides; unknown verdicts hide nothing."""
    local = F.array_contains(flags, "remote:hybrid_local")
    remote = remote_verdict.isin("hybrid_or_onsite", "remote_but_geo_incompatible") & ((remote_verdict != "hybrid_or_onsite") | ~local)
    return F.coalesce(remote | (contract_verdict == "not_cdi"), F.lit(False))
