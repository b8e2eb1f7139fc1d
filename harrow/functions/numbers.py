"""Salaries, scores, costs and the labels shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of other periods and of amounts, the plausible range of a year's pay, and labels of codes.
NOT_YEARLY = r"\b(?:mensuel|monthly|par mois|/ ?mois|horaire|hourly|/ ?h\b|jour|daily|tjm)\b"
AMOUNT = r"(?:\d{1,3}(?:[\s\x{00A0}\x{202F}.]\d{3})+|\d+(?:[.,]\d+)?)\s*k?"
LEAST, MOST = 15_000, 300_000
REASON_LABELS = {
    "contract": "Contrat exclu", "remote": "Pas full remote", "geo": "Zone géographique", "role": "Pas un poste de dev",
    "stack_exclusion": "Techno exclue dans le titre", "stack_required": "Aucune techno cible", "seniority": "Séniorité exclue",
    "company_exclusion": "Entreprise exclue", "llm": "Verdict LLM",
}
FLAG_LABELS = {
    "remote:unknown": "remote non précisé", "contract:unknown": "contrat non précisé",
    "geo:check_french_entity": "vérifier la possibilité d'un CDI en France",
}
#: States of triage, the weakest first.
TRIAGE = ("new", "dismissed", "interested", "applied")


def salary_numbers(raw: Column) -> Column:
    """The yearly amounts in the text, in its order."""
    found = F.regexp_extract_all(F.lower(raw), F.lit(AMOUNT), F.lit(0))

    def value(x: Column) -> Column:
        number = F.regexp_replace(x, r"[\s\x{00A0}\x{202F}k]", "")
        plain = F.when(number.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.replace(number, F.lit("."), F.lit(""))).otherwise(F.replace(number, F.lit(","), F.lit(".")))
        return F.round(plain.try_cast("double") * F.when(x.endswith("k"), 1000.0).otherwise(1.0))

    return F.filter(F.transform(found, value), lambda x: (x >= LEAST) & (x <= MOST))


def parse_salary(raw: Column) -> Column:
    """struct(min, max, raw): null amounts for other periods; max is null if there is one amount; null without text."""
    raw = F.nullif(F.trim(raw), F.lit(""))
    numbers = F.when(F.lower(raw).rlike(NOT_YEARLY), F.array().cast("array<double>")).otherwise(salary_numbers(raw))
    low, high = F.array_min(numbers), F.array_max(numbers)
    whole = lambda x: x.cast("int")
    return F.when(raw.isNotNull(), F.struct(whole(low).alias("min"), F.when(high > low, whole(high)).alias("max"), raw.alias("raw")))


def salary_from_numbers(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """struct(min, max, raw): amounts only in euros (or unsaid) and yearly (or unsaid); null without amounts."""
    unsaid = lambda x: F.coalesce(x, F.lit("")) == ""
    fits = (unsaid(currency) | (F.upper(currency) == "EUR")) & (unsaid(period) | F.lower(period).rlike("year|annual|an"))
    whole = lambda x: F.when(fits, F.round(x).cast("int"))
    amounts = F.concat_ws(" – ", low.cast("string"), high.cast("string"))
    raw = F.trim(F.concat(amounts, F.lit(" "), F.coalesce(currency, F.lit("")), F.lit(" "), F.coalesce(period, F.lit(""))))
    return F.when(F.coalesce(low, high).isNotNull(), F.struct(whole(low).alias("min"), whole(high).alias("max"), raw.alias("raw")))


def format_salary(low: Column, high: Column) -> Column:
    k = lambda x: F.concat(F.round(x / 1000).cast("int").cast("string"), F.lit("k"))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(k(low), F.lit("–"), k(high), F.lit(" €"))).when(
        F.coalesce(low, high).isNotNull(), F.concat(k(F.coalesce(low, high)), F.lit(" €"))
    )


def score_level(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 65, "good").when(score >= 50, "fair").when(score.isNotNull(), "weak")


def cost_usd(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in + 5 * tokens_out) / 1e6


# What contracts, policies and verdicts are called.
CONTRACT_NAMES = {"cdi": "CDI", "cdd": "CDD", "freelance": "Freelance", "internship": "Stage", "apprenticeship": "Alternance", "other": "Autre", "unknown": "Contrat ?"}
UNKNOWN_CONTRACT = "Contrat non précisé"
POLICY_NAMES = {"full_remote": "Full remote", "hybrid": "Hybride", "onsite": "Sur site", "unknown": "Remote ?"}
VERDICT_NAMES = {"full_remote_france_ok": "Full remote France", "hybrid_or_onsite": "Hybride / sur site", "remote_but_geo_incompatible": "Remote hors zone", "unclear": "Remote incertain"}


def named(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def contract_fact(contract: Column, verdict: Column) -> Column:
    """struct(label, tone): a model's verdict goes before the detected type where it decides."""
    told = F.coalesce(verdict, F.lit("unclear"))
    unfit = F.when(contract.isin("cdi", "unknown"), F.lit("Pas un CDI")).otherwise(named(contract, CONTRACT_NAMES))
    cdi = (contract == "cdi") | (told == "cdi")
    other = F.when(contract == "unknown", UNKNOWN_CONTRACT).otherwise(named(contract, CONTRACT_NAMES))
    shown = F.when(told == "not_cdi", unfit).when(cdi, F.lit(CONTRACT_NAMES["cdi"])).otherwise(other)
    tone = F.when(told == "not_cdi", "bad").when(cdi, "good").when(contract == "unknown", "warn").otherwise("bad")
    return F.struct(shown.alias("label"), tone.alias("tone"))


def remote_fact(policy: Column, verdict: Column) -> Column:
    """struct(label, tone): any verdict goes before the policy."""
    known = F.coalesce(verdict, policy)
    shown = F.coalesce(named(verdict, VERDICT_NAMES), named(policy, POLICY_NAMES))
    tone = F.when(known.isin("full_remote_france_ok", "full_remote"), "good").when(known.isin("unclear", "unknown"), "warn").otherwise("bad")
    return F.struct(shown.alias("label"), tone.alias("tone"))


def reason_label(reason: Column) -> Column:
    """The code's label with its detail in parentheses; an unknown code as it is."""
    part = lambda n: F.split_part(reason, F.lit(":"), F.lit(n))
    return F.concat(F.coalesce(named(part(1), REASON_LABELS), part(1)), F.when(part(2) != "", F.concat(F.lit(" ("), part(2), F.lit(")"))).otherwise(""))


def flag_label(flag: Column) -> Column:
    return F.coalesce(named(flag, FLAG_LABELS), flag)


def triage_rank(triage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TRIAGE]), triage)


def triage_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TRIAGE]), rank.cast("int"))
