"""Contract, seniority, remote policy and scope, country: ordered rules.

Every ``detect_*`` function has a form that takes folded columns (``*_of``), so that a caller folds a text once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, fold, found_in

# Patterns on folded text, in the order in which they are tried.
CONTRACTS = {
    "internship": r"\b(?:stage|stagiaire|intern|internship|stage de fin d etudes)\b",
    "apprenticeship": r"\b(?:alternance|alternant|apprenti|apprentissage|apprenticeship|work study)\b",
    "freelance": r"\b(?:freelance|free lance|contractor|independant|portage salarial|mission de \d+ mois|tjm)\b",
    "cdd": r"\b(?:cdd|contrat a duree determinee|fixed term|temporary contract)\b",
    "cdi": r"\b(?:cdi|contrat a duree indeterminee|permanent contract|permanent position|permanent role)\b",
}
# A text that a contract's pattern matches holds one of these.
CONTRACT_NEEDLES = {
    "internship": ("stag", "intern"),
    "apprenticeship": ("alternan", "apprenti", "work study"),
    "freelance": ("freelance", "free lance", "contractor", "independant", "portage salarial", "mission de ", "tjm"),
    "cdd": ("cdd", "duree determinee", "fixed term", "temporary contract"),
    "cdi": ("cdi", "duree indeterminee", "permanent "),
}
STRONG_CDI = r"\b(?:cdi|contrat a duree indeterminee|permanent contract)\b"
CONTRACT_LABELS = {
    "cdi": r"^cdi\b|permanent|fulltime permanent",
    "cdd": r"^cdd\b|fixed term|temporary|^mis\b|interim",
    "internship": r"intern|stage",
    "apprenticeship": r"apprenti|alternance|work study",
    "freelance": r"contractor|freelance|^lib\b|independant",
}
SENIORITY = {
    "lead": r"\b(?:lead|staff|principal|head of|architect|architecte|tech lead|engineering manager)\b",
    "senior": r"\b(?:senior|sr|confirme|confirmee|experimente|experimentee|expert)\b",
    "junior": r"\b(?:junior|jr|debutant|graduate|entry level)\b",
    "mid": r"\b(?:mid|intermediate|medior)\b",
}
YEARS = r"\b(\d{1,2}) ?(?:\+ ?)?(?:ans|an s|years?|yrs?)(?: minimum)? (?:d )?(?:experience|of experience)"
FULL_REMOTE = (
    r"\bfull[ -]?remote\b",
    r"\bfully remote\b",
    r"\b100 ?%? ?(?:remote|teletravail|en teletravail|a distance)\b",
    r"\bteletravail (?:total|complet|integral|a 100)\b",
    r"\bremote[ -]first\b",
    r"\bremote only\b",
    r"\bposte (?:en|a) (?:full )?teletravail\b",
    r"\bremote \(france\)|\bremote france\b|\bfrance remote\b",
)
FULL_REMOTE_NEEDLES = ("remote", "teletravail", "a distance")
HYBRID_NEEDLES = ("hybrid", "teletravail", "remote", "sur site", "au bureau", "presentiel", "nos locaux", "office")
ONSITE_NEEDLES = ("site uniquement", "teletravail", "presentiel", "site only", "no remote")
HYBRID = (
    r"\bhybride?\b",
    r"\b\d ?(?:jours?|j) (?:de |par semaine de )?(?:teletravail|remote)\b",
    r"\b\d ?(?:jours?|j) (?:par semaine )?(?:sur site|au bureau|en presentiel|de presentiel|dans nos locaux)\b",
    r"\bpresentiel (?:de )?\d ?(?:jours?|j)\b",
    r"\bpartial(?:ly)? remote\b",
    r"\bdays? (?:a week )?in (?:the )?office\b",
    r"\bin[ -]office \d\b",
)
ONSITE = (
    r"\bsur site uniquement\b",
    r"\bpas de teletravail\b",
    r"\b100 ?%? ?presentiel\b",
    r"\bon[ -]?site only\b",
    r"\bno remote\b",
    r"\bpresentiel obligatoire\b",
)
SCOPE_OTHER = (
    r"\bus only\b",
    r"\busa only\b",
    r"\b(?:must|need to) (?:be )?(?:located|based|reside) in (?:the )?(?:us|usa|united states|canada|uk)\b",
    r"\b(?:pst|est|cst|mst|pacific time|eastern time)\b",
    r"\bremote (?:us|usa|canada|uk|latam|apac|india)\b",
    r"\b(?:us|usa|canada|latam|apac) remote\b",
    r"\bwork authorization in the (?:us|united states)\b",
)
ZONES = r"\b(?:pst|est|cst|mst|pacific time|eastern time)\b"
#: A zone holds none of the needles below. What ``found_in`` cuts off may end within a word, so a zone looked for near those
#: would also be found at the end of "forest".
SCOPE_OTHER_BUT_ZONES = tuple(p for p in SCOPE_OTHER if p != ZONES)
ZONE_NEEDLES = ("pst", "est", "cst", "mst", "pacific time", "eastern time")
SCOPE_OTHER_NEEDLES = ("us only", "usa only", "located in ", "based in ", "reside in ", "remote ", " remote", "authorization in the ")
SCOPE_FRANCE_NEEDLES = (
    "france", "paris", "toulouse", "lyon", "nantes", "bordeaux", "lille", "marseille", "montpellier", "rennes", "strasbourg", "nice", "grenoble", "sophia", "provence",
    "annecy", "brest", "caen", "dijon", "tours", "angers", "clermont", "rouen", "metz", "nancy", "defense", "boulogne", "levallois",
)
SCOPE_EUROPE_NEEDLES = ("eu", "emea", "cet", "cest")
SCOPE_WORLD_NEEDLES = ("anywhere", "worldwide", "global")
SCOPE_FRANCE = (
    r"\bfrance\b",
    r"\bile de france\b",
    r"\b(?:paris|toulouse|lyon|nantes|bordeaux|lille|marseille|montpellier|rennes|strasbourg|nice|grenoble|sophia antipolis|"
    r"aix en provence|annecy|brest|caen|dijon|tours|angers|clermont ferrand|rouen|metz|nancy|la defense|boulogne billancourt|levallois)\b",
    r"^\d{2} [a-z]",
)
SCOPE_FOREIGN = (
    r"\b(?:united states|usa|us|u s|united kingdom|uk|england|canada|germany|deutschland|spain|espana|italy|portugal|netherlands|"
    r"belgium|belgique|switzerland|suisse|ireland|poland|romania|sweden|denmark|norway|finland|austria|czech|hungary|greece|israel|"
    r"india|singapore|australia|brazil|brasil|mexico|argentina|japan|china|latam|apac|london|new york|nyc|san francisco|boston|"
    r"seattle|austin|chicago|los angeles|denver|toronto|montreal|vancouver|berlin|munich|hamburg|madrid|barcelona|lisbon|amsterdam|"
    r"dublin|stockholm|copenhagen|warsaw|prague|zurich|geneva|geneve|milan|brussels|bruxelles|tel aviv|bangalore|sydney|tokyo)\b",
)
SCOPE_EUROPE = (r"\beurope\b", r"\beuropean union\b", r"\bemea\b", r"\b(?:cet|cest)\b", r"\beu\b")
SCOPE_WORLD = (r"\banywhere\b", r"\bworldwide\b", r"\bglobal(?:ly)?\b")

# Country names (folded) and their ISO codes.
COUNTRIES = {
    "france": "FR", "germany": "DE", "allemagne": "DE", "spain": "ES", "espagne": "ES", "united kingdom": "GB", "united states": "US",
    "usa": "US", "belgium": "BE", "belgique": "BE", "netherlands": "NL", "pays bas": "NL", "switzerland": "CH", "suisse": "CH",
    "italy": "IT", "italie": "IT", "portugal": "PT", "poland": "PL", "canada": "CA", "ireland": "IE",
}


def label(value: Column, labels: dict[str, str]) -> Column:
    """A vendor's label by its letters only; null if it says nothing."""
    key = F.regexp_replace(F.lower(value), "[^a-z]", "")
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit("")))


def one_of(patterns: tuple[str, ...]) -> str:
    """One pattern that matches where any of them does, so a text is read once for all of them."""
    return "|".join(f"(?:{p})" for p in patterns)


def _first(value: Column, rules: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value.rlike(pattern), F.lit(name)) for name, pattern in rules.items()])


def _first_in(text: Column, rules: dict[str, str]) -> Column:
    """As ``_first``, for long texts."""
    return F.coalesce(*[F.when(found_in(text, pattern, *CONTRACT_NEEDLES[name]), F.lit(name)) for name, pattern in rules.items()])


def contract_of(title: Column, body: Column) -> Column:
    """The title decides; else a strong permanent contract in the body, else the others in their order."""
    others = {name: pattern for name, pattern in CONTRACTS.items() if name != "cdi"}
    in_body = F.coalesce(F.when(found_in(body, STRONG_CDI, *CONTRACT_NEEDLES["cdi"]), F.lit("cdi")), _first_in(body, others))
    return F.coalesce(_first(title, CONTRACTS), in_body, F.lit("unknown"))


def detect_contract(title: Column, text: Column) -> Column:
    return contract_of(fold(title), fold(F.coalesce(text, F.lit(""))))


def contract_from_label(value: Column) -> Column:
    return F.coalesce(_first(fold(value), CONTRACT_LABELS), F.lit("unknown"))


def seniority_of(title: Column, body: Column) -> Column:
    years = F.when(body.contains("experience"), F.nullif(F.regexp_extract(body, YEARS, 1), F.lit(""))).cast("int")
    by_years = bound(years, lambda y: F.when(y >= 5, "senior").when(y >= 2, "mid").when(y.isNotNull(), "junior"))
    return F.coalesce(_first(title, SENIORITY), by_years, F.lit("unknown"))


def detect_seniority(title: Column, text: Column) -> Column:
    return seniority_of(fold(title), fold(F.coalesce(text, F.lit(""))))


def remote_of(body: Column) -> Column:
    """On site and hybrid count unless full remote is there too; full remote and hybrid together say nothing."""
    onsite, hybrid = found_in(body, one_of(ONSITE), *ONSITE_NEEDLES), found_in(body, one_of(HYBRID), *HYBRID_NEEDLES)
    full = found_in(body, one_of(FULL_REMOTE), *FULL_REMOTE_NEEDLES)
    said = F.struct(onsite.alias("onsite"), hybrid.alias("hybrid"), full.alias("full"))  # each is looked for once
    return bound(
        said,
        lambda s: F.when(s["onsite"] & ~s["full"], "onsite").when(s["hybrid"] & ~s["full"], "hybrid").when(s["full"] & ~s["hybrid"], "full_remote").otherwise("unknown"),
    )


def detect_remote(text: Column) -> Column:
    return remote_of(fold(F.coalesce(text, F.lit(""))))


def resolve(structured: Column, found: Column) -> Column:
    """What a feed says, unless it says nothing or ``unknown``."""
    return F.coalesce(F.nullif(structured, F.lit("unknown")), found)


def resolve_remote(structured: Column, text: Column) -> Column:
    return resolve(structured, detect_remote(text))


def scope_of(place: Column, body: Column) -> Column:
    """The location decides first, then the body."""
    limited = found_in(body, ZONES, *ZONE_NEEDLES) | found_in(body, one_of(SCOPE_OTHER_BUT_ZONES), *SCOPE_OTHER_NEEDLES)
    # the last pattern is for the text's start only
    france = (F.left(body, F.lit(4)).rlike(SCOPE_FRANCE[-1])) | found_in(body, one_of(SCOPE_FRANCE[:-1]), *SCOPE_FRANCE_NEEDLES)
    return (
        F.when(place.rlike(one_of(SCOPE_OTHER)), "other")
        .when(place.rlike(one_of(SCOPE_FRANCE)), "france")
        .when(place.rlike(one_of(SCOPE_EUROPE)), "europe")
        .when(place.rlike(one_of(SCOPE_FOREIGN)), "other")
        .when(place.rlike(one_of(SCOPE_WORLD)) & ~limited, "worldwide")
        .when(limited, "other")
        .when(france, "france")
        .when(found_in(body, one_of(SCOPE_EUROPE), *SCOPE_EUROPE_NEEDLES), "europe")
        .when(found_in(body, one_of(SCOPE_WORLD), *SCOPE_WORLD_NEEDLES), "worldwide")
        .otherwise("unknown")
    )


def detect_scope(location: Column, text: Column) -> Column:
    return scope_of(fold(F.coalesce(location, F.lit(""))), fold(F.coalesce(text, F.lit(""))))


def country_code(value: Column) -> Column:
    """Two letters as they are; else a known name, alone or after other words."""
    trimmed = F.trim(value)
    found = bound(fold(value), lambda name: F.coalesce(*[F.when((name == n) | name.endswith(f" {n}"), F.lit(code)) for n, code in COUNTRIES.items()]))
    return F.when(trimmed.rlike("^[A-Za-z]{2}$"), F.upper(trimmed)).otherwise(found)


def last_part(location: Column) -> Column:
    return F.trim(F.element_at(F.split(location, ","), -1))
