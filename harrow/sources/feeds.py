"""Eight vendors' payloads as drafts. A payload is one response: a column ``body`` of JSON or XML.

Every function takes rows with ``body``, ``source_id``, ``company`` (what the source's own record says) and ``slug`` (its
name at the vendor) and returns drafts with ``source_id``. Unknown fields are ignored; a field of another type than the
schema's is null, so a posting without a usable id, title or address shows in ``failed`` after ``build``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import classify, numbers
from harrow.functions.text import fold, html_to_text, join_present

from .build import drafted

# The fields that are read, and what vendors call policies, contracts and levels.
GREENHOUSE = (
    "jobs array<struct<id:long,title:string,company_name:string,absolute_url:string,location:struct<name:string>,content:string,"
    "updated_at:string,first_published:string,metadata:array<struct<name:string,value:string>>,departments:array<struct<name:string>>>>"
)
LEVER = (
    "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:long,country:string,workplaceType:string,"
    "descriptionPlain:string,description:string,additionalPlain:string,lists:array<struct<text:string,content:string>>,"
    "categories:struct<commitment:string,location:string,team:string,department:string,allLocations:array<string>>,"
    "salaryRange:struct<min:double,max:double,currency:string,interval:string>>>"
)
ASHBY = (
    "jobs array<struct<id:string,title:string,department:string,team:string,employmentType:string,location:string,"
    "secondaryLocations:array<struct<location:string>>,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,"
    "address:struct<postalAddress:struct<addressCountry:string,addressLocality:string>>,jobUrl:string,applyUrl:string,"
    "descriptionHtml:string,descriptionPlain:string,compensation:struct<scrapeableCompensationSalarySummary:string>>>"
)
_SECTION = "struct<title:string,text:string>"
POSTING = (
    "id:string,name:string,releasedDate:string,company:struct<name:string>,"
    "location:struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>,"
    "typeOfEmployment:struct<id:string,label:string>,experienceLevel:struct<id:string>,department:struct<label:string>,"
    "postingUrl:string,applyUrl:string,jobAd:struct<sections:struct<"
    f"companyDescription:{_SECTION},jobDescription:{_SECTION},qualifications:{_SECTION},additionalInformation:{_SECTION}>>"
)
SMARTRECRUITERS = f"content array<struct<{POSTING}>>"
RECRUITEE = (
    "offers array<struct<id:long,slug:string,title:string,status:string,company_name:string,description:string,requirements:string,"
    "location:string,city:string,country_code:string,remote:boolean,hybrid:boolean,on_site:boolean,employment_type_code:string,"
    "experience_code:string,published_at:string,updated_at:string,careers_url:string,careers_apply_url:string,department:string,"
    "tags:array<string>,salary:struct<min:double,max:double,currency:string,period:string>>>"
)
TEAMTAILOR = (
    "title string, link string, guid struct<_VALUE:string,_isPermaLink:string>, description string, pubDate string, remoteStatus string, "
    "department string, role string, locations struct<location:array<struct<name:string,city:string,country:string>>>"
)
FRANCE_TRAVAIL = (
    "resultats array<struct<id:string,intitule:string,description:string,dateCreation:string,dateActualisation:string,"
    "lieuTravail:struct<libelle:string>,entreprise:struct<nom:string>,typeContrat:string,alternance:boolean,experienceExige:string,"
    "experienceLibelle:string,salaire:struct<libelle:string>,romeLibelle:string,appellationlibelle:string,"
    "origineOffre:struct<urlOrigine:string>>>"
)
JOBICY = (
    "jobs array<struct<id:long,url:string,jobTitle:string,companyName:string,jobIndustry:array<string>,jobType:array<string>,jobGeo:string,"
    "jobLevel:string,jobDescription:string,jobExcerpt:string,pubDate:string,salaryMin:double,salaryMax:double,salaryCurrency:string,"
    "salaryPeriod:string>>"
)
LEVER_WORKPLACES = {"remote": "full_remote", "hybrid": "hybrid", "on-site": "onsite", "onsite": "onsite"}
ASHBY_WORKPLACES = {"remote": "full_remote", "hybrid": "hybrid", "onsite": "onsite"}
ASHBY_EMPLOYMENT = {"intern": "internship", "temporary": "cdd"}
SR_EMPLOYMENT = {"permanent": "cdi", "intern": "internship", "internship": "internship", "temporary": "cdd", "apprenticeship": "apprenticeship"}
SR_LEVELS = {"internship": "junior", "entry_level": "junior", "associate": "mid", "mid_senior_level": "senior", "director": "lead", "executive": "lead"}
SR_TITLES = r"(?i)d[ée]v|engineer|ing[ée]nieur|front|full.?stack|react|javascript|typescript|node|web|software|logiciel|programm"
RECRUITEE_EMPLOYMENT = {
    "fulltime_permanent": "cdi", "parttime_permanent": "cdi", "fulltime_fixed_term": "cdd", "parttime_fixed_term": "cdd",
    "fulltime_temporary": "cdd", "internship": "internship", "traineeship": "internship", "apprenticeship": "apprenticeship",
    "freelance": "freelance", "contract": "freelance",
}
RECRUITEE_LEVELS = {"student": "junior", "entry_level": "junior", "mid_level": "mid", "experienced": "senior", "manager": "lead", "executive": "lead"}
TEAMTAILOR_REMOTE = {"none": "onsite", "hybrid": "hybrid", "fully": "full_remote", "full": "full_remote", "remote": "full_remote"}
FT_CONTRACTS = {"CDI": "cdi", "CDD": "cdd", "MIS": "cdd", "SAI": "cdd", "LIB": "freelance", "FRA": "freelance", "CCE": "freelance", "REP": "freelance"}
FT_SITE = "https://candidat.francetravail.fr"
JOBICY_LEVELS = {"senior": "senior", "midweight": "mid", "junior": "junior", "lead": "lead"}
JOBICY_SCOPES = {"france": r"\bfrance\b", "europe": r"\b(?:europe|emea|eu)\b", "worldwide": r"\b(?:anywhere|worldwide)\b"}


def named(value: Column, names: dict[str, str]) -> Column:
    """The value's entry; null without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.coalesce(value, F.lit("")))


def present(*values: Column) -> Column:
    """The values that are not null or empty, as an array."""
    return F.filter(F.array(*values), lambda x: x.isNotNull() & (x != ""))


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _items(payloads: DataFrame, schema: str, field: str | None) -> DataFrame:
    """One row ``j`` per item; a body that does not parse has none."""
    parsed = F.from_json("body", schema)
    rows = payloads.select("source_id", "company", "slug", F.explode(parsed[field] if field else parsed).alias("j"))
    return rows.filter("j is not null")


def _draft(rows: DataFrame, **columns: Column) -> DataFrame:
    return drafted(rows, ("source_id",), **columns)


def greenhouse(payloads: DataFrame) -> DataFrame:
    """Content is escaped HTML; what metadata says on places of work goes to the location."""
    j = F.col("j")

    def meta(pattern: str) -> Column:
        found = F.filter(j["metadata"], lambda m: m["name"].rlike(pattern))
        return F.try_element_at(found, F.lit(1))["value"]

    extra = join_present(" ", meta("(?i)work ?place|remote"), meta("(?i)location type"))
    return _draft(
        _items(payloads, GREENHOUSE, "jobs"),
        external_id=j["id"].cast("string"), url=j["absolute_url"], apply_url=j["absolute_url"], title=j["title"],
        company_name=F.coalesce(j["company_name"], "company"), location_raw=F.nullif(join_present(" — ", j["location"]["name"], extra), F.lit("")),
        description=html_to_text(j["content"]), salary_raw=meta("(?i)salary|pay|compensation"),
        tags=F.transform(j["departments"], lambda d: d["name"]), published_at=j["first_published"], source_updated_at=j["updated_at"],
    )


def lever(payloads: DataFrame) -> DataFrame:
    j = F.col("j")
    lists = F.array_join(F.transform(j["lists"], lambda x: F.concat(_or_empty(x["text"]), F.lit("\n"), html_to_text(x["content"]))), "\n\n")
    pay, where = j["salaryRange"], j["categories"]
    number = lambda x: _or_empty(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")))
    shown = F.concat(number(pay["min"]), F.lit("-"), number(pay["max"]), F.lit(" "), _or_empty(pay["currency"]), F.lit(" "), _or_empty(pay["interval"]))
    return _draft(
        _items(payloads, LEVER, None),
        external_id=j["id"], url=j["hostedUrl"], apply_url=F.coalesce(j["applyUrl"], j["hostedUrl"]), title=j["text"], company_name=F.col("company"),
        location_raw=F.when(F.size(where["allLocations"]) > 0, F.array_join(where["allLocations"], " / ")).otherwise(where["location"]),
        country=j["country"], description=join_present("\n\n", F.coalesce(j["descriptionPlain"], html_to_text(j["description"])), lists, j["additionalPlain"]),
        remote_policy=named(F.lower(j["workplaceType"]), LEVER_WORKPLACES), contract_type=classify.contract_from_label(where["commitment"]),
        salary_raw=F.when(pay.isNotNull(), shown), tags=present(where["team"], where["department"]), published_at=j["createdAt"].cast("string"),
    )


def ashby(payloads: DataFrame) -> DataFrame:
    """Postings that are not listed are left out."""
    j = F.col("j")
    places = F.concat(F.array(j["location"]), F.coalesce(F.transform(j["secondaryLocations"], lambda x: x["location"]), F.array().cast("array<string>")))
    workplace = F.regexp_replace(F.lower(j["workplaceType"]), "[^a-z]", "")
    return _draft(
        _items(payloads, ASHBY, "jobs").filter(F.coalesce(j["isListed"], F.lit(True))),
        external_id=j["id"], url=j["jobUrl"], apply_url=F.coalesce(j["applyUrl"], j["jobUrl"]), title=j["title"], company_name=F.col("company"),
        location_raw=F.nullif(F.array_join(F.filter(places, lambda x: x != ""), " / "), F.lit("")), country=j["address"]["postalAddress"]["addressCountry"],
        description=F.coalesce(j["descriptionPlain"], html_to_text(j["descriptionHtml"])),
        remote_policy=F.coalesce(named(workplace, ASHBY_WORKPLACES), F.when(j["isRemote"], "full_remote")),
        contract_type=named(F.lower(j["employmentType"]), ASHBY_EMPLOYMENT), salary_raw=j["compensation"]["scrapeableCompensationSalarySummary"],
        tags=present(j["department"], j["team"]), published_at=j["publishedAt"],
    )


def overlaid(left: Column, right: Column, fields: list[str]) -> Column:
    """A struct with the right side's fields where they are there, else the left side's."""
    return F.struct(*[F.coalesce(right[f], left[f]).alias(f) for f in fields])


def smartrecruiters(payloads: DataFrame, details: DataFrame) -> DataFrame:
    """A list item under its detail, which is there only for titles that may fit; ``details`` has source_id and body."""
    items = _items(payloads, SMARTRECRUITERS, "content")
    fields = items.select("j.*").columns
    full = details.select("source_id", F.from_json("body", f"struct<{POSTING}>").alias("d")).filter("d.id is not null")
    full = full.groupBy("source_id", F.col("d.id").alias("id")).agg(F.any_value("d").alias("d"))
    rows = items.withColumn("id", F.when(F.col("j.name").rlike(SR_TITLES), F.col("j.id"))).join(full, ["source_id", "id"], "left")
    rows = rows.withColumn("j", overlaid(F.col("j"), F.col("d"), fields)).drop("d", "id")
    j = F.col("j")
    parts = j["jobAd"]["sections"]
    sections = [parts[s] for s in ("jobDescription", "qualifications", "additionalInformation", "companyDescription")]
    shown = [F.when(_or_empty(x["text"]) != "", F.concat(_or_empty(x["title"]), F.lit("\n"), html_to_text(x["text"]))) for x in sections]
    place = j["location"]
    url = F.coalesce(j["postingUrl"], F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.url_encode("slug"), F.lit("/"), j["id"]))
    return _draft(
        rows,
        external_id=j["id"], url=url, apply_url=F.coalesce(j["applyUrl"], url), title=j["name"], company_name=F.coalesce(j["company"]["name"], "company"),
        location_raw=F.coalesce(place["fullLocation"], F.nullif(join_present(", ", place["city"], place["country"]), F.lit(""))), country=place["country"],
        description=F.concat_ws("\n\n", *shown), remote_policy=F.when(place["remote"], "full_remote").when(place["hybrid"], "hybrid"),
        contract_type=named(j["typeOfEmployment"]["id"], SR_EMPLOYMENT), seniority=named(j["experienceLevel"]["id"], SR_LEVELS),
        tags=present(j["department"]["label"]), published_at=j["releasedDate"],
    )


def recruitee(payloads: DataFrame) -> DataFrame:
    """Published offers; a flag that is null is not set."""
    j = F.col("j")
    remote, hybrid, onsite = (F.coalesce(j[c], F.lit(False)) for c in ("remote", "hybrid", "on_site"))
    pay = j["salary"]
    return _draft(
        _items(payloads, RECRUITEE, "offers").filter(F.coalesce(F.nullif(j["status"], F.lit("")), F.lit("published")) == "published"),
        external_id=j["id"].cast("string"), url=j["careers_url"], apply_url=F.coalesce(j["careers_apply_url"], j["careers_url"]), title=j["title"],
        company_name=F.coalesce(j["company_name"], "company"), location_raw=F.coalesce(j["location"], j["city"]), country=j["country_code"],
        description=join_present("\n\n", html_to_text(j["description"]), html_to_text(j["requirements"])),
        remote_policy=F.when(remote & ~hybrid & ~onsite, "full_remote").when(hybrid, "hybrid").when(onsite & ~remote, "onsite"),
        contract_type=named(j["employment_type_code"], RECRUITEE_EMPLOYMENT), seniority=named(j["experience_code"], RECRUITEE_LEVELS),
        salary=numbers.salary_from_numbers(pay["min"], pay["max"], pay["currency"], pay["period"]),
        tags=F.concat(present(j["department"]), F.filter(F.coalesce(j["tags"], F.array().cast("array<string>")), lambda t: t != "")),
        published_at=j["published_at"], source_updated_at=j["updated_at"],
    )


def teamtailor(payloads: DataFrame) -> DataFrame:
    """RSS: an item is cut out of the feed and parsed by itself, without namespaces; a plain guid has no attributes."""
    item = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<item(?:\s[^>]*)?>.*?</item>"), F.lit(0)))
    rows = payloads.select("source_id", "company", item.alias("xml"))
    parsed = F.from_xml("xml", TEAMTAILOR, {"rowTag": "item", "ignoreNamespace": "true"})
    rows = rows.select("source_id", "company", parsed.alias("j"))
    j = F.col("j")
    places = F.filter(F.transform(j["locations"]["location"], lambda x: F.coalesce(x["name"], x["city"])), lambda x: x != "")
    return _draft(
        rows,
        external_id=F.coalesce(j["guid"]["_VALUE"], j["link"]), url=j["link"], apply_url=j["link"], title=j["title"], company_name=F.col("company"),
        location_raw=F.nullif(F.array_join(places, " / "), F.lit("")), country=F.try_element_at(j["locations"]["location"], F.lit(1))["country"],
        description=html_to_text(j["description"]), remote_policy=named(F.lower(j["remoteStatus"]), TEAMTAILOR_REMOTE),
        tags=present(j["department"], j["role"]), published_at=j["pubDate"],
    )


def france_travail(payloads: DataFrame) -> DataFrame:
    j = F.col("j")
    own = F.concat(F.lit(f"{FT_SITE}/offres/recherche/detail/"), F.url_encode(j["id"]))
    url = F.when(j["origineOffre"]["urlOrigine"].startswith(FT_SITE), j["origineOffre"]["urlOrigine"]).otherwise(own)
    years = F.when(_or_empty(j["experienceLibelle"]) != "", F.concat(F.lit("\nExpérience : "), j["experienceLibelle"], F.lit(" d'expérience")))
    return _draft(
        _items(payloads, FRANCE_TRAVAIL, "resultats"),
        external_id=j["id"], url=url, apply_url=url, title=j["intitule"], company_name=j["entreprise"]["nom"],
        location_raw=F.when(_or_empty(j["lieuTravail"]["libelle"]) != "", F.concat(j["lieuTravail"]["libelle"], F.lit(", France"))).otherwise("France"),
        country=F.lit("FR"), description=F.concat(_or_empty(j["description"]), _or_empty(years)),
        contract_type=F.when(j["alternance"], "apprenticeship").otherwise(named(j["typeContrat"], FT_CONTRACTS)),
        seniority=F.when(j["experienceExige"] == "D", "junior"), salary_raw=j["salaire"]["libelle"],
        tags=present(j["romeLibelle"], j["appellationlibelle"]), published_at=j["dateCreation"], source_updated_at=j["dateActualisation"],
    )


def jobicy(payloads: DataFrame) -> DataFrame:
    """Always remote; the place says from where."""
    j = F.col("j")
    place = fold(_or_empty(j["jobGeo"]))
    scope = F.when(place == "", "unknown")
    for name, pattern in JOBICY_SCOPES.items():
        scope = scope.when(place.rlike(pattern), name)
    return _draft(
        _items(payloads, JOBICY, "jobs"),
        external_id=j["id"].cast("string"), url=j["url"], apply_url=j["url"], title=j["jobTitle"], company_name=j["companyName"],
        location_raw=F.when(_or_empty(j["jobGeo"]) != "", F.concat(F.lit("Remote — "), j["jobGeo"])).otherwise("Remote"),
        description=html_to_text(F.coalesce(j["jobDescription"], j["jobExcerpt"])), remote_policy=F.lit("full_remote"), remote_scope=scope.otherwise("other"),
        contract_type=classify.contract_from_label(F.array_join(j["jobType"], " ")), seniority=named(F.lower(j["jobLevel"]), JOBICY_LEVELS),
        salary=numbers.salary_from_numbers(j["salaryMin"], j["salaryMax"], j["salaryCurrency"], j["salaryPeriod"]),
        tags=F.concat(F.coalesce(j["jobIndustry"], F.array().cast("array<string>")), F.array(F.lit("via Jobicy"))), published_at=j["pubDate"],
    )
