"""URLs, e-mail addresses, links and robots rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Query parameters that say where a visitor came from, by prefix; local parts of addresses that belong to a
# function and not to a person; those that suit an application best, in order; what a contact page's address or label says.
TRACKING = r"(?i)^(?:utm_|trk|ref|refId|trackingId|lipi|src|source|origin|eBP|position|pageNum|gclid|fbclid)"
GENERIC = (
    "jobs", "job", "careers", "career", "carriere", "carrieres", "recrutement", "recruitment", "recruiting", "recrute", "talent", "talents",
    "rh", "hr", "contact", "hello", "bonjour", "info", "team",
)
PREFERRED = (
    "jobs", "job", "recrutement", "recruitment", "recruiting", "recrute", "careers", "career", "carriere", "carrieres", "talent", "talents",
    "rh", "hr",
)
HINTS = r"(?i)contact|mentions?-?legales?|legal|imprint|carrieres?|careers?|jobs?|recrutement|rejoindre|join|about|a-propos"
#: An address starts where its word does, or where the last address ends; so a word without one is read once.
EMAIL = r"(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}"
#: Spelled-out signs in brackets, and with them the white space around: it is read from its first blank, or where the last sign ends.
AT, DOT = (rf"[\[({{]\s*(?:{words})\s*[\])}}]" for words in ("at|arobase", "dot|point"))
AROUND = r"(?i)(?:(?<!\s)|\G)\s*+{}\s*"
#: What counts as an address: no empty label in the host and no dot at the edges of the local part or twice in it.
ADDRESS = r"^[a-z0-9_%+-]+(?:\.[a-z0-9_%+-]+)*@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$"


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; a posting's id in a network's URL gives its one form."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    posting = F.coalesce(
        F.nullif(F.regexp_extract(bare, r"[?&]currentJobId=([^&]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(base, r"/jobs/view/(?:[^/]*-)?(\d+)", 1), F.lit("")),
    )
    network = base.rlike(r"^https?://(?:[a-zA-Z0-9-]+\.)*linkedin\.com(?:[:/]|$)")
    fixed = F.when(network, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), posting, F.lit("/")))
    rest = F.when(F.size(params) > 0, F.concat(base, F.lit("?"), F.array_join(params, "&"))).otherwise(base)
    return F.coalesce(fixed, rest)


def domain(url: Column) -> Column:
    full = F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(full, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def page_key(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(domain(url), F.regexp_replace(path, "/+$", ""))


def deobfuscate(text: Column) -> Column:
    """``@`` and ``.`` for the words in brackets that stand for them. A text without brackets is not matched."""
    bracketed = lambda t: t.contains("[") | t.contains("(") | t.contains("{")
    for sign, pattern in (("@", AT), (".", DOT)):
        around = AROUND.replace("{}", pattern)
        text = bound(text, lambda t: F.when(bracketed(t) & t.rlike(f"(?i){pattern}"), F.regexp_replace(t, around, sign)).otherwise(t))  # noqa: B023
    return text


def emails(text: Column) -> Column:
    """Distinct addresses in lower case, in order of the alphabet. A text without ``@`` has none."""
    none = F.array().cast("array<string>")
    found = bound(deobfuscate(text), lambda t: F.when(t.isNull() | t.contains("@"), F.regexp_extract_all(F.lower(t), F.lit(EMAIL), F.lit(0))).otherwise(none))
    found = F.transform(found, lambda e: F.regexp_replace(e, r"\.$", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: e.rlike(ADDRESS))))


def mailto_addresses(html: Column) -> Column:
    """The addresses of a page's mail links, in lower case and in its order."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?mailto:([^"'?>\s]*)"""), F.lit(1))
    lists = F.transform(hrefs, lambda h: F.split(F.coalesce(F.try_url_decode(h), F.lit("")), ","))
    return F.filter(F.transform(F.flatten(lists), lambda e: F.lower(F.trim(e))), lambda e: e.rlike(ADDRESS))


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def same_domain(email: Column, host: Column) -> Column:
    at = F.split_part(email, F.lit("@"), F.lit(2))
    return (at == F.lower(host)) | at.endswith(F.concat(F.lit("."), F.lower(host)))


def is_generic(email: Column) -> Column:
    return local_part(email).isin(*GENERIC)


def contact_priority(email: Column) -> Column:
    """Position in the list of preferred local parts; the list's length for others."""
    at = F.array_position(F.array(*[F.lit(x) for x in PREFERRED]), local_part(email))
    return F.when(at > 0, at - 1).otherwise(len(PREFERRED)).cast("int")


def generic_emails(html: Column, text: Column, host: Column) -> Column:
    """Addresses of functions at the host or below it, from mail links and then from the text, the most useful first.

    Addresses of one priority keep their order: mail links in the page's order, then the others by the alphabet.
    """
    every = F.array_distinct(F.concat(mailto_addresses(html), emails(text)))
    fit = F.filter(every, lambda e: is_generic(e) & same_domain(e, host))
    keyed = F.array_sort(F.transform(fit, lambda e, i: F.struct(contact_priority(e).alias("p"), i.alias("i"), e.alias("e"))))
    return F.transform(keyed, lambda x: x["e"])


def links(html: Column) -> Column:
    """The hrefs of a page in its order."""
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"#]+)'), F.lit(1))


def anchors(html: Column) -> Column:
    """structs (href, label) of a page's links in its order; a label has no markup."""
    whole = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']+["'][^>]*>.*?</a>"""), F.lit(0))
    href = lambda a: F.regexp_extract(a, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1)
    return F.transform(whole, lambda a: F.struct(href(a).alias("href"), F.trim(F.regexp_replace(a, "<[^>]*>", "")).alias("label")))


def resolve(href: Column, base: Column) -> Column:
    """An absolute address: of its own, by scheme, from the host's root or from the base's folder."""
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+(/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, folder, href))
    )


def candidate_pages(html: Column, url: Column) -> Column:
    """Pages of the same host whose address or label hints at contacts; distinct, without fragments."""
    hinted = F.filter(anchors(html), lambda a: a["href"].rlike(HINTS) | a["label"].rlike(HINTS))
    full = F.transform(hinted, lambda a: F.split_part(resolve(a["href"], url), F.lit("#"), F.lit(1)))
    return F.array_distinct(F.filter(full, lambda u: u.rlike(r"^https?://") & (domain(u) == domain(url))))


def privacy_notice(template: str, source: Column) -> Column:
    """The notice that says where an address was found; the mark of one typed in is left out."""
    from .text import render

    return render(template, source=F.regexp_replace(source, "^manual:", ""))


def mailto(to: Column, subject: Column, body: Column, most: int = 1800) -> Column:
    code = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    link = F.concat(F.lit("mailto:"), to, F.lit("?subject="), code(subject), F.lit("&body="), code(body))
    return F.when(F.length(link) <= most, link)


_RULE = "struct<agent:string,prefix:string,allow:boolean>"


def robots_allowed(rules: Column, path: Column, agent: str = "*") -> Column:
    """May ``agent`` read ``path``? A group that names it goes before ``*``; the longest prefix decides and allow wins ties.

    The lines are folded into (agent, prefix, allow) of each group. Null rules allow all, and a null path is the root.
    """
    lines = F.filter(
        F.transform(
            F.split(F.coalesce(rules, F.lit("")), r"\r\n|\n|\r"),
            lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:#]*):", 1))).alias("name"), F.trim(F.regexp_extract(x, "^[^:#]*:([^#]*)", 1)).alias("value")),
        ),
        lambda x: x["name"].isin("user-agent", "allow", "disallow"),
    )
    nothing = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("naming"), F.array().cast(f"array<{_RULE}>").alias("rules"))

    def step(at: Column, x: Column) -> Column:
        names = x["name"] == "user-agent"
        value = F.lower(x["value"])
        agents = F.when(names & at["naming"], F.concat(at["agents"], F.array(value))).when(names, F.array(value)).otherwise(at["agents"])
        # a group without rules is a group, too: its prefix is null
        rule = lambda a, prefix: F.struct(a.alias("agent"), prefix.alias("prefix"), (x["name"] == "allow").alias("allow"))
        prefix = F.when(~names, F.split_part(x["value"], F.lit("*"), F.lit(1)))
        added = F.when(names, F.array(rule(value, prefix))).when(x["value"] != "", F.transform(at["agents"], lambda a: rule(a, prefix))).otherwise(F.array().cast(f"array<{_RULE}>"))
        return F.struct(agents.alias("agents"), names.alias("naming"), F.concat(at["rules"], added).alias("rules"))

    found = F.aggregate(lines, nothing, step)["rules"]
    named = F.filter(found, lambda r: (r["agent"] != "*") & F.contains(F.lit(agent.lower()), r["agent"]))
    mine = F.coalesce(F.try_element_at(named, F.lit(1))["agent"], F.lit("*"))
    hits = F.filter(found, lambda r: (r["agent"] == mine) & r["prefix"].isNotNull() & F.startswith(F.coalesce(path, F.lit("/")), r["prefix"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))
