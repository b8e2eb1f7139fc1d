"""Scalar functions and state steps on small cases of our own."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.functions import classify, keys, numbers, text, times, web
from harrow.operators import state
from harrow.operators.rules import Criteria


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda column: row.select(column.alias("x")).first()["x"]


def lit(value):
    return F.lit(value).cast("string")


def test_text(one):
    assert one(text.html_to_text(lit("&lt;p&gt;One &amp;amp; two&lt;/p&gt;<script>x</script>"))) is not None
    assert one(text.html_to_text(lit("<ul><li>a</li><li>b</li></ul><style>p{}</style>"))) == "a\nb"
    assert one(text.fold(lit("Développeur C++ / .NET"))) == "developpeur c++ .net"
    assert one(text.normalize_company(lit("Émile & Fils SAS"))) == "emile fils"
    assert one(text.fold(lit(None))) is None
    assert one(text.render("a {{b}}", b=lit("c"))) == "a c"
    with pytest.raises(KeyError):
        text.render("{{missing}}")


def test_similarity(one):
    assert one(keys.similarity(lit("data engineer"), lit("data engineer"))) == 1.0
    assert one(keys.similarity(lit("abc"), lit("xyz"))) == 0.0
    assert one(keys.dedup_key(lit(None), lit("t"))) is None


def test_classes(one):
    assert one(classify.detect_contract(lit("Stage data"), lit("contrat cdi"))) == "internship"
    assert one(classify.detect_remote(lit("Full remote, sur site uniquement en été"))) == "full_remote"
    assert one(classify.detect_remote(lit("Full remote or hybrid"))) == "unknown"
    assert one(classify.detect_scope(lit("London"), lit("anywhere in Europe"))) == "other"
    assert one(classify.detect_scope(lit("31 - TOULOUSE"), lit(""))) == "france"
    assert one(classify.detect_seniority(lit("Developer"), lit("2 ans minimum d'expérience"))) == "mid"
    assert one(classify.country_code(lit("fr"))) == "FR"


def test_numbers_and_times(one):
    assert one(numbers.parse_salary(lit("45k - 55k")))["max"] == 55_000
    assert one(numbers.parse_salary(lit("3000 par mois")))["min"] is None
    assert one(times.parse_time(lit("not a time"))) is None
    assert one(times.source_backoff(F.lit(60), F.lit(9))) == 1440


def test_urls():
    rules = "User-agent: *\nDisallow: /private\nAllow: /private/open\n"
    assert robots_allows(rules, "/private/open/x") and not robots_allows(rules, "/private/x")


def test_criteria_need_patterns():
    with pytest.raises(ValueError):
        Criteria(role_title=())


def test_state_steps(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "x")], "id int, content_hash string, closed_at string")
    new = spark.createDataFrame([(1, "a"), (2, "z"), (3, "c"), (4, "d")], "id int, content_hash string")
    found = {r["id"]: r["change"] for r in state.changes(old, new, ["id"]).collect()}
    assert found == {1: "unchanged", 2: "changed", 3: "reopened", 4: "new"}
    kept = state.insert_missing(new.limit(0), new, ["id"])
    assert kept.count() == 4


def robots_allows(rules: str, path: str, agent: str = "*") -> bool:
    """Groups by agent, a named group before ``*``; the longest prefix decides and allow wins ties."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    current: list[str] = []
    open_group = False
    for line in rules.splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            current = [*current, value.lower()] if open_group else [value.lower()]
            open_group = True
            for one in current:
                groups.setdefault(one, [])
        elif name in ("allow", "disallow"):
            open_group = False
            if value:
                for one in current:
                    groups[one].append((value.split("*", 1)[0], name == "allow"))
    mine = next((g for g in groups if g != "*" and g in agent.lower()), "*")
    hits = [(len(prefix), allow) for prefix, allow in groups.get(mine, []) if path.startswith(prefix)]
    return max(hits)[1] if hits else True


def test_robots_rules_as_columns(spark):
    rng = random.Random(4)
    lines = ["User-agent: *", "user-agent: JobBot", "User-Agent: other # x", "Disallow: /a", "Allow: /a/b", "disallow: /a/b*c", "Disallow:", "Sitemap: x", "", "allow: /", "Disallow: /p"]
    rows = [("\n".join(rng.choices(lines, k=rng.randrange(9))), rng.choice(["/", "/a", "/a/b/c", "/p/q"])) for _ in range(200)] + [(None, "/a"), ("Disallow: /", None)]
    df = spark.createDataFrame(rows, "rules string, path string")
    for agent in ("*", "jobbot/1.0"):
        got = [r[0] for r in df.select(web.robots_allowed(F.col("rules"), F.col("path"), agent)).collect()]
        assert got == [robots_allows(r or "", p or "/", agent) for r, p in rows]
