"""DuckDB SQL for the feed queries: what each posting must hold, straight from the documents and not by way of payloads."""

from __future__ import annotations

from . import derive, feed_queries
from . import oracle_values as v
from .oracle import _NL, classified, country, first_of, fold, has, listed, pick, q, salary, white

BASE = f"""
b0 AS (SELECT doc_id AS id, source AS source_id, translate(text, '<>&', '   ') AS t, CAST(('0x' || substr(md5(coalesce(text, '')), 1, 8)) AS BIGINT) AS k FROM documents),
b1 AS (SELECT *, regexp_extract(t, '^[^.\\n]*') AS s FROM b0),
b AS (SELECT *, s || ' ' || {pick(derive.TITLES, "length(s)")} AS name, nullif({pick(derive.LOCATIONS, "k")}, '') AS place, {pick(derive.CONTRACTS, "k // 2")} AS phrase,
  nullif({pick(derive.REMOTES, "k // 3")}, '') AS policy, nullif({pick(derive.SALARIES, "k // 7")}, '') AS pay, 30000 + k % 40000 AS low,
  CAST(CAST(DATE '2024-01-01' + CAST(id % 90 AS INTEGER) AS DATE) AS VARCHAR) AS day, 'https://board.example.com/' || id AS link, 'Company of ' || source_id AS owner FROM b1)"""


def case(value: str, table: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in table.items()) + " END"


def label(value: str) -> str:
    return f"coalesce({first_of(fold(value), v.LABELS)}, 'unknown')"


def feed(columns: dict[str, str], where: str = "true", said: tuple[str, ...] = ()) -> str:
    """The posting of each row of ``b``; ``said`` are columns ``told_x`` that a vendor's own words fill."""
    told = {name: f"told_{name}" for name in said}
    amounts = salary("salary_raw")
    low, high = columns.pop("low", None), columns.pop("high", None)
    listing = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    sums = f", {low} AS low, {high} AS high" if low else ""
    shown = "low, high" if low else f"CAST({amounts[0]} AS DOUBLE) AS low, CAST({amounts[1]} AS DOUBLE) AS high"
    return f"""WITH {BASE}, d0 AS (SELECT source_id, {listing}{sums} FROM b WHERE {where}),
      d1 AS (SELECT * REPLACE ({white("title")} AS title, {white("description")} AS description, nullif(trim(location_raw), '') AS location_raw) FROM d0),
      d AS ({classified("d1", told)})
      SELECT source_id, external_id, url, title, nullif(trim(company_name), '') AS company_name, location_raw,
        coalesce({country("said_country")}, {country("trim(string_split(location_raw, ',')[-1])")}) AS country_code,
        remote_policy, remote_scope, contract_type, seniority, {shown}, sha256(description) AS description, tags, published FROM d"""


_LISTED = "concat_ws(' — ', place, policy)"
_JOB = {"title": "name", "url": "link", "published": "day"}
_TWO = f"concat_ws({_NL}, t, phrase)"
_LV = f"""concat_ws({_NL}, t, 'You bring', nullif({white("phrase")}, ''), policy)"""
_LV_PAY = "CASE WHEN k % 3 <> 0 THEN low || '-' || (low + 5000) || ' EUR per-year-salary' END"
_SR_LEVELS = {"senior": "", "mid_senior_level": "senior", "entry_level": "junior", "director": "lead", "associate": "mid"}
_RC_FIT = f"({pick(('EUR', 'USD', ''), 'k')} IN ('EUR', '') AND {pick(('year', 'month'), 'k // 3')} = 'year')"
_JB_GEO = pick(("France", "Europe, EMEA", "Anywhere", "USA", ""), "k")
_FT_PLACE = pick(("31 - TOULOUSE", "75 - Paris", ""), "k")
_CONFIG = {
    0: "'token=' || slug", 1: "'token=' || slug", 2: "'token=' || slug", 3: "'company=' || slug || '&region=eu'", 4: "'name=' || slug", 5: "'company=' || lower(slug)",
    6: "'feedUrl=https://' || lower(slug) || '.teamtailor.com/jobs.rss'", 8: "'company=' || slug",
}
_BOARDS = {0: "greenhouse", 1: "greenhouse", 2: "greenhouse", 3: "lever", 4: "ashby", 5: "recruitee", 6: "teamtailor", 8: "smartrecruiters"}


def board(index: str, slug: str) -> str:
    """The source id of the made-up address with that index, or null."""
    return f"CASE ({index}) % 11 " + " ".join(f"WHEN {i} THEN {q(kind + ':')} || lower({slug})" for i, kind in _BOARDS.items()) + " END"


_SHORT = "length(coalesce(text, '')) NOT BETWEEN 50 AND 200000"
_CANON = f"""CASE WHEN len(params) > 0 THEN base || '?' || array_to_string(params, '&') ELSE base END"""

SQL: dict[str, str] = {
    "feed_greenhouse": feed(
        _JOB | {"external_id": "CAST(id AS VARCHAR)", "company_name": "CASE WHEN k % 4 <> 0 THEN 'Own Name' ELSE owner END", "location_raw": _LISTED, "said_country": "NULL::VARCHAR",
        "description": f"concat_ws({_NL}, t, phrase || ' & more')", "salary_raw": "pay", "tags": "'Engineering|' || source_id"}
    ),
    "feed_lever": feed(
        _JOB | {"external_id": "'lv-' || id", "company_name": "owner", "location_raw": "place", "said_country": "'FR'", "description": _LV, "salary_raw": _LV_PAY, "tags": "'Data'",
        "told_remote_policy": case(f"lower({pick(feed_queries.WORKPLACES, 'k')})", {"remote": "full_remote", "hybrid": "hybrid", "on-site": "onsite"}),
        "told_contract_type": label(pick(feed_queries.COMMITMENTS, "k // 5"))}, said=("remote_policy", "contract_type")
    ),
    "feed_ashby": feed(
        _JOB | {"external_id": "'as-' || id", "company_name": "owner", "location_raw": "concat_ws(' / ', place, CASE WHEN k % 5 = 0 THEN 'Lille, France' END)",
        "said_country": pick(("France", "Germany", "", "Nowhere"), "k"), "description": _TWO, "salary_raw": "pay", "tags": "'Tech|Data'",
        "told_remote_policy": f"coalesce({case(pick(('onsite', 'hybrid', '', 'remote'), 'k // 3'), {'onsite': 'onsite', 'hybrid': 'hybrid', 'remote': 'full_remote'})}, CASE WHEN k % 6 = 0 THEN 'full_remote' END)",
        "told_contract_type": case("k % 4", {"1": "internship", "2": "cdd"}).replace("'1'", "1").replace("'2'", "2")}, where="k % 10 <> 0", said=("remote_policy", "contract_type")
    ),
    "feed_smartrecruiters": feed(
        _JOB | {"external_id": "'sr-' || id", "company_name": "CASE WHEN k % 2 = 0 THEN 'Listed Co' ELSE owner END", "location_raw": f"'Lyon, ' || {pick(('fr', 'de', 'es'), 'k')}",
        "url": f"CASE WHEN id % 2 = 0 AND hinted THEN link ELSE 'https://jobs.smartrecruiters.com/' || source_id || '/sr-' || id END",
        "said_country": pick(("fr", "de", "es"), "k"), "description": f"CASE WHEN id % 2 = 0 AND hinted THEN concat_ws({_NL}, 'The job', t, CASE WHEN phrase <> '' THEN 'Extra' || {_NL} || phrase END) ELSE '' END",
        "salary_raw": "NULL::VARCHAR", "tags": "'Data'", "told_remote_policy": "CASE k % 5 WHEN 0 THEN 'full_remote' WHEN 1 THEN 'hybrid' END",
        "told_contract_type": "CASE k % 4 WHEN 0 THEN 'cdi' WHEN 1 THEN 'internship' WHEN 3 THEN 'cdd' END", "told_seniority": f"nullif({case(pick(feed_queries.LEVELS, 'k'), _SR_LEVELS)}, '')"},
        said=("remote_policy", "contract_type", "seniority"),
    ).replace("FROM b WHERE true", "FROM (SELECT *, " + has("name", r"(?i)d[ée]v|engineer|ing[ée]nieur|front|full.?stack|react|javascript|typescript|node|web|software|logiciel|programm") + " AS hinted FROM b) WHERE true"),
    "feed_recruitee": feed(
        _JOB | {"external_id": "CAST(id AS VARCHAR)", "company_name": "owner", "location_raw": "place", "said_country": pick(("FR", "DE"), "k"), "description": _TWO, "tags": "'Tech|data'",
        "told_remote_policy": "CASE WHEN k % 2 = 0 AND k % 7 <> 0 AND k % 3 <> 0 THEN 'full_remote' WHEN k % 7 = 0 THEN 'hybrid' WHEN k % 3 = 0 AND k % 2 <> 0 THEN 'onsite' END",
        "told_contract_type": "CASE (k // 2) % 4 WHEN 0 THEN 'cdi' WHEN 1 THEN 'freelance' WHEN 2 THEN 'internship' END", "told_seniority": "CASE k % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'junior' END",
        "low": f"CASE WHEN {_RC_FIT} AND k % 4 <> 0 THEN CAST(low AS DOUBLE) END", "high": f"CASE WHEN {_RC_FIT} AND k % 8 <> 0 THEN CAST(low + 9000 AS DOUBLE) END"},
        where="k % 3 <> 1", said=("remote_policy", "contract_type", "seniority"),
    ),
    "feed_teamtailor": feed(
        _JOB | {"external_id": "CASE WHEN k % 4 = 1 THEN link ELSE 'tt-' || id END", "company_name": "owner", "location_raw": "concat_ws(' / ', place, 'Nice')", "said_country": "'France'",
        "description": _TWO, "salary_raw": "NULL::VARCHAR", "tags": "'Tech'", "told_remote_policy": "CASE k % 4 WHEN 0 THEN 'full_remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END"},
        said=("remote_policy",),
    ),
    "feed_france_travail": feed(
        _JOB | {"external_id": "'ft' || id", "company_name": f"nullif({pick(derive.COMPANIES, 'k')}, '')", "location_raw": f"CASE WHEN {_FT_PLACE} <> '' THEN {_FT_PLACE} || ', France' ELSE 'France' END", "said_country": "'FR'",
        "url": "CASE WHEN k % 2 = 0 THEN 'https://candidat.francetravail.fr/x/' || id ELSE 'https://candidat.francetravail.fr/offres/recherche/detail/ft' || id END",
        "description": f"t || {_NL} || 'Expérience : ' || {pick(('6 ans', '2 ans', 'Débutant accepté'), 'k // 2')} || ' d''expérience'", "salary_raw": "pay", "tags": "'Études'",
        "told_contract_type": "CASE WHEN k % 9 = 0 THEN 'apprenticeship' ELSE CASE k % 4 WHEN 0 THEN 'cdi' WHEN 1 THEN 'cdd' WHEN 2 THEN 'freelance' END END", "told_seniority": "CASE WHEN (k // 2) % 3 = 0 THEN 'junior' END"},
        said=("contract_type", "seniority"),
    ),
    "feed_jobicy": feed(
        _JOB | {"external_id": "CAST(id AS VARCHAR)", "company_name": "'Remote Co'", "location_raw": f"CASE WHEN {_JB_GEO} <> '' THEN 'Remote — ' || {_JB_GEO} ELSE 'Remote' END", "said_country": "NULL::VARCHAR",
        "description": "CASE WHEN k % 3 <> 0 THEN t ELSE phrase END", "tags": "'Engineering|via Jobicy'", "told_remote_policy": "'full_remote'",
        "told_remote_scope": "CASE k % 5 WHEN 0 THEN 'france' WHEN 1 THEN 'europe' WHEN 2 THEN 'worldwide' WHEN 3 THEN 'other' ELSE 'unknown' END",
        "told_contract_type": "CASE k % 4 WHEN 1 THEN 'freelance' WHEN 2 THEN 'internship' WHEN 3 THEN 'cdi' ELSE 'unknown' END", "told_seniority": "CASE k % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'mid' END",
        "low": "CASE WHEN (k // 3) % 2 = 0 THEN CAST(low AS DOUBLE) END", "high": "CASE WHEN (k // 3) % 2 = 0 AND k % 2 = 0 THEN CAST(low + 4000 AS DOUBLE) END"},
        said=("remote_policy", "remote_scope", "contract_type", "seniority"),
    ),
    "board_configs": f"""WITH s AS (SELECT s_suppkey, 'Co' || s_suppkey AS slug, s_suppkey % 11 AS i FROM supplier)
      SELECT s_suppkey, CASE i {" ".join(f"WHEN {i} THEN {q(k)}" for i, k in _BOARDS.items())} END AS kind, CASE WHEN i IN (5, 6) THEN lower(slug) ELSE slug END AS slug,
        {board("i", "slug")} AS source_id, CASE i {" ".join(f"WHEN {i} THEN {c}" for i, c in _CONFIG.items())} END AS config FROM s WHERE i NOT IN (7, 9, 10)""",
    "page_boards": f"""WITH p AS (SELECT page_id, url, page_id % 3 = 0 AS named, {board("page_id", "'p' || page_id")} AS a, {board("page_id + 4", "'p' || page_id")} AS b FROM pages),
      f AS (SELECT page_id, a AS source_id FROM p WHERE NOT named UNION SELECT page_id, b FROM p WHERE NOT named)
      SELECT page_id, source_id FROM f WHERE source_id IS NOT NULL
      UNION ALL SELECT page_id, 'teamtailor:' || split_part(regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^(?:www\\.|careers?\\.|jobs\\.)', ''), '.', 1) FROM p WHERE named""",
    "seed_sources": f"""WITH s AS (SELECT s_suppkey, s_name, {board("s_suppkey", "'S' || s_suppkey % 40")} AS source_id,
        replace({listed(feed_queries.HOSTS)}[CAST(s_suppkey % 11 AS INTEGER) + 1], '{{}}', 'S' || s_suppkey % 40) AS url FROM supplier),
      first AS (SELECT source_id, s_name AS label, split_part(source_id, ':', 1) AS kind FROM s WHERE source_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY url, s_name) = 1)
      SELECT source_id, kind, label FROM first WHERE source_id NOT IN (SELECT source_id FROM s WHERE s_suppkey % 5 = 0 AND source_id IS NOT NULL)
      UNION ALL SELECT DISTINCT 'feed-' || s_suppkey % 7, 'jobicy', 'feed-' || s_suppkey % 7 FROM supplier""",
    "captured": f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'ftp://x' ELSE url END AS url,
        CASE WHEN page_id % 11 = 0 THEN 'short' ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS text FROM pages),
      c AS (SELECT *, string_split(string_split(url, '#')[1], '?')[1] AS base,
        list_filter(string_split(regexp_extract(string_split(url, '#')[1], '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT {has("x", v.TRACKING)}) AS params FROM u),
      e AS (SELECT page_id, substr(sha256({_CANON}), 1, 40) AS id, concat_ws('|', CASE WHEN url = 'ftp://x' THEN 'url' END, CASE WHEN {_SHORT} THEN 'text' END) AS errors FROM c),
      f AS (SELECT *, CASE WHEN errors = '' THEN id END AS external_id FROM e)
      SELECT page_id, CASE WHEN errors <> '' THEN 'refused' WHEN external_id IN (SELECT id FROM e WHERE page_id % 5 = 0)
        OR page_id > min(page_id) OVER (PARTITION BY external_id) THEN 'duplicate' ELSE 'new' END AS outcome, errors, external_id, 'A title' AS title FROM f""",
    "window_halves": """WITH RECURSIVE w AS (
        SELECT TIMESTAMP '2024-01-01' AS a, TIMESTAMP '2024-01-31' AS z, 0 AS depth, (SELECT count(*) FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31') AS n
        UNION ALL
        SELECT h.a, h.z, h.depth, (SELECT count(*) FROM events WHERE ts BETWEEN h.a AND h.z) AS n FROM (
          SELECT CASE side WHEN 0 THEN a ELSE a + to_microseconds((epoch_us(z) - epoch_us(a)) // 2) END AS a, CASE side WHEN 0 THEN a + to_microseconds((epoch_us(z) - epoch_us(a)) // 2) ELSE z END AS z, depth + 1 AS depth
          FROM w, (VALUES (0), (1)) AS s(side) WHERE n > greatest((SELECT count(*) FROM events) // 6, 1) AND depth < 4) h)
      SELECT a AS start, z AS "end", n FROM w WHERE n <= greatest((SELECT count(*) FROM events) // 6, 1) OR depth = 4""",
    "quarantined": f"""WITH {BASE}, p AS (SELECT source_id, id, (id // 50) % 7 = 3 AS broken, id // 50 AS page FROM b)
      SELECT source_id, count(*) FILTER (NOT broken) AS fetched, count(*) FILTER (NOT broken AND id % 13 <> 0) AS written, count(*) FILTER (NOT broken AND id % 13 = 0) AS rejected,
        count(DISTINCT page) FILTER (broken) AS unreadable FROM p GROUP BY source_id""",
}
