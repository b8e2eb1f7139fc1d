"""DuckDB SQL for the queries of single functions."""

from __future__ import annotations

from .oracle import POSTINGS, pick

_FLAG = "CASE x WHEN 'remote:unknown' THEN 'remote non précisé' WHEN 'contract:unknown' THEN 'contrat non précisé' WHEN 'geo:check_french_entity' THEN 'vérifier la possibilité d''un CDI en France' ELSE x END"
_NOW = "TIMESTAMP '2024-01-16 12:00:00'"


def spoken(minutes: str) -> str:
    hours = f"CAST(round({minutes} / 60.0::DOUBLE) AS BIGINT)"
    return f"CASE WHEN {minutes} < 60 THEN {minutes} || ' min' WHEN {hours} < 48 THEN {hours} || ' h' ELSE CAST(round({hours} / 24.0::DOUBLE) AS BIGINT) || ' j' END"


def minutes(later: str, earlier: str) -> str:
    return f"CAST(round((epoch_us({later}) - epoch_us({earlier})) / 60000000.0::DOUBLE) AS BIGINT)"


_AGO, _LEFT = minutes(_NOW, "sent"), minutes("sent", _NOW)

SQL: dict[str, str] = {
    "text_helpers": f"""WITH {POSTINGS}, u AS (SELECT *, external_id % 3 AS r3, 'menu <<' || title || ' a>> b>> end' AS marked, list_filter([CASE WHEN contract_type = 'unknown' THEN 'contract:unknown' END,
          CASE WHEN remote_policy = 'hybrid' AND regexp_matches(fl, '\\blyon\\b') THEN 'remote:hybrid_local' END, CASE WHEN remote_policy = 'unknown' THEN 'remote:unknown' END,
          CASE WHEN remote_scope = 'europe' THEN 'geo:check_french_entity' END], lambda x: x IS NOT NULL) AS fs FROM p)
      SELECT external_id, nullif(trim(coalesce(company_name, '')), '') AS company, substr(description, 1, 40) AS start,
        CASE r3 WHEN 0 THEN '<<' || title || ' a>> b>>' ELSE marked END AS slice, coalesce(nullif(trim(regexp_split_to_array(title || {pick((" | Site", " – Site", " - Site", "-Site", ""), "external_id")}, ' [|–-] ')[1]), ''), title) AS page_title,
        external_id || ': ' || coalesce(location_raw, '?') AS rendered, concat_ws(' / ', company_name, location_raw) AS joined, split_part(dedup_key, '|', 1) AS key_company,
        substr(sha256('https://jobs.example.com/' || external_id), 1, 40) AS capture_id, CASE WHEN r3 = 1 THEN 'hybrid' ELSE remote_policy END AS resolved,
        array_to_string(list_transform(fs, lambda x: {_FLAG}), '|') AS flags FROM u""",
    "time_helpers": f"""WITH u AS (SELECT event_id, date_trunc('second', ts) AS sent FROM events)
      SELECT event_id, CASE WHEN event_id % 6 < 4 THEN sent END AS read, CASE WHEN {_AGO} < 1 THEN 'à l''instant' ELSE 'il y a ' || {spoken(_AGO)} END AS ago,
        CASE WHEN sent <= {_NOW} THEN CASE WHEN {_AGO} < 1 THEN 'maintenant' ELSE 'dû depuis ' || {spoken(_AGO)} END ELSE 'dans ' || {spoken(_LEFT)} END AS until,
        strftime(sent, '%Y-%m-%dT%H:%M:%SZ') AS api, make_timestamp((epoch_us(sent) + epoch_us({_NOW})) // 2) AS middle FROM u""",
    "contact_pages": """SELECT page_id, 'https://www.host' || page_id || '.example/contact' AS link FROM pages
      UNION ALL SELECT page_id, 'https://www.host' || page_id || '.example/a/sub/page' || page_id FROM pages""",
    "mail_links": """WITH u AS (SELECT c_custkey, 'mailto:jobs@c' || c_custkey || '.example?subject=Hello%20there%20%26%20more&body=' || repeat('a%20b', CAST(c_custkey % 500 AS INTEGER)) AS link FROM customer)
      SELECT c_custkey, CASE WHEN length(link) <= 1800 THEN link END AS link, 'From: ' || CASE WHEN c_custkey % 2 = 0 THEN 'page' ELSE 'https://page' END || '.' AS notice FROM u""",
}
