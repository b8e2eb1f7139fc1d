"""DuckDB SQL for the registered queries, written from their meaning.

It shares with the DataFrame code only the phrases from which ``derive`` makes its rows; lists and patterns of the
rules are in ``oracle_values``, written out again.
"""

from __future__ import annotations

from . import derive
from . import oracle_values as v

_NL = "chr(10)"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A Java pattern as an RE2 literal."""
    return q(pattern.replace(r"\x0B", r"\x{0B}"))


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"{listed(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def sub(value: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        value = f"regexp_replace({value}, {rx(pattern)}, {to if to == _NL else q(to)}, 'g')"
    return value


def has(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {rx(pattern)})"


def fold(value: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({value})), '[^a-z0-9+#.]+', ' ', 'g'))"


def white(value: str) -> str:
    blank = r"[\t\f\x0B\x{00A0}\x{2009}\x{202F} ]+"
    return f"trim({sub(value, (chr(92) + 'r', ''), (blank, ' '), (' ?' + chr(92) + 'n ?', _NL), (chr(92) + 'n{2,}', _NL), ('^' + chr(92) + 'n|' + chr(92) + 'n$', ''))})"


def title_norm(value: str) -> str:
    for noise in v.NOISE:
        value = sub(value, (noise, " "))
    return f"trim({sub(fold(value), *v.WORDS, (' {2,}', ' '))})"


def company_norm(value: str) -> str:
    return f"trim({sub(f'''replace({fold(value)}, '.', ' ')''', (v.LEGAL, ' '), (' {2,}', ' '))})"


def first_of(value: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {has(value, p)} THEN {q(n)}" for n, p in table) + " END"


def contract(title: str, body: str) -> str:
    """Of folded columns."""
    weak = [("internship", v.INTERNSHIP), ("apprenticeship", v.APPRENTICESHIP), ("freelance", v.FREELANCE), ("cdd", v.CDD)]
    return f"coalesce({first_of(title, [*weak, ('cdi', v.CDI)])}, {first_of(body, [('cdi', v.CDI_IN_BODY), *weak])}, 'unknown')"


def seniority(title: str, body: str) -> str:
    years = f"TRY_CAST(nullif(regexp_extract({body}, {rx(v.YEARS)}, 1), '') AS INTEGER)"
    return (
        f"coalesce({first_of(title, v.LEVELS)}, "
        f"CASE WHEN {years} >= 5 THEN 'senior' WHEN {years} >= 2 THEN 'mid' WHEN {years} IS NOT NULL THEN 'junior' END, 'unknown')"
    )


def remote(body: str) -> str:
    on, hy, fu = (has(body, p) for p in (v.ONSITE, v.HYBRID, v.FULL))
    return f"CASE WHEN {on} AND NOT {fu} THEN 'onsite' WHEN {hy} AND NOT {fu} THEN 'hybrid' WHEN {fu} AND NOT {hy} THEN 'full_remote' ELSE 'unknown' END"


def scope(p: str, b: str) -> str:
    return (
        f"CASE WHEN {has(p, v.ELSEWHERE)} THEN 'other' WHEN {has(p, v.IN_FRANCE)} THEN 'france' WHEN {has(p, v.IN_EUROPE)} THEN 'europe' "
        f"WHEN {has(p, v.ABROAD)} THEN 'other' WHEN {has(p, v.ANYWHERE)} AND NOT {has(b, v.ELSEWHERE)} THEN 'worldwide' "
        f"WHEN {has(b, v.ELSEWHERE)} THEN 'other' WHEN {has(b, v.IN_FRANCE)} THEN 'france' WHEN {has(b, v.IN_EUROPE)} THEN 'europe' "
        f"WHEN {has(b, v.ANYWHERE)} THEN 'worldwide' ELSE 'unknown' END"
    )


def country(value: str) -> str:
    name = fold(value)
    cases = " ".join(f"WHEN {name} = {q(n)} OR ends_with({name}, {q(' ' + n)}) THEN {q(code)}" for n, code in v.COUNTRIES)
    return f"CASE WHEN {has(f'trim({value})', '^[A-Za-z]{2}$')} THEN upper(trim({value})) ELSE CASE {cases} END END"


def amounts(raw: str) -> str:
    number = r"regexp_replace(x, '[\s\x{00A0}\x{202F}k]', '', 'g')"
    plain = f"CASE WHEN regexp_matches({number}, '^\\d{{1,3}}(?:\\.\\d{{3}})+$') THEN replace({number}, '.', '') ELSE replace({number}, ',', '.') END"
    value = f"round(TRY_CAST({plain} AS DOUBLE) * (CASE WHEN ends_with(x, 'k') THEN 1000.0 ELSE 1.0 END))"
    found = f"list_transform(regexp_extract_all(lower({raw}), {rx(v.AMOUNT)}), lambda x: {value})"
    return f"CASE WHEN {has(f'lower({raw})', v.OTHER_PERIOD)} THEN [] ELSE list_filter({found}, lambda n: n >= 15000 AND n <= 300000) END"


def salary(raw: str) -> tuple[str, str]:
    """The lower and the upper amount of a raw text; one amount has no upper one."""
    low, high = f"list_min({amounts(raw)})", f"list_max({amounts(raw)})"
    return f"CAST({low} AS INTEGER)", f"CASE WHEN {high} > {low} THEN CAST({high} AS INTEGER) END"


KIND = pick(derive.KINDS, "CAST(substr(source, 4) AS INTEGER)")
BEGIN = "TIMESTAMP '2024-01-01'"
AS_OF = f"TIMESTAMP '{derive.AS_OF:%Y-%m-%d}'"



def classified(rows: str, told: dict[str, str] | None = None) -> str:
    """``rows`` (title, location_raw, description and what a feed tells) with folded texts and what the rules find in them."""
    told = told or {}
    say = lambda name, found: f"coalesce(nullif({told[name]}, 'unknown'), {found})" if name in told else found
    all_, context = "trim(regexp_replace(ft || ' ' || fb, ' +', ' ', 'g'))", "trim(regexp_replace(ft || ' ' || fl || ' ' || fb, ' +', ' ', 'g'))"
    return f"""SELECT *, {say("contract_type", contract("ft", "fb"))} AS contract_type, {say("seniority", seniority("ft", "fb"))} AS seniority,
      {say("remote_policy", remote(context))} AS remote_policy, {say("remote_scope", scope("fl", all_))} AS remote_scope, {all_} AS fa
    FROM (SELECT *, {fold("title")} AS ft, {fold("coalesce(location_raw, '')")} AS fl, {fold("description")} AS fb FROM {rows})"""


# The postings, step by step.
_LOW, _HIGH = salary("salary_raw")
POSTINGS = f"""
p0 AS (SELECT *, CAST(('0x' || substr(md5(coalesce(text, '')), 1, 8)) AS BIGINT) AS k, regexp_extract(text, '^[^.\\n]*') AS s FROM documents),
p1 AS (
  SELECT doc_id AS external_id, source AS source_id, {KIND} AS source_kind, k, nullif({pick(derive.COMPANIES, "length(s)")}, '') AS company_name,
    {white("s || " + pick(derive.SUFFIXES, "k") + " || ' ' || " + pick(derive.TITLES, "length(s)"))} AS title,
    nullif({pick(derive.LOCATIONS, "k")}, '') AS location_raw, nullif({pick(derive.SALARIES, "k // 7")}, '') AS salary_raw,
    {pick(derive.CONTRACTS, "k // 2")} AS contract_text,
    {white(f"concat_ws({_NL}, text, {pick(derive.CONTRACTS, 'k // 2')}, {pick(derive.REMOTES, 'k // 3')}, {pick(derive.EXTRAS, 'k // 5')})")} AS description,
    {BEGIN} + to_days(CAST(doc_id % 90 AS INTEGER)) AS first_seen,
    {BEGIN} + to_days(CAST(doc_id % 90 + doc_id % 40 AS INTEGER)) AS last_seen
  FROM p0),
p2 AS (
  SELECT *, CASE WHEN external_id % 11 = 0 THEN last_seen END AS closed_at, {title_norm("title")} AS title_norm, {company_norm("company_name")} AS company_norm
  FROM p1),
p3 AS ({classified("p2")}),
p AS (
  SELECT *, {country("trim(string_split(location_raw, ',')[-1])")} AS country_code, {_LOW} AS low, {_HIGH} AS high,
    sha256(title_norm || {_NL} || coalesce(company_norm, '') || {_NL} || description) AS content_hash,
    CASE WHEN coalesce(company_norm, '') <> '' THEN company_norm || '|' || title_norm
         ELSE 'anon|' || sha256(source_id || '|' || CAST(external_id AS VARCHAR)) END AS dedup_key
  FROM p3)"""


def hits(value: str, patterns) -> str:
    return "(" + " + ".join(f"CAST({has(value, p)} AS INTEGER)" for p in patterns) + ")"


def first_pattern(value: str, patterns, prefix: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(value, p)} THEN {q(prefix + p)}" for p in patterns) + " END"


JUDGED = (
    POSTINGS
    + f""",
j2 AS (
  SELECT *, {hits("fa", v.REQUIRED)} AS req, {hits("fa", v.PREFERRED)} AS pref, {hits("fl", v.LOCAL)} > 0 AS local,
    remote_policy IN ('hybrid', 'onsite') AS away FROM p),
j3 AS (
  SELECT *,
    list_filter([
      CASE WHEN contract_type IN ('internship', 'apprenticeship', 'freelance', 'cdd') THEN 'contract:' || contract_type END,
      CASE WHEN away AND NOT local THEN 'remote:' || remote_policy END,
      CASE WHEN remote_scope IN ('other') THEN 'geo:' || remote_scope END,
      CASE WHEN NOT {hits("ft", v.ROLE)} > 0 THEN 'role:not_dev' END,
      {first_pattern("ft", v.NOT_IN_TITLE, "stack_exclusion:")},
      CASE WHEN req = 0 THEN 'stack_required:none' END,
      {first_pattern("ft", v.NOT_LEVEL, "seniority:")},
      CASE WHEN {fold("company_name")} = {fold(q(v.NOT_COMPANY))} THEN {q("company_exclusion:" + v.NOT_COMPANY)} END
    ], lambda x: x IS NOT NULL) AS reasons,
    list_filter([
      CASE WHEN contract_type = 'unknown' THEN 'contract:unknown' END,
      CASE WHEN remote_policy = 'hybrid' AND local THEN 'remote:hybrid_local' END,
      CASE WHEN remote_policy = 'unknown' THEN 'remote:unknown' END,
      CASE WHEN remote_scope = 'europe' THEN 'geo:check_french_entity' END
    ], lambda x: x IS NOT NULL) AS flags,
    CAST(least(greatest(40 + 8 * least(req, 4) + 5 * least(pref, 2)
      + CASE WHEN remote_policy = 'full_remote' THEN 15 ELSE 0 END + CASE WHEN remote_scope = 'france' THEN 5 ELSE 0 END
      + CASE WHEN local AND NOT away THEN 5 ELSE 0 END + CASE WHEN contract_type = 'cdi' THEN 5 ELSE 0 END
      + CASE WHEN seniority IN ('senior', 'lead') THEN 8 WHEN seniority = 'mid' THEN 3 WHEN seniority = 'junior' THEN -15 ELSE 0 END
      - 5 * least({hits("fa", v.NOT_IN_TEXT)}, 4), 0), 100) AS INTEGER) AS rule_score,
    {hits("fa", v.REQUIRED + v.PREFERRED)} AS matched
  FROM j2),
j AS (SELECT *, CASE WHEN len(reasons) > 0 AND source_kind <> 'capture' THEN 'rejected' ELSE 'passed' END AS status FROM j3)"""
)

PRIORITY = "CASE WHEN source_kind IN (" + ", ".join(map(q, v.BOARD_KINDS)) + ") THEN 0 WHEN source_kind = 'capture' THEN 1 WHEN source_kind = 'france_travail' THEN 2 ELSE 3 END"
_TRIAGE = listed(("new", "new", "dismissed", "interested", "new", "applied"))

HEADS = (
    JUDGED
    + f""",
m1 AS (SELECT *, min(external_id) OVER (PARTITION BY dedup_key) AS cluster_id FROM j),
m AS (
  SELECT *, {_TRIAGE}[CAST(cluster_id % 6 AS INTEGER) + 1] AS triage,
    (CASE WHEN status = 'passed' THEN 0 ELSE 10 END) + (CASE WHEN closed_at IS NOT NULL THEN 5 ELSE 0 END) + {PRIORITY} AS rank FROM m1),
h AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY rank, first_seen, source_id, external_id) = 1)"""
)

CACHE = """,
cache AS (
  SELECT p.content_hash, CAST(40 + 50 * quality - 30 * toxic + p.external_id % 10 AS INTEGER) AS score,
    CASE WHEN p.external_id % 17 = 0 THEN 'failed' ELSE 'ok' END AS score_state,
    CASE WHEN toxic = 1 THEN 'hybrid_or_onsite' WHEN p.external_id % 13 = 0 THEN 'remote_but_geo_incompatible' WHEN p.external_id % 3 = 0 THEN 'full_remote_france_ok' END AS remote_verdict,
    CASE WHEN quality = 0 AND p.external_id % 2 = 0 THEN 'not_cdi' WHEN p.external_id % 4 = 0 THEN 'cdi' END AS contract_verdict,
    3000 + p.external_id % 1000 AS input_tokens, 200 + p.external_id % 100 AS output_tokens, p.external_id % 3 AS attempts
  FROM p JOIN labels ON labels.doc_id = p.external_id
  QUALIFY row_number() OVER (PARTITION BY p.content_hash ORDER BY p.external_id DESC) = 1)"""

SCORED = HEADS + CACHE + ", hs AS (SELECT h.*, cache.* EXCLUDE (content_hash) FROM h LEFT JOIN cache USING (content_hash))"
HIDDEN = (
    "coalesce((remote_verdict IN ('hybrid_or_onsite', 'remote_but_geo_incompatible') AND (remote_verdict <> 'hybrid_or_onsite' "
    "OR NOT list_contains(flags, 'remote:hybrid_local'))) OR contract_verdict = 'not_cdi', false)"
)
INBOX = SCORED + ", inbox AS (SELECT * FROM hs WHERE triage = 'new' AND status = 'passed' AND closed_at IS NULL)"
LEVEL = "CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 65 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score IS NOT NULL THEN 'weak' END"
REJECTED = JUDGED + f", rej AS (SELECT * FROM j WHERE status = 'rejected' AND first_seen > {AS_OF} - INTERVAL 60 DAY)"
_LABELS = "CASE {0} " + " ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in v.REASONS) + " ELSE {0} END"


def joined(value: str) -> str:
    return f"array_to_string({value}, '|')"


_POLICY = "CASE remote_policy WHEN 'full_remote' THEN 'Full remote' WHEN 'hybrid' THEN 'Hybride' WHEN 'onsite' THEN 'Sur site' ELSE 'Remote ?' END"
_REMOTE_FACT = (
    f"""CASE remote_verdict WHEN 'full_remote_france_ok' THEN 'Full remote France' WHEN 'hybrid_or_onsite' THEN 'Hybride / sur site'
      WHEN 'remote_but_geo_incompatible' THEN 'Remote hors zone' WHEN 'unclear' THEN 'Remote incertain' ELSE {_POLICY} END""",
    "CASE coalesce(remote_verdict, remote_policy) WHEN 'full_remote_france_ok' THEN 'good' WHEN 'full_remote' THEN 'good' WHEN 'unclear' THEN 'warn' WHEN 'unknown' THEN 'warn' ELSE 'bad' END",
)
_CONTRACT = "CASE contract_type WHEN 'cdd' THEN 'CDD' WHEN 'freelance' THEN 'Freelance' WHEN 'internship' THEN 'Stage' WHEN 'apprenticeship' THEN 'Alternance' ELSE 'Autre' END"
_CONTRACT_FACT = (
    f"""CASE WHEN contract_verdict = 'not_cdi' THEN CASE WHEN contract_type IN ('cdi', 'unknown') THEN 'Pas un CDI' ELSE {_CONTRACT} END
      WHEN contract_type = 'cdi' OR contract_verdict = 'cdi' THEN 'CDI' WHEN contract_type = 'unknown' THEN 'Contrat non précisé' ELSE {_CONTRACT} END""",
    "CASE WHEN contract_verdict = 'not_cdi' THEN 'bad' WHEN contract_type = 'cdi' OR contract_verdict = 'cdi' THEN 'good' WHEN contract_type = 'unknown' THEN 'warn' ELSE 'bad' END",
)
_INBOX_ORDER = "score DESC NULLS LAST, rule_score DESC, first_seen DESC, cluster_id"

_STATES = {"automobile": "none", "building": "to_contact", "furniture": "contacted", "household": "replied", "machinery": "closed"}
COMPANIES = f"""
co AS (SELECT c_custkey AS company_id, c_name AS name, {company_norm("c_name")} AS name_norm, n_name AS city,
  lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS siren, 'c' || c_custkey || '.example.com' AS domain,
  CASE lower(c_mktsegment) {" ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in _STATES.items())} ELSE 'none' END AS outreach
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SOURCES = f"""
so AS (SELECT {pick(derive.KINDS, "s_suppkey")} || ':' || s_suppkey AS source_id, {pick(derive.KINDS, "s_suppkey")} AS kind, s_name AS label,
  s_suppkey AS company_id, s_suppkey % 7 <> 0 AS enabled, [60, 180, 360, 720][CAST(s_suppkey % 4 AS INTEGER) + 1] AS interval_minutes,
  CASE WHEN s_acctbal < 0 THEN s_suppkey % 5 + 1 ELSE 0 END AS failures,
  TIMESTAMP '2024-04-14' + to_hours(CAST(s_suppkey % 48 AS INTEGER)) AS last_run FROM supplier)"""
DELAY = "CAST(least(interval_minutes * pow(2.0, failures), 1440) AS INTEGER)"
RUNS = """
ru AS (SELECT o_orderkey AS run_id, 'src' || (o_custkey % 20) AS source_id, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'partial' ELSE 'running' END AS status,
  o_orderkey % 50 AS fetched, o_orderkey % 7 AS created, o_orderkey % 3 AS failed_items FROM orders)"""
_TO = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in derive.STATUS.items()) + " END"
APPS = f"""
ev AS (SELECT event_id, user_id AS application_id, {_TO} AS to_status, ts AS occurred_at, props FROM events),
ap AS (SELECT application_id, to_status AS status, occurred_at AS updated_at,
  CASE WHEN application_id % 3 <> 0 THEN application_id END AS cluster_id, 'External role ' || application_id AS external_title
  FROM ev QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY occurred_at DESC, event_id DESC) = 1)"""
PIPELINE = (
    HEADS + "," + APPS + "," + COMPANIES + """,
pi AS (SELECT ap.application_id, ap.status, ap.updated_at, coalesce(h.title, ap.external_title) AS title,
  coalesce(h.company_name, co.name, '?') AS company,
  CAST(ap.updated_at AS DATE) + CASE ap.status WHEN 'applied' THEN 7 WHEN 'followed_up' THEN 10 END AS next_action
  FROM ap LEFT JOIN h ON h.cluster_id = ap.cluster_id LEFT JOIN co ON co.company_id = ap.application_id)"""
)

GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIM = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1})))"


def qualifiers(value: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({value}, {rx(v.QUALIFIERS)}))), ',')"


SNAP = (
    POSTINGS + """,
o AS (SELECT source_id, external_id, content_hash, last_seen, closed_at FROM p WHERE external_id % 5 <> 4),
n AS (SELECT source_id, external_id, CASE WHEN external_id % 6 = 0 THEN sha256(content_hash || '*') ELSE content_hash END AS content_hash FROM p WHERE external_id % 7 <> 0)"""
)
CHANGES = (
    SNAP + """,
c AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.external_id, n.external_id) AS external_id,
  CASE WHEN o.external_id IS NULL THEN 'new' WHEN n.external_id IS NULL THEN 'missing' WHEN o.closed_at IS NOT NULL THEN 'reopened'
       WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'unchanged' END AS change
  FROM o FULL JOIN n ON o.external_id = n.external_id AND o.source_id = n.source_id)"""
)


def domain(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


def emails(value: str) -> str:
    plain = sub(value, (r"(?i)\s*[\[({]\s*(?:at|arobase)\s*[\])}]\s*", "@"), (r"(?i)\s*[\[({]\s*(?:dot|point)\s*[\])}]\s*", "."))
    found = f"list_transform(regexp_extract_all(lower({plain}), {rx(v.EMAIL)}), lambda e: regexp_replace(e, '\\.$', ''))"
    return f"list_sort(list_distinct(list_filter({found}, lambda e: {has('e', v.ADDRESS)})))"


_PAGE_KEY = f"{domain('url')} || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_BASE = "string_split(string_split(url, '#')[1], '?')[1]"
_PARAMS = f"list_filter(string_split(regexp_extract(string_split(url, '#')[1], '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT {has('x', v.TRACKING)})"


def html_text(value: str) -> str:
    value = sub(
        value, (r"(?is)<script\b[^>]*>.*?</script>", ""), (r"(?is)<style\b[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr|section|article|blockquote)\s*>", _NL), (r"<[^>]*>", ""),
    )
    for name, char in v.ENTITIES:
        value = f"replace({value}, {q(name)}, {q(char)})"
    return white(value)


def paris(moment: str) -> str:
    """Local time, by the changes of summer time in the years of the data."""
    summer = [("2023-03-26", "2023-10-29"), ("2024-03-31", "2024-10-27"), ("2025-03-30", "2025-10-26")]
    inside = " OR ".join(f"({moment} >= TIMESTAMP '{a} 01:00:00' AND {moment} < TIMESTAMP '{b} 01:00:00')" for a, b in summer)
    return f"({moment} + CASE WHEN {inside} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END)"


def window_of(local: str) -> str:
    starts = ", ".join(f"date_trunc('day', {local}) {sign} INTERVAL {h} HOUR" for sign, h in (("-", 2), ("+", 7), ("+", 12), ("+", 17), ("+", 22)))
    return f"list_max(list_filter([{starts}], lambda t: t <= {local}))"


SQL: dict[str, str] = {
    "inbox_list": f"""WITH {INBOX} SELECT cluster_id, external_id, title, company_name, source_kind, remote_policy, contract_type, rule_score, CAST(score AS DOUBLE) AS score,
      {LEVEL} AS level, {joined("flags")} AS flags FROM inbox WHERE NOT {HIDDEN} ORDER BY {_INBOX_ORDER} LIMIT 300""",
    "inbox_count": f"WITH {INBOX} SELECT count(*) AS n FROM inbox WHERE NOT {HIDDEN}",
    "inbox_filtered_recent": f"WITH {INBOX} SELECT cluster_id, score, rule_score FROM inbox WHERE score >= 60 AND first_seen > {AS_OF} - INTERVAL 75 DAY",
    "inbox_by_source_kind": f"""WITH {INBOX}, k AS (SELECT cluster_id, list_sort(list(DISTINCT source_kind)) AS kinds FROM m GROUP BY cluster_id)
      SELECT cluster_id, {joined("kinds")} AS kinds FROM inbox JOIN k USING (cluster_id) WHERE list_contains(kinds, 'lever')""",
    "score_masked": f"""WITH {SCORED} SELECT cluster_id, score, {_REMOTE_FACT[0]} AS remote, {_REMOTE_FACT[1]} AS tone FROM hs
      WHERE score IS NOT NULL AND status = 'passed' AND triage = 'new' AND {HIDDEN}""",
    "rejected_recent": f"WITH {REJECTED} SELECT external_id, source_kind, rule_score, {joined('reasons')} AS reasons FROM rej ORDER BY rule_score DESC, external_id LIMIT 1000",
    "reject_reason_histogram": f"WITH {REJECTED}, e AS (SELECT split_part(unnest(reasons), ':', 1) AS reason FROM rej) SELECT reason, count(*) AS n FROM e GROUP BY reason",
    "reject_first_reason": f"WITH {REJECTED}, e AS (SELECT split_part(reasons[1], ':', 1) AS r FROM rej) SELECT {_LABELS.format('r')} AS reason, count(*) AS n FROM e GROUP BY 1",
    "near_misses": f"""WITH {REJECTED}, e AS (SELECT external_id, rule_score, reasons[1] AS r FROM rej WHERE len(reasons) = 1 AND NOT starts_with(reasons[1], 'role:'))
      SELECT external_id, {_LABELS.format("split_part(r, ':', 1)")} || ' (' || substr(r, length(split_part(r, ':', 1)) + 2) || ')' AS reason, rule_score FROM e""",
    "rule_results": f"WITH {JUDGED} SELECT external_id, status, rule_score, {joined('reasons')} AS reasons, {joined('flags')} AS flags, matched FROM j",
    "score_levels": f"WITH {SCORED} SELECT coalesce({LEVEL}, 'unscored') AS level, {_CONTRACT_FACT[0]} AS contract, {_CONTRACT_FACT[1]} AS tone, count(*) AS n FROM hs GROUP BY 1, 2, 3",
    "dry_run": f"""WITH {JUDGED}, b AS (SELECT source_id, external_id, row_number() OVER (PARTITION BY source_id ORDER BY rule_score DESC, external_id) AS k FROM j WHERE status = 'passed')
      SELECT source_id, count(*) AS fetched, count(*) FILTER (status = 'passed') AS passed,
        coalesce((SELECT string_agg(CAST(external_id AS VARCHAR), '|' ORDER BY k) FROM b WHERE b.source_id = j.source_id AND k <= 3), '') AS samples FROM j GROUP BY source_id""",
    "companies_overview": f"""WITH {COMPANIES} SELECT company_id, name, city, CASE outreach WHEN 'none' THEN 'to_contact' ELSE outreach END AS outreach,
      (SELECT count(*) FROM orders WHERE o_custkey = company_id AND o_orderstatus = 'O') AS open_jobs,
      (SELECT count(*) FROM orders WHERE o_custkey = company_id AND o_orderpriority = '1-URGENT') AS contacts,
      EXISTS (SELECT 1 FROM orders WHERE o_custkey = company_id AND o_orderstatus = 'P') AS has_draft,
      (SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) FROM orders WHERE o_custkey = company_id AND o_orderstatus = 'F') AS last_applied FROM co""",
    "sources_overview": f"""WITH {JUDGED}, {SOURCES}, {COMPANIES}, k AS (SELECT source_kind, count(*) AS passed FROM j WHERE status = 'passed' AND closed_at IS NULL GROUP BY 1)
      SELECT source_id, kind, label, co.name AS company, enabled, CAST(failures AS INTEGER) AS failures, coalesce(k.passed, 0) AS passed
      FROM so LEFT JOIN co USING (company_id) LEFT JOIN k ON k.source_kind = so.kind""",
    "source_runs_latest": f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM ru)
      SELECT source_id, run_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, status, n FROM r WHERE n <= 20""",
    "window_totals": f"""WITH {RUNS} SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, count(*) AS runs, count(*) FILTER (status = 'partial') AS partial,
      CAST(sum(created) AS BIGINT) AS created, CAST(sum(failed_items) AS BIGINT) AS failed_items FROM ru GROUP BY 1""",
    "usage": f"""WITH {POSTINGS} {CACHE} SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out,
      round(CAST(sum(input_tokens) + 5 * sum(output_tokens) AS DOUBLE) / 1000000.0::DOUBLE, 6) AS usd FROM cache""",
    "nav_counts": f"""WITH {HEADS}, {APPS}, {SOURCES} SELECT
      (SELECT count(*) FROM h WHERE triage = 'new' AND status = 'passed' AND closed_at IS NULL) AS inbox, (SELECT count(*) FROM h WHERE triage = 'interested') AS interesting,
      (SELECT count(*) FROM ap WHERE status NOT IN ('offer', 'rejected', 'withdrawn', 'ghosted')) AS pipeline, (SELECT count(*) FROM so WHERE failures > 0 AND enabled) AS failing,
      (SELECT count(*) FROM so WHERE source_id LIKE 'lever%' AND NOT enabled) AS disabled_lever""",
    "pipeline_by_status": f"""WITH {PIPELINE} SELECT status, count(*) AS n, CAST(min(next_action) AS VARCHAR) AS first_action,
      CAST(list_position({listed(v.STATUSES)}, status) AS BIGINT) AS place FROM pi GROUP BY status""",
    "due_followups": f"WITH {PIPELINE} SELECT application_id, status, title, company, CAST(next_action AS VARCHAR) AS next_action FROM pi WHERE next_action <= CAST({AS_OF} AS DATE) AND status NOT IN ('offer', 'rejected', 'withdrawn', 'ghosted')",
    "status_transitions": f"""WITH {APPS}, t AS (SELECT lag(to_status) OVER (PARTITION BY application_id ORDER BY occurred_at, event_id) AS from_status, to_status FROM ev)
      SELECT from_status, to_status, count(*) AS n FROM t GROUP BY 1, 2""",
    "triage_next": f"""WITH {INBOX}, l AS (SELECT * FROM inbox WHERE NOT {HIDDEN} ORDER BY {_INBOX_ORDER} LIMIT 300)
      SELECT cluster_id, coalesce(lead(cluster_id) OVER w, lag(cluster_id) OVER w) AS next_id FROM l WINDOW w AS (ORDER BY score DESC NULLS LAST, rule_score DESC, cluster_id)""",
    "dedupe_first_seen": "SELECT min(doc_id) AS doc_id, sha256(text) AS external_id FROM documents GROUP BY sha256(text)",
    "content_hash": f"WITH {POSTINGS} SELECT external_id, content_hash, {qualifiers('title_norm')} AS qualifiers FROM p",
    "hash_duplicates": f"WITH {POSTINGS} SELECT content_hash, count(*) AS n, min(external_id) AS first_id FROM p GROUP BY content_hash HAVING count(*) > 1",
    "exact_key_latest": f"""WITH {POSTINGS} SELECT a.external_id, b.external_id AS match_id FROM p a JOIN p b ON a.dedup_key = b.dedup_key AND a.external_id <> b.external_id
      WHERE b.closed_at IS NULL AND b.last_seen > {AS_OF} - INTERVAL 45 DAY
      QUALIFY row_number() OVER (PARTITION BY a.external_id ORDER BY b.last_seen DESC, b.external_id DESC) = 1""",
    "fuzzy_pairs": f"""WITH {POSTINGS}, t AS (SELECT DISTINCT company_norm, title_norm, {GRAMS.format("title_norm")} AS g FROM p WHERE coalesce(company_norm, '') <> '' AND closed_at IS NULL),
      s AS (SELECT x.company_norm, x.title_norm AS a, y.title_norm AS b, {SIM.format("x.g", "y.g")} AS sim FROM t x JOIN t y ON x.company_norm = y.company_norm AND x.title_norm < y.title_norm)
      SELECT company_norm, a, b, round(sim, 6) AS sim FROM s WHERE sim >= 0.75 AND {qualifiers("a")} = {qualifiers("b")}""",
    "part_pairs": f"""WITH t AS (SELECT DISTINCT p_name, {GRAMS.format("p_name")} AS g FROM part),
      s AS (SELECT x.p_name AS name, y.p_name AS other, {SIM.format("x.g", "y.g")} AS sim FROM t x JOIN t y ON x.p_name <> y.p_name)
      SELECT name, other, round(sim, 6) AS sim, row_number() OVER (PARTITION BY name ORDER BY sim DESC, other) AS n FROM s WHERE sim >= 0.4 QUALIFY n <= 5""",
    "canonical_pick": f"WITH {HEADS} SELECT cluster_id, external_id, source_kind, CAST(rank AS INTEGER) AS rank FROM h",
    "cluster_rollup": f"""WITH {SCORED}, g AS (SELECT cluster_id, count(*) AS members, CAST(CAST(min(first_seen) AS DATE) AS VARCHAR) AS first_seen, CAST(CAST(max(last_seen) AS DATE) AS VARCHAR) AS last_seen,
        bool_or(status = 'passed') AS any_passed, bool_and(closed_at IS NOT NULL) AS all_closed, bool_and(status = 'rejected') AS all_rejected,
        first(company_name ORDER BY rank, external_id) FILTER (company_name IS NOT NULL) AS any_company FROM m GROUP BY cluster_id),
      z AS (SELECT g.*, hs.external_id AS canonical_id, hs.company_name, hs.score,
        CASE WHEN NOT any_passed THEN 'not_needed' WHEN score_state = 'ok' THEN 'done' WHEN score_state = 'failed' AND attempts >= 2 THEN 'failed' ELSE 'pending' END AS score_status
        FROM g JOIN hs USING (cluster_id))
      SELECT cluster_id, canonical_id, members, first_seen, last_seen, all_closed, all_rejected, coalesce(company_name, any_company) AS company, score_status,
        CAST(CASE WHEN score_status = 'done' THEN score END AS DOUBLE) AS best_score FROM z""",
    "republished_lineage": f"""WITH {POSTINGS}, l AS (SELECT external_id, lag(external_id) OVER w AS previous_id, date_diff('day', CAST(lag(last_seen) OVER w AS DATE), CAST(first_seen AS DATE)) AS gap
        FROM p WINDOW w AS (PARTITION BY dedup_key ORDER BY first_seen, external_id))
      SELECT external_id, previous_id, CAST(gap AS INTEGER) AS gap_days, gap > 45 AS new_cluster FROM l WHERE previous_id IS NOT NULL""",
    "company_priority_lookup": f"""WITH {COMPANIES}, pr AS (
        SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey * 31 * 7919 % 1000000000 AS VARCHAR), 9, '0') END AS siren,
          CASE WHEN s_suppkey % 3 <= 1 THEN 'c' || s_suppkey * 17 || '.example.com' END AS domain, 'customer#' || lpad(CAST(s_suppkey * 3 % 997 AS VARCHAR), 9, '0') AS name_norm FROM supplier),
      nm AS (SELECT name_norm, min(company_id) AS id, arg_min(name, company_id) AS name FROM co GROUP BY name_norm)
      SELECT s_suppkey, CAST(coalesce(a.company_id, b.company_id, nm.id) AS DOUBLE) AS company_id, coalesce(a.name, b.name, nm.name) AS name,
        CASE WHEN a.company_id IS NOT NULL THEN 'siren' WHEN b.company_id IS NOT NULL THEN 'domain' WHEN nm.id IS NOT NULL THEN 'name' ELSE 'new' END AS way
      FROM pr LEFT JOIN co a ON a.siren = pr.siren LEFT JOIN co b ON b.domain = pr.domain LEFT JOIN nm ON nm.name_norm = pr.name_norm""",
    "triage_merge": f"""WITH {HEADS}, r AS (SELECT company_norm, cluster_id, list_position({listed(v.TRIAGE)}, triage) AS rank FROM m WHERE coalesce(company_norm, '') <> '')
      SELECT company_norm, min(cluster_id) AS target, count(DISTINCT cluster_id) AS merged, {listed(v.TRIAGE)}[max(rank)] AS triage, count(*) AS postings FROM r GROUP BY company_norm""",
    "cdc_classes": f"WITH {CHANGES} SELECT source_id, external_id, change FROM c",
    "run_counters": f"""WITH {CHANGES} SELECT source_id, count(*) FILTER (change <> 'missing') AS fetched, count(*) FILTER (change = 'new') AS created,
      count(*) FILTER (change IN ('changed', 'reopened')) AS updated, count(*) FILTER (change = 'missing') AS missing FROM c GROUP BY source_id""",
    "closures_full": f"WITH {SNAP} SELECT external_id, CAST(CAST({AS_OF} AS DATE) AS VARCHAR) AS closed_on FROM o ANTI JOIN n USING (source_id, external_id) WHERE closed_at IS NULL",
    "closures_deferred": f"""WITH {SNAP} SELECT external_id, CAST(CAST({AS_OF} AS DATE) AS VARCHAR) AS closed_on FROM o ANTI JOIN n USING (source_id, external_id)
      WHERE closed_at IS NULL AND last_seen < {AS_OF} - INTERVAL 30 DAY""",
    "upserted": f"""WITH {CHANGES} SELECT source_id, change = 'new' AS inserted, count(*) AS n FROM c GROUP BY 1, 2""",
    "cursor_overlap_union": f"WITH {APPS} SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, count(DISTINCT event_id) AS n FROM ev GROUP BY 1",
    "set_differences": f"""WITH {SNAP} SELECT 'kept' AS part, count(*) AS n FROM (SELECT external_id, content_hash FROM o INTERSECT SELECT external_id, content_hash FROM n)
      UNION ALL SELECT 'gone', count(*) FROM (SELECT external_id, content_hash FROM o EXCEPT ALL SELECT external_id, content_hash FROM n)
      UNION ALL SELECT 'fresh', count(*) FROM (SELECT external_id, content_hash FROM n EXCEPT ALL SELECT external_id, content_hash FROM o)""",
    "due_sources": f"""WITH {SOURCES}, d AS (SELECT *, last_run + to_minutes({DELAY}) AS next_run FROM so)
      SELECT source_id, next_run FROM d WHERE enabled AND kind <> 'capture' AND next_run < {AS_OF} + INTERVAL 10 MINUTE""",
    "backoff_next_run": f"WITH {SOURCES} SELECT source_id, {DELAY} AS delay_minutes, CAST(1000 * pow(4.0, failures) AS BIGINT) AS http_ms FROM so",
    "retention_split": f"WITH {RUNS} SELECT started_at < (SELECT max(started_at) FROM ru) - INTERVAL 60 DAY AS expired, count(*) AS n FROM ru GROUP BY 1",
    "check_violations": f"""WITH {POSTINGS}, {APPS}, {RUNS}
      SELECT 'application has a cluster or a title' AS rule, count(*) AS violations FROM ap WHERE cluster_id IS NULL AND external_title IS NULL
      UNION ALL SELECT 'application is known', count(*) FROM ap WHERE status NOT IN ('to_apply', 'applied', 'followed_up', 'interview', 'offer', 'withdrawn', 'ghosted')
      UNION ALL SELECT 'run id is unique', count(*) FROM (SELECT run_id FROM ru GROUP BY run_id HAVING count(*) > 1)
      UNION ALL SELECT 'run has a source', count(*) FROM ru WHERE source_id NOT IN (SELECT source_id FROM p)""",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "scheduled_windows": f"""WITH {APPS}, z AS (SELECT {paris("occurred_at")} AS here, {paris("occurred_at + INTERVAL 3 HOUR")} AS later FROM ev),
      x AS (SELECT here, later, {window_of("here")} AS a, {window_of("later")} AS b FROM z)
      SELECT a AS window_start, count(*) AS n, count(*) FILTER (later - b > INTERVAL 30 MINUTE AND here < b) AS stale FROM x GROUP BY a""",
    "classified": f"WITH {POSTINGS} SELECT external_id, contract_type, seniority, remote_policy, remote_scope, country_code FROM p",
    "contract_labels": f"""WITH {POSTINGS} SELECT contract_text, coalesce({first_of(fold("contract_text"), v.LABELS)}, 'unknown') AS label,
      count(*) AS n FROM p GROUP BY contract_text""",
    "salaries": f"""WITH {POSTINGS}, s AS (SELECT external_id, low, high FROM p)
      SELECT external_id, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CASE WHEN high IS NOT NULL THEN CAST(round(low / 1000.0::DOUBLE) AS INTEGER) || 'k–' || CAST(round(high / 1000.0::DOUBLE) AS INTEGER) || 'k €'
        WHEN low IS NOT NULL THEN CAST(round(low / 1000.0::DOUBLE) AS INTEGER) || 'k €' END AS shown FROM s""",
    "folded_documents": f"SELECT doc_id, sha256({fold('text')}) AS folded FROM documents",
    "normalized_titles": f"WITH {POSTINGS} SELECT external_id, title_norm, {title_norm(f'title || {q(" - CDI")}')} AS with_noise FROM p",
    "normalized_companies": f"SELECT c_custkey, {company_norm('c_name || chr(32) || ' + pick(derive.COMPANIES, 'c_custkey'))} AS name_norm FROM customer",
    "html_texts": f"SELECT page_id, {html_text('html')} AS text FROM pages",
    "page_links": """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"#]+)', 1)) AS href FROM pages)
      SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href
        ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/' || href END AS link FROM l""",
    "robots": f"""WITH p AS (SELECT page_id, '/' || {pick(("", "a", "a/b/", "p"), "page_id")} || regexp_extract(url, '([^/]*)$', 1) AS path, {pick(derive.ROBOTS, "page_id // 4")} AS rules FROM pages),
      l AS (SELECT rules, unnest(string_split(rules, chr(10))) AS line, generate_subscripts(string_split(rules, chr(10)), 1) AS n FROM (SELECT DISTINCT rules FROM p)),
      x AS (SELECT rules, n, lower(trim(regexp_extract(line, '^([^:#]*):', 1))) AS name, trim(regexp_extract(line, '^[^:#]*:([^#]*)', 1)) AS value FROM l),
      y AS (SELECT *, CASE WHEN name = 'user-agent' AND lag(name) OVER (PARTITION BY rules ORDER BY n) IS DISTINCT FROM 'user-agent' THEN 1 ELSE 0 END AS opens FROM x WHERE name IN ('user-agent', 'allow', 'disallow')),
      g AS (SELECT *, sum(opens) OVER (PARTITION BY rules ORDER BY n) AS grp FROM y),
      a AS (SELECT rules, grp, n, lower(value) AS agent FROM g WHERE name = 'user-agent'),
      m AS (SELECT rules, coalesce(arg_min(agent, n) FILTER (agent <> '*' AND contains('jobbot/1.0', agent)), '*') AS mine FROM a GROUP BY rules),
      h AS (SELECT a.rules, string_split(g.value, '*')[1] AS prefix, g.name = 'allow' AS allow FROM m JOIN a ON a.rules = m.rules AND a.agent = m.mine JOIN g ON g.rules = a.rules AND g.grp = a.grp AND g.name <> 'user-agent' AND g.value <> '')
      SELECT page_id, path, coalesce((SELECT arg_max(allow, [length(prefix), CAST(allow AS INTEGER)]) FROM h WHERE h.rules = p.rules AND starts_with(p.path, h.prefix)), true) AS allowed FROM p""",
    "page_domains": f"SELECT {domain('url')} AS domain, count(*) AS n FROM pages GROUP BY 1",
    "canonical_urls": f"SELECT page_id, CASE WHEN len({_PARAMS}) > 0 THEN {_BASE} || '?' || array_to_string({_PARAMS}, '&') ELSE {_BASE} END AS url FROM pages",
    "page_keys": f"""WITH k AS (SELECT {_PAGE_KEY} AS key, {domain("url")} AS host, min(page_id) AS page_id FROM pages GROUP BY 1, 2)
      SELECT page_id, key, host FROM k QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 6""",
    "document_emails": f"WITH e AS (SELECT doc_id, {joined(emails('text'))} AS emails FROM documents) SELECT * FROM e WHERE emails <> ''",
    "generic_contacts": f"""WITH {POSTINGS}, e AS (SELECT external_id, unnest({emails("description")}) AS e FROM p),
      g AS (SELECT external_id, e, split_part(e, '@', 1) AS local FROM e WHERE (split_part(e, '@', 2) = 'example.com' OR ends_with(split_part(e, '@', 2), '.example.com')))
      SELECT external_id, string_agg(e, '|' ORDER BY coalesce(nullif(list_position({listed(v.PREFERENCE)}, local), 0), 99), e) AS emails FROM g
      WHERE list_contains({listed(v.ACCEPTED)}, local) GROUP BY external_id""",
    "board_sources": f"""WITH u AS (SELECT page_id, page_id % 5 AS k, lower(replace({domain("url")}, '.', '-')) AS slug FROM pages)
      SELECT page_id, CASE k WHEN 0 THEN 'greenhouse:' || slug WHEN 1 THEN 'lever:' || slug WHEN 2 THEN 'ashby:' || slug WHEN 3 THEN 'smartrecruiters:' || slug END AS source_id FROM u""",
}
