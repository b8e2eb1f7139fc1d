"""DuckDB SQL for ingestion steps, actions and upkeep."""

from __future__ import annotations

from . import derive
from . import oracle_values as v
from .oracle import APPS as LOG
from .oracle import AS_OF, CACHE, COMPANIES, GRAMS, HEADS, JUDGED, POSTINGS, RUNS, SCORED, SIM, SOURCES, company_norm, first_pattern, hits, joined, listed, pick, q, qualifiers

LATER = "TIMESTAMP '2024-05-01'"
_TRIAGED = listed(v.TRIAGE)


def told(*values: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '-')" for x in values) + ")"


def facts(*parts: tuple[str, str, str, str]) -> str:
    """(what, table, key, value) of each part."""
    return " UNION ALL ".join(f"SELECT {q(what)} AS what, CAST({key} AS VARCHAR) AS key, CAST({value} AS VARCHAR) AS value FROM {source}" for what, source, key, value in parts)


def due(status: str, day: str) -> str:
    return f"(CAST({day} AS DATE) + CASE {status} WHEN 'applied' THEN 7 WHEN 'followed_up' THEN 10 END)"


CLUSTERS = HEADS + """,
cl AS (SELECT cluster_id, triage, CASE WHEN cluster_id % 4 <> 0 THEN cluster_id % 150 + 1 END AS company_id FROM h)"""
APPLICATIONS = f"""{COMPANIES},
a0 AS (
  SELECT 'cluster:' || cluster_id AS application_id, 'job' AS kind, cluster_id, company_id, NULL::BIGINT AS contact_id, {pick(("to_apply", "applied", "followed_up", "rejected"), "cluster_id")} AS status,
    CASE WHEN cluster_id % 2 = 0 THEN 'first' ELSE '' END AS notes FROM cl WHERE cluster_id % 3 = 0
  UNION ALL SELECT 'company:' || company_id, 'spontaneous', NULL, company_id, company_id, CASE WHEN company_id % 20 = 0 THEN 'to_apply' ELSE 'applied' END, '' FROM co WHERE company_id % 10 = 0),
ap AS (SELECT *, CASE WHEN kind = 'job' AND status <> 'to_apply' THEN DATE '2024-02-01' END AS applied, NULL::DATE AS next_action FROM a0)"""
STATE = f"{CLUSTERS}, {APPLICATIONS}"
APP = told("status", "cluster_id", "applied", "next_action", "notes")
EVENT = told("type", "from_status", "to_status", "note")
CONTACTS = f"""{COMPANIES},
ct AS (SELECT company_id AS contact_id, company_id, CASE WHEN company_id % 15 = 0 THEN 'ann' ELSE 'jobs' END || '@' || domain AS email, CASE WHEN company_id % 15 = 0 THEN 'personal' ELSE 'generic' END AS kind,
  'a label' AS label, 'manual:card ' || company_id AS source, CASE WHEN company_id % 25 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(company_id % 120 AS INTEGER)) END AS deleted_at FROM co WHERE company_id % 5 = 0)"""


def opened(requests: str) -> str:
    """Applications that requests (cluster_id, status) open, as ``nw``."""
    return f"""nw AS (SELECT 'cluster:' || r.cluster_id AS application_id, 'job' AS kind, r.cluster_id, cl.company_id, NULL::BIGINT AS contact_id, r.status, '' AS notes,
        CASE WHEN r.status <> 'to_apply' THEN DATE '2024-05-01' END AS applied, {due("r.status", LATER)} AS next_action
      FROM ({requests}) r JOIN cl USING (cluster_id) WHERE r.cluster_id NOT IN (SELECT cluster_id FROM ap WHERE cluster_id IS NOT NULL))"""


_OPEN_EVENTS = "SELECT application_id, 'status_change' AS type, NULL AS from_status, status AS to_status, NULL AS note FROM nw"

PLACED = POSTINGS + f""",
e0 AS (SELECT * FROM p WHERE external_id % 3 <> 0), e AS (SELECT *, min(external_id) OVER (PARTITION BY dedup_key) AS cluster_id FROM e0)"""


def clustered(rows: str) -> str:
    return f"""SELECT cluster_id, min(dedup_key) AS dedup_key, min(company_norm) AS company_norm, min(title_norm) AS title_norm, max(last_seen) AS last_seen, bool_or(closed_at IS NULL) AS open,
        list(DISTINCT source_id) AS sources FROM {rows} GROUP BY cluster_id"""


FETCH = PLACED + f""",
f AS (SELECT source_id, external_id, company_norm, CASE WHEN external_id % 12 = 0 THEN title_norm || ' two' ELSE title_norm END AS title_norm,
  CASE WHEN external_id % 6 = 0 THEN sha256(content_hash || '*') ELSE content_hash END AS content_hash FROM p WHERE external_id % 7 <> 0),
st AS (SELECT coalesce(e.source_id, f.source_id) AS source_id, coalesce(e.external_id, f.external_id) AS external_id, e.cluster_id, e.closed_at AS was_closed, e.last_seen, f.external_id IS NOT NULL AS here,
  CASE WHEN e.external_id IS NULL THEN 'new' WHEN f.external_id IS NULL THEN 'missing' WHEN e.closed_at IS NOT NULL THEN 'reopened' WHEN e.content_hash <> f.content_hash THEN 'changed' ELSE 'unchanged' END AS change
  FROM e FULL JOIN f ON e.external_id = f.external_id AND e.source_id = f.source_id)"""

_DELAY = "CAST(least(interval_minutes * pow(2.0, fails), 1440) AS INTEGER)"
_FLOOR = "CASE kind WHEN 'france_travail' THEN 120 WHEN 'jobicy' THEN 360 WHEN 'capture' THEN 60 ELSE 180 END"
_STACK = [r"\bpython\b", r"\bspark\b"]
_TITLES = [r"\bphp\b", r"\bwordpress\b", r"\bsales\b"]

def in_order(new: str) -> str:
    """CTEs that place the rows of ``new`` in clusters c one after the other: each row of r is one, and sees the clusters of those before."""
    return f"""fr AS MATERIALIZED (SELECT * FROM c WHERE open AND last_seen > {AS_OF} - INTERVAL 45 DAY),
      n AS MATERIALIZED (SELECT external_id, source_id, dedup_key, coalesce(company_norm, '') AS company_norm, title_norm, row_number() OVER (ORDER BY external_id, source_id) AS i FROM ({new})),
      t AS MATERIALIZED (SELECT *, {GRAMS.format("title_norm")} AS g, {qualifiers("title_norm")} AS q FROM (SELECT company_norm, title_norm FROM n UNION SELECT company_norm, title_norm FROM fr) WHERE company_norm <> ''),
      sm AS MATERIALIZED (SELECT x.company_norm, x.title_norm AS a, y.title_norm AS b, {SIM.format("x.g", "y.g")} AS sim, x.q = y.q AS same FROM t x JOIN t y ON x.company_norm = y.company_norm WHERE {SIM.format("x.g", "y.g")} >= 0.75),
      r(i, external_id, source_id, dedup_key, company_norm, title_norm, cluster_id, way) USING KEY (i) AS (
        SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR
        UNION (WITH cur AS (SELECT * FROM n WHERE i = (SELECT max(i) + 1 FROM recurring.r)),
          al AS (SELECT cluster_id, dedup_key, company_norm, title_norm, sources FROM fr UNION ALL SELECT cluster_id, dedup_key, company_norm, title_norm, NULL FROM recurring.r WHERE way = 'new'),
          ex AS (SELECT min(al.cluster_id) AS c FROM al JOIN cur ON al.dedup_key = cur.dedup_key AND cur.company_norm <> ''),
          nr AS (SELECT al.cluster_id, sm.same, row_number() OVER (ORDER BY sm.sim DESC, al.cluster_id) AS pos FROM cur JOIN sm ON sm.company_norm = cur.company_norm AND sm.a = cur.title_norm
            JOIN al ON al.company_norm = cur.company_norm AND al.title_norm = sm.b WHERE NOT coalesce(list_contains(al.sources, cur.source_id), false)
            AND NOT EXISTS (SELECT 1 FROM recurring.r z WHERE z.cluster_id = al.cluster_id AND z.source_id = cur.source_id)),
          si AS (SELECT arg_min(cluster_id, pos) AS c FROM nr WHERE pos <= 5 AND same)
          SELECT cur.i, cur.external_id, cur.source_id, cur.dedup_key, cur.company_norm, cur.title_norm, coalesce(ex.c, si.c, cur.external_id),
            CASE WHEN ex.c IS NOT NULL THEN 'exact' WHEN si.c IS NOT NULL THEN 'similar' ELSE 'new' END FROM cur, ex, si))"""


ASSIGNED = f"""WITH RECURSIVE {PLACED}, c AS ({clustered("e")}), {in_order("SELECT * FROM p WHERE external_id % 3 = 0")},
      pv AS (SELECT dedup_key, cluster_id FROM c WHERE company_norm <> '' QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY last_seen DESC, cluster_id DESC) = 1)
      SELECT r.external_id, r.cluster_id, r.way, CASE WHEN r.way = 'new' THEN CAST(pv.cluster_id AS DOUBLE) END AS previous_id FROM r LEFT JOIN pv USING (dedup_key) WHERE r.i > 0"""
REFRESHED = f"""WITH RECURSIVE {FETCH}, c AS ({clustered("e")}),
      g AS (SELECT st.*, f.title_norm, f.company_norm, CASE WHEN coalesce(f.company_norm, '') <> '' THEN f.company_norm || '|' || f.title_norm END AS dedup_key,
        change = 'new' OR change IN ('changed', 'reopened') AND f.title_norm <> e.title_norm AS moved, change = 'missing' AND was_closed IS NULL AS closing
        FROM st LEFT JOIN f USING (external_id, source_id) LEFT JOIN e USING (external_id, source_id)),
      {in_order("SELECT * FROM g WHERE moved")},
      z AS (SELECT g.cluster_id AS before, CASE WHEN g.moved THEN r.cluster_id ELSE g.cluster_id END AS now_in, moved OR closing OR change IN ('changed', 'reopened') AS touched, here OR NOT closing AND was_closed IS NULL AS open
        FROM g LEFT JOIN r USING (external_id, source_id)),
      rf AS (SELECT now_in AS cluster_id FROM z WHERE touched AND now_in IS NOT NULL UNION SELECT before FROM z WHERE touched AND before IS NOT NULL)
      SELECT rf.cluster_id, count(z.now_in) AS members, count(z.now_in) FILTER (z.open) AS open FROM rf LEFT JOIN z ON z.now_in = rf.cluster_id GROUP BY rf.cluster_id"""


SQL: dict[str, str] = {
    "act_triage": f"""WITH {STATE}, rq AS (SELECT cluster_id, {pick(("applied", "dismissed", "interested"), "cluster_id // 5")} AS triage FROM cl WHERE cluster_id % 5 = 0),
      {opened("SELECT cluster_id, 'applied' AS status FROM rq WHERE triage = 'applied'")},
      c2 AS (SELECT cl.cluster_id, coalesce(rq.triage, cl.triage) AS triage FROM cl LEFT JOIN rq USING (cluster_id)), al AS (SELECT * FROM ap UNION ALL BY NAME SELECT * FROM nw), ev2 AS ({_OPEN_EVENTS})
      {facts(("cluster", "c2", "cluster_id", "triage"), ("application", "al", "application_id", APP), ("event", "ev2", "application_id", EVENT))}""",
    "act_merge": f"""WITH RECURSIVE {STATE},
      pr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq, source, target) AS i FROM (
        SELECT cluster_id * 37 % 1009 AS seq, cluster_id AS source, CASE WHEN cluster_id % 21 = 0 THEN cluster_id ELSE cluster_id + 1 END AS target FROM cl WHERE cluster_id % 7 < 2
        UNION ALL SELECT 1009 + cluster_id * 41 % 997, cluster_id, cluster_id - cluster_id % 60 + 1 FROM cl WHERE cluster_id % 5 = 0)),
      -- a row per cluster (k >= 0), one for each refused request (k < -1), and the number of requests seen (k = -1)
      w(k, i, apps, rank, dest, source, target, reason) USING KEY (k) AS (
        SELECT CAST(cl.cluster_id AS BIGINT), 0::BIGINT, (SELECT count(*) FROM ap WHERE ap.cluster_id = cl.cluster_id), CAST(list_position({_TRIAGED}, cl.triage) AS BIGINT), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM cl
        UNION ALL SELECT -1, 0, 0, 0, NULL, NULL, NULL, NULL
        UNION (WITH cur AS (SELECT pr.* FROM pr JOIN recurring.w z ON z.k = -1 AND pr.i = z.i + 1),
          jd AS (SELECT cur.*, s.apps AS sa, t.apps AS ta, s.rank AS sr, t.rank AS tr, CASE WHEN cur.source = cur.target THEN 'VALIDATION' WHEN s.k IS NULL OR t.k IS NULL THEN 'NOT_FOUND' WHEN s.apps + t.apps > 1 THEN 'CONFLICT' END AS reason
            FROM cur LEFT JOIN recurring.w s ON s.k = cur.source AND s.dest IS NULL LEFT JOIN recurring.w t ON t.k = cur.target AND t.dest IS NULL)
          SELECT -1, i, 0, 0, NULL, NULL, NULL, NULL FROM jd UNION ALL SELECT -1 - i, 0, 0, 0, NULL, source, target, reason FROM jd WHERE reason IS NOT NULL
          UNION ALL SELECT source, 0, 0, sr, target, NULL, NULL, NULL FROM jd WHERE reason IS NULL UNION ALL SELECT target, 0, sa + ta, greatest(sr, tr), NULL, NULL, NULL, NULL FROM jd WHERE reason IS NULL)),
      tr(cluster_id, root) AS (SELECT k, k FROM w WHERE k >= 0 AND dest IS NULL UNION ALL SELECT w.k, tr.root FROM tr JOIN w ON w.dest = tr.cluster_id AND w.k >= 0),
      c2 AS (SELECT k AS cluster_id, {_TRIAGED}[rank] AS triage FROM w WHERE k >= 0 AND dest IS NULL),
      jx AS (SELECT external_id, tr.root AS cluster_id FROM m LEFT JOIN tr USING (cluster_id)),
      al AS (SELECT application_id, tr.root AS cluster_id FROM ap LEFT JOIN tr USING (cluster_id)), rf AS (SELECT * FROM w WHERE k < -1)
      {facts(("cluster", "c2", "cluster_id", "triage"), ("posting", "jx", "external_id", "cluster_id"), ("application", "al", "application_id", "cluster_id"), ("refused", "rf", "source", told("target", "reason")))}""",
    "act_rescue": f"""WITH {CLUSTERS}, c2 AS (SELECT cluster_id, CASE WHEN cluster_id % 6 = 0 THEN 'new' ELSE triage END AS triage FROM cl),
      jx AS (SELECT external_id, CASE WHEN cluster_id % 6 = 0 THEN 'passed' ELSE status END AS status, cluster_id % 6 = 0 AS forced FROM m)
      {facts(("cluster", "c2", "cluster_id", "triage"), ("posting", "jx", "external_id", told("status", "forced")))}""",
    "act_apply": f"""WITH {STATE}, {opened("SELECT cluster_id, CASE WHEN cluster_id % 8 = 0 THEN 'applied' ELSE 'to_apply' END AS status FROM cl WHERE cluster_id % 4 = 0")},
      xt AS (SELECT 'external:' || sha256('https://x.example/' || s_suppkey) AS application_id, NULL::BIGINT AS cluster_id, CASE WHEN s_suppkey % 2 = 0 THEN 'to_apply' ELSE 'applied' END AS status, '' AS notes,
        CASE WHEN s_suppkey % 2 = 1 THEN DATE '2024-05-01' END AS applied, {due("CASE WHEN s_suppkey % 2 = 1 THEN 'applied' END", LATER)} AS next_action FROM supplier),
      c2 AS (SELECT cl.cluster_id, CASE nw.status WHEN 'applied' THEN 'applied' WHEN 'to_apply' THEN 'interested' ELSE cl.triage END AS triage FROM cl LEFT JOIN nw USING (cluster_id)),
      al AS (SELECT application_id, status, cluster_id, applied, next_action, notes FROM ap UNION ALL BY NAME SELECT application_id, status, cluster_id, applied, next_action, notes FROM nw UNION ALL BY NAME SELECT * FROM xt),
      ev2 AS ({_OPEN_EVENTS} UNION ALL SELECT application_id, 'status_change', NULL, status, NULL FROM xt)
      {facts(("cluster", "c2", "cluster_id", "triage"), ("application", "al", "application_id", APP), ("event", "ev2", "application_id", EVENT))}""",
    "act_status": f"""WITH {STATE}, rq AS (SELECT application_id, {pick(("followed_up", "interview", "to_apply"), "cluster_id")} AS to_status, CASE WHEN cluster_id % 12 = 0 THEN 'call' END AS note FROM ap WHERE cluster_id % 6 = 0),
      nx AS (SELECT ap.*, to_status, note FROM ap JOIN rq USING (application_id) WHERE status <> to_status OR note IS NOT NULL),
      al AS (SELECT ap.application_id, coalesce(nx.to_status, ap.status) AS status, ap.cluster_id, coalesce(ap.applied, CASE WHEN nx.to_status <> 'to_apply' THEN DATE '2024-05-01' END) AS applied,
        CASE WHEN nx.to_status IS NOT NULL THEN {due("nx.to_status", LATER)} END AS next_action, ap.notes FROM ap LEFT JOIN nx USING (application_id)),
      c2 AS (SELECT cluster_id, CASE WHEN cluster_id IN (SELECT cluster_id FROM nx WHERE to_status <> 'to_apply') THEN 'applied' ELSE triage END AS triage FROM cl),
      ev2 AS (SELECT application_id, CASE to_status WHEN 'followed_up' THEN 'follow_up' WHEN 'interview' THEN 'interview_scheduled' ELSE 'status_change' END AS type, status AS from_status, to_status, note FROM nx)
      {facts(("cluster", "c2", "cluster_id", "triage"), ("application", "al", "application_id", APP), ("event", "ev2", "application_id", EVENT))}""",
    "act_notes": f"""WITH {STATE}, al AS (SELECT application_id, status, cluster_id, applied,
          CASE WHEN cluster_id % 15 = 0 THEN CASE WHEN cluster_id % 2 = 0 THEN DATE '2024-05-01' END ELSE next_action END AS next_action,
          CASE WHEN cluster_id % 9 = 0 THEN CASE WHEN notes = '' THEN '' ELSE notes || chr(10) END || '[01/05/2024] called' ELSE notes END AS notes FROM ap WHERE coalesce(cluster_id % 18 <> 0, true)),
      c2 AS (SELECT cluster_id, CASE WHEN cluster_id % 18 = 0 THEN 'interested' ELSE triage END AS triage FROM cl),
      ev2 AS (SELECT application_id, 'note' AS type, NULL AS from_status, NULL AS to_status, 'called' AS note FROM ap WHERE cluster_id % 9 = 0)
      {facts(("cluster", "c2", "cluster_id", "triage"), ("application", "al", "application_id", APP), ("event", "ev2", "application_id", EVENT))}""",
    "act_find_or_create": f"""WITH RECURSIVE {COMPANIES},
      pr AS MATERIALIZED (SELECT CAST(s_suppkey AS BIGINT) AS request, CASE WHEN s_suppkey % 2 = 0 THEN 'c' || s_suppkey % 90 * 17 || '.example.com' END AS domain,
        'customer#' || lpad(CAST(s_suppkey % 70 * 30 % 1997 AS VARCHAR), 9, '0') AS name_norm, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
      -- a row per company (k >= 0), one for each answer (k < -1), and the number of requests seen (k = -1)
      w(k, i, name_norm, domain, request, way, company_id) USING KEY (k) AS (
        SELECT CAST(company_id AS BIGINT), 0::BIGINT, name_norm, CASE WHEN company_id % 3 = 0 THEN domain END, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM co UNION ALL SELECT -1, 0, NULL, NULL, NULL, NULL, NULL
        UNION (WITH cur AS (SELECT pr.* FROM pr JOIN recurring.w z ON z.k = -1 AND pr.i = z.i + 1),
          fd AS (SELECT cur.*, (SELECT min(k) FROM recurring.w z, cur c WHERE z.k >= 0 AND z.domain = c.domain) AS by_domain, (SELECT min(k) FROM recurring.w z, cur c WHERE z.k >= 0 AND z.name_norm = c.name_norm) AS by_name FROM cur),
          an AS (SELECT fd.*, coalesce(by_domain, by_name, (SELECT max(company_id) + 1 FROM co) + request) AS cid, CASE WHEN by_domain IS NOT NULL THEN 'domain' WHEN by_name IS NOT NULL THEN 'name' ELSE 'new' END AS way FROM fd),
          fi AS (SELECT an.*, coalesce(z.domain, an.domain) AS dom, coalesce(z.name_norm, an.name_norm) AS nam FROM an LEFT JOIN recurring.w z ON z.k = an.cid)
          SELECT -1, i, NULL, NULL, NULL, NULL, NULL FROM fi UNION ALL SELECT -1 - i, 0, NULL, dom, request, way, cid FROM fi UNION ALL SELECT cid, 0, nam, dom, NULL, NULL, NULL FROM fi)),
      an2 AS (SELECT * FROM w WHERE k < -1), fr2 AS (SELECT * FROM w WHERE k >= 0)
      {facts(("answer", "an2", "request", told("way", "company_id", "domain")), ("company", "fr2", "k", told("name_norm", "domain")))}""",
    "act_companies": f"""WITH {CLUSTERS}, {COMPANIES}, rq AS (SELECT company_id, CASE WHEN company_id % 16 = 0 THEN 'New SARL ' || name ELSE name END AS name, company_id % 24 = 0 AS cleared, company_id % 24 <> 0 AND company_id % 3 = 1 AS moved,
          CASE WHEN company_id % 32 = 0 THEN 'closed' ELSE outreach END AS outreach FROM co WHERE company_id % 8 = 0),
      u AS (SELECT co.company_id, coalesce(rq.name, co.name) AS name, CASE WHEN cleared THEN NULL WHEN moved THEN 'new.example' ELSE co.domain END AS domain, coalesce(rq.outreach, co.outreach) AS outreach FROM co LEFT JOIN rq USING (company_id))
      SELECT company_id, name, {company_norm("name")} AS name_norm, domain, 'https://' || domain AS website,
        CASE WHEN outreach = 'none' AND company_id IN (SELECT company_id FROM cl WHERE cluster_id % 2 = 0 AND company_id IS NOT NULL) THEN 'to_contact' ELSE outreach END AS outreach FROM u""",
    "act_contacts": f"""WITH {CONTACTS}, rq AS (SELECT company_id + 100000 AS contact_id, company_id, 'jobs@c' || (company_id - company_id % 4) || '.example.com' AS email, company_id % 3 = 0 AS personal FROM co WHERE company_id % 2 = 0),
      ad AS (SELECT * FROM rq WHERE email NOT IN (SELECT email FROM ct WHERE deleted_at IS NULL) QUALIFY row_number() OVER (PARTITION BY email ORDER BY contact_id) = 1),
      al AS (SELECT contact_id, company_id, email, label, source, 'b2b_legitimate_interest' AS consent_basis, deleted_at FROM ct
        UNION ALL SELECT contact_id, company_id, email, NULL, 'manual:fair', CASE WHEN personal THEN 'legitimate_interest_candidate' ELSE 'b2b_legitimate_interest' END, NULL FROM ad),
      mk AS (SELECT * REPLACE (CASE WHEN contact_id % 35 = 0 THEN {LATER} ELSE deleted_at END AS deleted_at), contact_id % 7 = 1 AS opted_out FROM al),
      pu AS (SELECT *, coalesce(deleted_at < {LATER} - INTERVAL 30 DAY, false) AS old FROM mk)
      SELECT contact_id, company_id, CASE WHEN NOT old THEN email END AS email, CASE WHEN NOT old THEN label END AS label, source, consent_basis, CAST(CAST(deleted_at AS DATE) AS VARCHAR) AS deleted, opted_out, deleted_at IS NULL AS active FROM pu""",
    "act_sources": f"""WITH {SOURCES}, u AS (SELECT *, CASE WHEN company_id % 3 = 0 THEN company_id % 2 = 0 ELSE enabled END AS e2, company_id % 3 = 0 AND company_id % 2 = 0 AS started FROM so WHERE company_id % 11 <> 0)
      SELECT source_id, e2 AS enabled, CAST(CASE WHEN started THEN 0 ELSE failures END AS INTEGER) AS failures, CASE WHEN started THEN {LATER} ELSE last_run END AS next_run,
        CAST(CASE WHEN company_id % 4 = 0 THEN greatest({_FLOOR}, company_id * 7 % 400) ELSE interval_minutes END AS INTEGER) AS interval_minutes FROM u""",
    "act_drafts": f"""WITH {STATE}, {CONTACTS[CONTACTS.index("ct AS"):]}, rq AS (SELECT company_id, contact_id, kind, 'To ' || company_id AS subject,
          CASE WHEN kind = 'personal' THEN 'Hello.' || chr(10) || chr(10) || 'From card ' || contact_id || '.' ELSE 'Hello.' END AS body FROM ct WHERE company_id % 30 <> 0),
      sp AS (SELECT application_id, company_id, contact_id, status FROM ap WHERE kind = 'spontaneous'), pe AS (SELECT company_id FROM sp WHERE status = 'to_apply'),
      al AS (SELECT sp.company_id, sp.status, CASE WHEN sp.status = 'to_apply' THEN rq.subject END AS subject, CASE WHEN sp.status = 'to_apply' THEN rq.body END AS body, false AS fresh FROM sp LEFT JOIN rq USING (company_id)
        UNION ALL SELECT company_id, 'to_apply', subject, body, true FROM rq WHERE company_id NOT IN (SELECT company_id FROM pe)),
      se AS (SELECT *, subject IS NOT NULL AND company_id % 4 = 0 AS sent FROM al),
      out AS (SELECT company_id, CASE WHEN sent THEN 'applied' ELSE status END AS status, subject, body, CASE WHEN sent THEN DATE '2024-05-08' END AS next_action, fresh, sent FROM se),
      fi AS (SELECT company_id, CASE WHEN company_id IN (SELECT company_id FROM out WHERE sent) THEN 'contacted' WHEN outreach = 'none' AND company_id IN (SELECT company_id FROM out WHERE fresh) THEN 'to_contact' ELSE outreach END AS outreach FROM co),
      pp AS (SELECT contact_id, kind = 'personal' AND company_id IN (SELECT company_id FROM out WHERE sent) AS noticed FROM ct),
      ev2 AS (SELECT 'company:' || company_id AS application_id, 'status_change' AS type, 'to_apply' AS to_status, 'Brouillon généré' AS note FROM out WHERE fresh
        UNION ALL SELECT 'company:' || company_id, 'sent', 'applied', NULL FROM out WHERE sent)
      {facts(("application", "out", "company_id", told("status", "subject", "body", "next_action")), ("company", "fi", "company_id", "outreach"), ("contact", "pp", "contact_id", "noticed"), ("event", "ev2", "application_id", told("type", "to_status", "note")))}""",
    "act_letters": f"""WITH {STATE}, {opened("SELECT cluster_id, 'to_apply' AS status FROM cl WHERE cluster_id % 10 = 0")},
      al AS (SELECT application_id, cluster_id, status FROM ap WHERE kind = 'job' UNION ALL SELECT application_id, cluster_id, status FROM nw),
      le AS (SELECT application_id, status, CASE WHEN cluster_id % 10 = 0 THEN 'Cluster ' || cluster_id END AS subject, CASE WHEN cluster_id % 10 = 0 THEN 'Dear all' END AS body FROM al),
      c2 AS (SELECT cl.cluster_id, CASE WHEN nw.cluster_id IS NOT NULL THEN 'interested' ELSE cl.triage END AS triage FROM cl LEFT JOIN nw USING (cluster_id)),
      ev2 AS ({_OPEN_EVENTS} UNION ALL SELECT application_id, 'note', NULL, NULL, 'Lettre de motivation générée' FROM al WHERE cluster_id % 10 = 0)
      {facts(("cluster", "c2", "cluster_id", "triage"), ("letter", "le", "application_id", told("status", "subject", "body")), ("event", "ev2", "application_id", EVENT))}""",
    "assigned": ASSIGNED,
    "merge_candidates": f"""WITH {PLACED}, c AS ({clustered("e")}), g AS MATERIALIZED (SELECT cluster_id, coalesce(company_norm, '') AS company, {GRAMS.format("coalesce(title_norm, '')")} AS g, open FROM c),
      s AS (SELECT x.cluster_id, y.cluster_id AS other_id, x.company, coalesce({SIM.format("x.g", "y.g")}, 0) AS sim FROM g x JOIN g y ON x.cluster_id <> y.cluster_id AND y.open AND (x.company = '' OR x.company = y.company))
      SELECT cluster_id, other_id, round(CASE WHEN isnan(sim) THEN 0 ELSE sim END, 6) AS sim, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, other_id) AS n FROM s WHERE company <> '' OR sim > 0.4 QUALIFY n <= 20""",
    "ingest_step": f"""WITH {FETCH}, z AS (SELECT *, change = 'missing' AND was_closed IS NULL AND last_seen < {AS_OF} - INTERVAL 30 DAY AS closing FROM st)
      SELECT source_id, change, closing, CASE WHEN here THEN true WHEN closing THEN false ELSE was_closed IS NULL END AS open, count(*) AS n FROM z GROUP BY ALL""",
    "refresh_set": REFRESHED,
    "ingest_twice": "SELECT 0::BIGINT AS differing",
    "run_outcomes": f"""WITH {SOURCES}, u AS (SELECT *, company_id % 3 AS k, CASE WHEN company_id % 3 = 0 THEN 0 ELSE failures END + CASE WHEN company_id % 3 = 1 AND company_id % 9 <> 1 THEN 1 ELSE 0 END AS fails FROM so)
      SELECT source_id, enabled AND NOT (k = 1 AND company_id % 2 = 0 AND list_contains({listed(v.BOARD_KINDS)}, kind)) AS enabled, CAST(fails AS INTEGER) AS failures,
        CASE k WHEN 0 THEN {AS_OF} + to_minutes(CAST(greatest({_FLOOR}, interval_minutes) AS INTEGER)) WHEN 1 THEN {AS_OF} + to_minutes({_DELAY}) ELSE last_run END AS next_run,
        CASE WHEN k = 0 THEN CASE WHEN company_id % 2 > 0 THEN 'partial' ELSE 'ok' END END AS last_status, CASE WHEN k = 1 THEN 500::DOUBLE END AS error_length FROM u""",
    "cursors": f"""WITH u AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2024-04-01' + to_hours(CAST(s_suppkey % 48 AS INTEGER)) END AS last FROM supplier),
      w AS (SELECT *, coalesce(last - INTERVAL 1 DAY, {AS_OF} - INTERVAL 14 DAY) AS since FROM u)
      SELECT 'ft:' || i AS source_id, since, CASE WHEN i % 3 <> 0 THEN {AS_OF} ELSE coalesce(last, since) END AS last_creation FROM w""",
    "refiltered": f"""WITH {JUDGED}, again AS (SELECT *, closed_at IS NULL AND description <> '' AS redo, list_filter([
        CASE WHEN contract_type IN ('internship', 'apprenticeship', 'freelance', 'cdd') THEN 'contract:' || contract_type END, CASE WHEN away AND NOT local THEN 'remote:' || remote_policy END,
        CASE WHEN remote_scope = 'other' THEN 'geo:other' END, CASE WHEN NOT {hits("ft", v.ROLE)} > 0 THEN 'role:not_dev' END, {first_pattern("ft", _TITLES, "stack_exclusion:")},
        CASE WHEN {hits("fa", _STACK)} = 0 THEN 'stack_required:none' END, {first_pattern("ft", v.NOT_LEVEL, "seniority:")},
        CASE WHEN company_norm = 'gamma consulting' THEN 'company_exclusion:Gamma Consulting' END], lambda x: x IS NOT NULL) AS r2 FROM j)
      SELECT external_id, CASE WHEN NOT redo THEN status WHEN len(r2) > 0 AND source_kind <> 'capture' AND external_id % 20 <> 0 THEN 'rejected' ELSE 'passed' END AS status,
        {joined("CASE WHEN redo THEN r2 ELSE reasons END")} AS reasons, redo AS refreshed FROM again""",
    "scores_accumulated": f"""WITH {POSTINGS} {CACHE} SELECT content_hash, CASE WHEN substr(content_hash, 1, 1) < '5' THEN score + 1 ELSE score END AS score,
      CAST(input_tokens + CASE WHEN substr(content_hash, 1, 1) < '5' THEN input_tokens + 7 ELSE 0 END AS BIGINT) AS input_tokens FROM cache""",
    "contacts_added": f"WITH {CONTACTS} SELECT company_id, 'old' AS origin FROM ct UNION ALL SELECT company_id, 'new' FROM co WHERE company_id % 3 = 0 AND company_id % 5 <> 0",
    "touched": f"""WITH {POSTINGS} SELECT external_id, CAST(CAST(CASE WHEN external_id % 4 = 0 THEN {AS_OF} ELSE last_seen END AS DATE) AS VARCHAR) AS last_seen, external_id % 4 = 0 OR closed_at IS NULL AS open FROM p""",
    "sources_deleted": f"""WITH {POSTINGS}, {RUNS}, g AS (SELECT DISTINCT source_id FROM p WHERE source_id LIKE '%1')
      SELECT 'postings' AS what, count(*) AS n FROM p WHERE source_id NOT IN (SELECT * FROM g) UNION ALL SELECT 'runs', count(*) FROM ru WHERE source_id NOT IN (SELECT * FROM g)
      UNION ALL SELECT 'loose applications', count(*) FROM p WHERE external_id % 3 = 0 AND source_id IN (SELECT * FROM g)""",
    "contacts_erased": f"WITH {CONTACTS}, u AS (SELECT *, coalesce(deleted_at < {AS_OF} - INTERVAL 30 DAY, false) AS old FROM ct) SELECT contact_id, CASE WHEN NOT old THEN email END AS email, CASE WHEN NOT old THEN label END AS label FROM u",
    "heartbeat": "SELECT 1 AS id, max(ts) AS last_tick, (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_error FROM events",
    "backups_kept": f"""WITH {RUNS}, f AS (SELECT DISTINCT source_id, 'dump-' || CAST(CAST(started_at AS DATE) AS VARCHAR) || '.sql' AS file FROM ru)
      SELECT source_id, file FROM f QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY file DESC) <= 8""",
    "write_batches": """WITH u AS (SELECT source AS source_id, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS batch FROM documents)
      SELECT source_id, batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM u GROUP BY 1, 2""",
    "companies_filled": f"""WITH {COMPANIES} SELECT company_id, CASE WHEN company_id % 2 = 0 THEN city WHEN company_id % 5 <> 0 THEN 'Elsewhere' END AS city,
      CASE WHEN company_id % 3 = 0 THEN domain WHEN company_id % 5 <> 0 THEN 'new.' || domain END AS domain FROM co""",
    "orphans_attached": f"""WITH {POSTINGS}, k AS (SELECT name, CAST(i - 1 AS INTEGER) AS id FROM (SELECT unnest({listed(derive.COMPANIES)}) AS name, generate_subscripts({listed(derive.COMPANIES)}, 1) AS i) WHERE (i - 1) % 2 = 1),
      n AS (SELECT {company_norm("name")} AS norm, min(id) AS id FROM k GROUP BY 1) SELECT external_id, n.id AS company_id FROM p JOIN n ON n.norm = p.company_norm WHERE n.norm <> ''""",
    "company_search": f"WITH {POSTINGS} SELECT external_id, company_name FROM p WHERE company_name ILIKE '%bêta%' OR company_name ILIKE '%gamma%'",
    "company_detail": f"WITH {CONTACTS} SELECT co.company_id, name, city, email, kind FROM co LEFT JOIN ct USING (company_id) WHERE co.company_id = 45",
    "cluster_detail": f"""WITH {HEADS} SELECT cluster_id, string_agg(external_id || ':' || source_kind, '|' ORDER BY first_seen, external_id) AS members FROM m GROUP BY cluster_id HAVING count(*) > 1""",
    "application_log": f"WITH {LOG} SELECT application_id, event_id, to_status, row_number() OVER (PARTITION BY application_id ORDER BY occurred_at DESC, event_id DESC) AS n FROM ev QUALIFY n <= 3",
    "pending_drafts": "SELECT c_custkey AS company_id, 'company:' || c_custkey AS application_id FROM customer WHERE c_custkey % 20 = 0",
    "pending_scores": f"""WITH {SCORED} SELECT cluster_id, CAST(CAST(first_seen AS DATE) AS VARCHAR) AS first_seen FROM hs
      WHERE status = 'passed' AND closed_at IS NULL AND score IS NULL ORDER BY hs.first_seen DESC, cluster_id LIMIT 500""",
    "score_outcomes": f"""WITH {JUDGED} {CACHE}, d AS (SELECT DISTINCT content_hash FROM j WHERE status = 'passed')
      SELECT CASE WHEN score_state = 'ok' THEN 'cached' WHEN score_state = 'failed' AND attempts >= 2 THEN 'failed' WHEN score_state = 'failed' THEN 'deferred' ELSE 'scored' END AS outcome, count(*) AS n
      FROM d LEFT JOIN cache USING (content_hash) GROUP BY 1""",
    "usage_recent": f"""WITH {POSTINGS} {CACHE}, t AS (SELECT content_hash, max(first_seen) AS seen FROM p GROUP BY 1)
      SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
      FROM cache JOIN t USING (content_hash) WHERE seen > TIMESTAMP '2024-03-31' - INTERVAL 30 DAY""",
    "rejected_page": f"WITH {JUDGED} SELECT external_id, rule_score FROM j WHERE status = 'rejected' ORDER BY rule_score DESC, external_id LIMIT 100",
}
