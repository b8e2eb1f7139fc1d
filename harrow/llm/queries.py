"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    clustering,
    exact_dedup,
    html_text,
    line_dedup,
    media,
    mixing,
    near_dedup,
    packing,
    piece_coding,
    quality,
    repeats,
    token_counts,
    vector_codes,
    vector_sql,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents"))


def line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_line_dedup by a narrower rule: lines of four tokens and more, by their templates alone."""
    return line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents"), **line_dedup.LONG_ONLY)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.code_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_html_text": op3_html_text,
    "op4_media": op4_media,
    "op5_quality": op5_quality,
    "op6_repeats": op6_repeats,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_piece_coding": op12_piece_coding,
    "op13_clusters": op13_clusters,
    "line_dedup_long": line_dedup_long,
}

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         0.75::DOUBLE + 0.25::DOUBLE * length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) / greatest(length(coalesce(text, '')), 1) AS w,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(u) / w AS key FROM sized),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM keyed GROUP BY source),
capped AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM per),
ratios AS (SELECT *, cap::DOUBLE / weight AS ratio FROM capped),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv
  FROM ratios),
targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce(max(CASE WHEN lv <= ratio THEN lv END) OVER () * weight, cap::DOUBLE)) AS target
  FROM levels),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS e FROM targets),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.e,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN epochs t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (e + CASE WHEN before + size / 2.0::DOUBLE <= target - e * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

LINES_LONG_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
plain AS (SELECT doc_id, text, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS p FROM raw),
masked AS (SELECT doc_id, text, pos, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM plain WHERE p <> ''),
lines AS (
  SELECT doc_id, text, pos, line, len(string_split(line, ' ')) AS n,
         array_to_string(string_split(line, ' ')[1:3], ' ') AS head
  FROM masked WHERE len(string_split(line, ' ')) >= 4),
leaves AS (SELECT n, head FROM lines GROUP BY n, head HAVING count(DISTINCT text) >= 5),
kept AS (SELECT l.* FROM lines l SEMI JOIN leaves USING (n, head)),
variants AS (SELECT n, head, line, count(DISTINCT text) AS docs FROM kept GROUP BY n, head, line),
tokens AS (
  SELECT n, head, line, docs, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS spot
  FROM variants),
common AS (
  SELECT n, head, spot, token FROM tokens WHERE token <> '<*>' GROUP BY n, head, spot, token HAVING sum(docs) >= 5),
templates AS (
  SELECT t.n, t.head, t.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY t.spot) AS template,
         avg(CASE WHEN c.token IS NULL THEN 0.0 ELSE 1.0 END) AS share
  FROM tokens t LEFT JOIN common c ON t.n = c.n AND t.head = c.head AND t.spot = c.spot AND t.token = c.token
  GROUP BY t.n, t.head, t.line),
placed AS (
  SELECT k.doc_id, k.text, k.pos, t.template FROM kept k JOIN templates t USING (n, head, line) WHERE t.share >= 0.6),
shared AS (SELECT template FROM placed GROUP BY template HAVING count(DISTINCT text) >= 5),
drops AS (SELECT doc_id, text, list(DISTINCT pos) AS dropped FROM placed SEMI JOIN shared USING (template) GROUP BY doc_id, text)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n_lines,
       CAST(coalesce(len(x.dropped), 0) AS INTEGER) AS n_dropped,
       CASE WHEN x.dropped IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_transform(
              list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(x.dropped, i)),
              lambda i: string_split(d.text, chr(10))[i]), chr(10)), '') END AS text
FROM docs d LEFT JOIN drops x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM w
"""

OP8_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
plain AS (SELECT doc_id, text, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS p FROM raw),
masked AS (SELECT doc_id, text, pos, p, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM plain WHERE p <> ''),
lines AS (
  SELECT doc_id, text, pos, line, len(string_split(line, ' ')) AS n,
         array_to_string(string_split(line, ' ')[1:3], ' ') AS head
  FROM masked),
leaves AS (SELECT n, head FROM lines GROUP BY n, head HAVING count(DISTINCT text) >= 5),
kept AS (SELECT l.* FROM lines l SEMI JOIN leaves USING (n, head)),
variants AS (SELECT n, head, line, count(DISTINCT text) AS docs FROM kept GROUP BY n, head, line),
tokens AS (
  SELECT n, head, line, docs, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS spot
  FROM variants),
common AS (
  SELECT n, head, spot, token FROM tokens WHERE token <> '<*>' GROUP BY n, head, spot, token HAVING sum(docs) >= 5),
templates AS (
  SELECT t.n, t.head, t.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY t.spot) AS template,
         avg(CASE WHEN c.token IS NULL THEN 0.0 ELSE 1.0 END) AS share
  FROM tokens t LEFT JOIN common c ON t.n = c.n AND t.head = c.head AND t.spot = c.spot AND t.token = c.token
  GROUP BY t.n, t.head, t.line),
placed AS (
  SELECT k.doc_id, k.text, k.pos, t.template FROM kept k JOIN templates t USING (n, head, line) WHERE t.share >= 0.6),
shared AS (SELECT template FROM placed GROUP BY template HAVING count(DISTINCT text) >= 5),
same AS (SELECT p FROM masked GROUP BY p HAVING count(DISTINCT text) >= 5),
gone AS (
  SELECT doc_id, text, pos FROM placed SEMI JOIN shared USING (template)
  UNION SELECT doc_id, text, pos FROM masked SEMI JOIN same USING (p)),
drops AS (SELECT doc_id, text, list(DISTINCT pos) AS dropped FROM gone GROUP BY doc_id, text)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n_lines,
       CAST(coalesce(len(x.dropped), 0) AS INTEGER) AS n_dropped,
       CASE WHEN x.dropped IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_transform(
              list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(x.dropped, i)),
              lambda i: string_split(d.text, chr(10))[i]), chr(10)), '') END AS text
FROM docs d LEFT JOIN drops x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text
"""

ORACLE_SQL = {
    "op2_mixing": OP2_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_vector_codes": vector_sql.codes(),
    "op13_clusters": vector_sql.clusters(),
    "line_dedup_long": LINES_LONG_SQL,
}
