"""DuckDB SQL for the operators on vectors: every round is a pair of common tables of its own."""

from __future__ import annotations


def _kept(scale: int) -> str:
    return f"""SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"""


def _squared(a: str, b: str, width: int) -> str:
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, width + 1))


def _floors(width: int, x: str = "x") -> str:
    """The floor of each component's mean, in integers."""
    each = (f"(sum({x}[{i}]) - ((sum({x}[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, width + 1))
    return "[" + ", ".join(f"CAST({e} AS BIGINT)" for e in each) + "]"


def clusters(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024) -> str:
    nearest = f"""SELECT v.vec_id, v.x, arg_min(c.k, [{_squared("v.x", "c.x", width)}, c.k]) AS k, min({_squared("v.x", "c.x", width)}) AS d FROM v CROSS JOIN c{{}} c GROUP BY v.vec_id, v.x"""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, x FROM ({_kept(scale)}) WHERE len(x) = {width})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, {_floors(width)} AS x FROM a{r} GROUP BY k) m USING (k))")
    parts.append(f"a AS MATERIALIZED ({nearest.format(rounds)})")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (k)"""


def codes(positions: int = 16, entries: int = 64, rounds: int = 2, width: int = 4, scale: int = 256) -> str:
    nearest = f"""SELECT y.vec_id, y.p, y.x, arg_min(b.e, [{_squared("y.x", "b.x", width)}, b.e]) AS e, min({_squared("y.x", "b.x", width)}) AS d FROM y JOIN b{{}} b USING (p) GROUP BY y.vec_id, y.p, y.x"""
    parts = [
        f"v AS MATERIALIZED (SELECT * FROM ({_kept(scale)}) WHERE len(x) = {positions * width})",
        f"y AS MATERIALIZED (SELECT vec_id, p, x[p * {width} + 1:p * {width} + {width}] AS x FROM v, range({positions}) t(p))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT y.p, s.e, y.x FROM s JOIN y USING (vec_id))",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        parts.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT p, e, {_floors(width)} AS x FROM a{r} GROUP BY p, e) m USING (p, e))")
    parts.append(f"a AS MATERIALIZED ({nearest.format(rounds)})")
    parts.append("g AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY vec_id)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM g JOIN v USING (vec_id)"""
