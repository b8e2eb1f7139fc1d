"""Assignment in order of arrival against a plain replay, posting by posting."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harrow.functions import keys
from harrow.operators import assign, graph, similar

NOW = datetime(2024, 4, 15)
CLUSTER = "cluster_id long, dedup_key string, company_norm string, title_norm string, company_id long, last_seen timestamp, open boolean, sources array<string>"
POSTING = "external_id long, source_id string, dedup_key string, company_norm string, title_norm string, company_id long"


def grams(text):
    return {g for w in re.findall("[a-z0-9]+", text.lower()) for g in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def qualifiers(title):
    return sorted(set(re.findall(keys.QUALIFIERS, title)))


def replay(postings, clusters):
    """The rule, one posting at a time."""
    all_, out, clock = [dict(c, at=(0, c["last_seen"], c["cluster_id"])) for c in clusters], Counter(), 0
    for p in sorted(postings, key=lambda p: (p["external_id"], p["source_id"])):
        fresh = [c for c in all_ if c["open"] and c["last_seen"] > NOW - timedelta(days=45)]
        exact = [c for c in fresh if p["company_norm"] and c["dedup_key"] == p["dedup_key"]]
        previous = None
        if exact:
            to, way = max(exact, key=lambda c: c["at"]), "exact"
        else:
            near = []
            for c in fresh if p["company_norm"] else ():
                company = (p["company_norm"] and c["company_norm"] == p["company_norm"]) or (p["company_id"] is not None and c["company_id"] == p["company_id"])
                sim = similarity(p["title_norm"], c["title_norm"])
                if company and sim >= 0.75 and p["source_id"] not in c["sources"]:
                    near.append((-sim, c["cluster_id"], c))
            near.sort(key=lambda x: x[:2])
            to, way = next((c for _, _, c in near[:5] if qualifiers(c["title_norm"]) == qualifiers(p["title_norm"])), None), "similar"
            if to is None:
                old = [c for c in all_ if p["company_norm"] and c["dedup_key"] == p["dedup_key"]]
                previous = max(old, key=lambda c: c["at"])["cluster_id"] if old else None
                to, way = {**p, "cluster_id": p["external_id"], "open": True, "sources": set()}, "new"
                all_.append(to)
        clock += 1
        to.update(last_seen=NOW, at=(1, clock, 0), sources={*to["sources"], p["source_id"]})
        out[p["external_id"], p["source_id"], to["cluster_id"], way, previous] += 1
    return out


def stream(rng, n, ids):
    """Postings of few companies with titles that are near each other, some under one key from many sources."""
    words = ["data", "engineer", "platform", "senior", "developer", "python", "team"]
    base = [" ".join(rng.sample(words, 4)) for _ in range(3)]
    out = []
    for i in range(n):
        title = rng.choice(base)
        if rng.random() < 0.7:
            title += rng.choice([" a", " b", " ab", " x1", " x12", " senior", " xy", " team"])
        company = rng.choice(["acme", "acme", "beta", ""])
        key = f"{company}|{title}" if company else rng.choice([None, f"anon|{i}"])
        out.append((ids + i, rng.choice("abcd"), key, company, title, rng.choice([None, 1, 2])))
    return [dict(zip(("external_id", "source_id", "dedup_key", "company_norm", "title_norm", "company_id"), r, strict=True)) for r in out]


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_sequential_replay(spark, seed):
    rng = random.Random(seed)
    clusters = []
    for p in stream(rng, 14 if seed else 0, 1):
        if p["dedup_key"] and p["company_norm"]:
            seen = NOW - timedelta(days=rng.choice([1, 1, 2, 44, 46, 90]))
            clusters.append({**p, "cluster_id": p["external_id"], "last_seen": seen, "open": rng.random() < 0.8, "sources": rng.sample("abcd", rng.choice([1, 1, 3]))})
    postings = stream(rng, 120, 1000)
    order = [c.split()[0] for c in CLUSTER.split(", ")]
    table = spark.createDataFrame([[c[k] for k in order] for c in clusters], CLUSTER)
    new = spark.createDataFrame([tuple(p.values()) for p in postings], POSTING)
    got = assign.assign(new, table, F.to_timestamp(F.lit(str(NOW)))).collect()
    assert Counter(tuple(r) for r in got) == replay(postings, clusters)


def test_exact_key_has_no_test_of_sources(spark):
    """Two postings of a source that a cluster with their key holds already both join it."""
    seen = NOW - timedelta(days=5)
    table = spark.createDataFrame([(9, "acme|data engineer", "acme", "data engineer", None, seen, True, ["a"])], CLUSTER)
    new = spark.createDataFrame([(i, "a", "acme|data engineer", "acme", "data engineer", None) for i in (1, 2)], POSTING)
    got = assign.assign(new, table, F.to_timestamp(F.lit(str(NOW)))).collect()
    assert {(r.external_id, r.cluster_id, r.way) for r in got} == {(1, 9, "exact"), (2, 9, "exact")}


@pytest.mark.parametrize("least", [0.4, 0.75])
def test_similar_pairs_equal_all_pairs(spark, least):
    rng = random.Random(8)
    words = ["data", "engineer", "dataset", "engine", "x", "platform", "form"]
    titles = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(60)} | {"", "??"})
    rows = [(rng.choice("pq"), t) for t in titles]
    df = spark.createDataFrame([*rows, *rows[:5], (None, "data"), ("p", None)], "block string, title string")
    expected = {(k, a, b): similarity(a, b) for k, a in rows for j, b in rows if k == j and grams(a) and grams(b) and similarity(a, b) >= least}
    both = similar.similar_pairs(df, df, "block", "title", least).collect()
    assert len(both) == len(expected) and all(abs(expected[r.block, r.a, r.b] - r.sim) < 1e-12 for r in both)
    own = similar.similar_pairs(df, None, "block", "title", least).collect()
    assert {(r.block, r.a, r.b) for r in own} == {k for k in expected if k[1] < k[2]}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7), (200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
