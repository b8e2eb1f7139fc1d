"""Merges one after the other against a plain replay."""

import random
from collections import Counter

import pytest

from harrow.operators import merges

TRIAGE = ["new", "dismissed", "interested", "applied"]


def replay(clusters, apps, requests):
    triage, has, home, refused = dict(clusters), Counter(c for _, c in apps), {c: c for c, _ in clusters}, []
    for _, s, t in sorted(requests, key=lambda r: (r[0], str(r[1]), str(r[2]))):
        if s is not None and s == t:
            refused.append((s, t, "VALIDATION"))
        elif s not in triage or t not in triage:
            refused.append((s, t, "NOT_FOUND"))
        elif has[s] + has[t] > 1:
            refused.append((s, t, "CONFLICT"))
        else:
            triage[t] = max(triage.pop(s), triage[t], key=TRIAGE.index)
            has[t] += has.pop(s, 0)
            home = {c: t if h == s else h for c, h in home.items()}
    return triage, home, Counter(refused)


def check(spark, clusters, apps, requests):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    jobs = [(100 + c, c) for c, _ in clusters]
    got = merges.merge_clusters(
        frame(jobs, "external_id long, cluster_id long"), frame(clusters, "cluster_id long, triage string"), frame(apps, "application_id long, cluster_id long"),
        frame(requests, "at long, source long, target long"), ("at", "source", "target"),
    )
    triage, home, refused = replay(clusters, apps, requests)
    assert {r.external_id: r.cluster_id for r in got[0].collect()} == {100 + c: home[c] for c, _ in clusters}
    assert {r.cluster_id: r.triage for r in got[1].collect()} == triage
    assert {r.application_id: r.cluster_id for r in got[2].collect()} == {a: home[c] for a, c in apps}
    assert Counter(tuple(r) for r in got[3].collect()) == refused


@pytest.mark.parametrize("seed", range(3))
def test_random_sequences(spark, seed):
    rng = random.Random(seed)
    clusters = [(i, rng.choice(TRIAGE)) for i in range(60)]
    apps = [(i, i) for i in range(60) if rng.random() < 0.2]
    requests = [(k, rng.randrange(64), rng.randrange(64)) for k in range(50)] + [(60 + k, 59 - k, 50) for k in range(6)]
    check(spark, clusters, apps, requests)


def test_chains_stars_conflicts_and_nothing(spark):
    clusters = [(i, "new") for i in range(40)]
    chain = [(i, i, i + 1) for i in range(12)]
    star = [(20, i, 39) for i in range(20, 35)]
    check(spark, clusters, [(1, 3), (2, 8), (3, 21), (4, 22)], chain + star + [(21, 5, 6), (22, None, 3), (23, 38, None), (24, 38, 38)])
    check(spark, clusters, [], [])
