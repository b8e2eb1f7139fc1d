"""Companies found or created one after the other, against a plain replay."""

import random

import pytest

from harrow.operators import companies

KNOWN = "company_id long, siren string, domain string, name_norm string"
ASKED = "request long, siren string, domain string, name_norm string"


def replay(known, requests):
    rows, answers = {c: list(k) for c, *k in known}, {}
    above = max(rows, default=0) + 1
    for request, *keys in sorted(requests, key=lambda r: r[0]):
        if not keys[2]:
            answers[request] = ("refused", None)
            continue
        for i, way in enumerate(("siren", "domain", "name")):
            if found := [c for c, k in rows.items() if keys[i] and k[i] == keys[i]]:
                company = min(found)
                break
        else:
            company, way = above + request, "new"
        rows[company] = [a or b or None for a, b in zip(rows.get(company, [None] * 3), keys, strict=True)]
        answers[request] = (way, company)
    return answers, {c: tuple(x or None for x in k) for c, k in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_sequential_replay(spark, seed):
    rng = random.Random(seed)
    pick = lambda name, n: rng.choice([None, *(f"{name}{i}" for i in range(n))])
    known = [(i, pick("s", 30), pick("d", 30), pick("n", 25)) for i in range(20 if seed else 0)]
    requests = [(i, pick("s", 30), pick("d", 20), rng.choice(["", pick("n", 30)])) for i in range(70)]
    answers, firms = companies.find_or_create(spark.createDataFrame(requests, ASKED), spark.createDataFrame(known, KNOWN))
    expected = replay(known, requests)
    assert {r.request: (r.way, r.company_id) for r in answers.collect()} == expected[0]
    assert {r.company_id: (r.siren, r.domain, r.name_norm) for r in firms.collect()} == expected[1]


def test_clusters_take_the_company_of_their_postings(spark):
    clusters = spark.createDataFrame([(1, None), (2, 7), (3, None)], "cluster_id long, company_id long")
    jobs = spark.createDataFrame([(1, 9), (1, 8), (2, 3), (None, 4), (3, None)], "cluster_id long, company_id long")
    assert {tuple(r) for r in companies.attach_clusters(clusters, jobs).collect()} == {(1, 8), (2, 7), (3, None)}
