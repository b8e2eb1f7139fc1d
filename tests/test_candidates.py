"""Merge candidates against all pairs."""

import random

from harrow.operators import candidates

from .test_assign import similarity


def test_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["data", "engineer", "dataset", "platform", "senior", "sales", "x", "web"]
    rows = [(i, rng.choice(["acme"] * 4 + ["beta", "", None]), " ".join(rng.choices(words, k=rng.randrange(1, 5))), rng.random() < 0.8) for i in range(150)]
    rows += [(200 + i, "acme", "same title here", True) for i in range(30)] + [(300, "solo", "one", True), (301, "acme", "???", True), (302, "acme", None, True)]
    expected = set()
    for i, company, title, _ in rows:
        near = []
        for j, other, name, is_open in rows:
            if i != j and is_open and (not company or company == other):
                sim = similarity(title or "", name or "")
                if company or sim > 0.4:
                    near.append((-sim, j))
        expected |= {(i, j, -sim, n + 1) for n, (sim, j) in enumerate(sorted(near)[:20])}
    df = spark.createDataFrame(rows, "cluster_id long, company_norm string, title_norm string, open boolean")
    got = {(r.cluster_id, r.other_id, r.sim, r.n) for r in candidates.merge_candidates(df).collect()}
    assert got == {(i, j, abs(s), n) for i, j, s, n in expected}


def test_parts_give_what_one_part_gives(spark, monkeypatch):
    """Texts dealt into many parts: the best of each text and all pairs above a threshold."""
    from harrow.operators import similar

    rng = random.Random(8)
    words = ["data", "engineer", "dataset", "platform", "senior", "sales", "x", "web"]
    df = spark.createDataFrame([(i, "acme", " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i in range(120)] + [(200, "acme", "")], "n long, block string, title string")
    best = lambda: sorted(map(tuple, similar.nearest(df, df, "block", "title", "n", 5).collect()))
    near = lambda: sorted(map(tuple, similar.similar_pairs(df, None, "block", "title", 0.4).collect()))
    one = best(), near()
    monkeypatch.setattr(similar, "PART", 16)
    assert (best(), near()) == one and len(one[0]) > 100
