import random
import re
from collections import Counter

import numpy as np

from harrow.llm.near_dedup import drop_near_duplicates, estimate, near_duplicates, registers

from .samples import awkward, nothing, rows_of


def shingles(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + k]) for i in range(max(len(found) - k + 1, 1))} if found else set()


def brute_force(rows, k, percent):
    """For each row the smallest id among the rows that links reach, or its own id without words."""
    sets = [shingles(r["text"], k) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= percent * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    found = [least.get(g) if s else r["doc_id"] for g, s, r in zip(group, sets, rows, strict=True)]
    return Counter((r["doc_id"], len(s), c, c is None or r["doc_id"] == c) for r, s, c in zip(rows, sets, found, strict=True))


def check(docs, k, percent, **options):
    got = rows_of(near_duplicates(docs, words=k, percent=percent, **options))
    assert Counter(tuple(r.values()) for r in got) == brute_force(rows_of(docs), k, percent)


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs, 3, 85)
    got = {r["doc_id"]: r for r in rows_of(near_duplicates(docs, words=3, percent=85))}
    assert [got[i]["n_shingles"] for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert all(got[i]["component_id"] == i for i in (0, 1, 2))
    assert near_duplicates(nothing(spark)).count() == 0
    assert drop_near_duplicates(docs).columns == docs.columns


def test_rows_that_repeat_an_id_have_links_of_their_own(spark):
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, other, third = prose(100), prose(100), prose(80)
    near = [*other[:-1], "end"]
    rows = [(1, one), (1, other), (2, near), (None, [*third, "x"]), (None, third), (5, [*third, "y"]), (5, one), (6, prose(50)), (None, prose(40)), (None, near)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    check(docs, 3, 85)
    got = [(r["doc_id"], r["component_id"]) for r in rows_of(near_duplicates(docs, words=3, percent=85))]
    assert (2, 1) in got and (None, 5) in got
    kept = rows_of(drop_near_duplicates(docs, words=3, percent=85))
    assert len(kept) == 5 and sum(r["doc_id"] is None for r in kept) == 1


def test_group_of_variants_in_small_blocks(spark):
    """Variants of one text around the threshold, so that buckets hold several components and are banded again."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randrange(2, 12)):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=8)


def test_a_shared_passage_with_pairs_among_it(spark):
    """All share half of their words; only planted pairs are near each other."""
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage, rows = prose(200), []
    for i in range(120):
        own = prose(100)
        rows.append((2 * i, " ".join(passage + own)))
        if i % 6 == 0:
            own[50] = "changed"
            rows.append((2 * i + 1, " ".join(passage + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, 5, 80, block=4)


def test_very_long_texts(spark):
    """Above the size at which texts are hashed together."""
    long = " ".join(f"word{i * 37 % 100_003}" for i in range(250_000))
    rows = [(1, long), (2, long.replace("word5", "word6")), (3, "short " + long[:1_000_000]), (4, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, 5, 80)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (8000, 1000, 1000))
    sketches = registers([np.concatenate([both, a]), np.concatenate([both, b])], 1024)
    n = np.array([9000.0])
    assert abs(estimate(sketches[:1], sketches[1:], n, n)[0] - 0.8) < 0.06
    union = registers([np.concatenate([both, a, b])], 1024)
    assert (union == np.maximum(sketches[:1], sketches[1:])).all()  # mergeable
