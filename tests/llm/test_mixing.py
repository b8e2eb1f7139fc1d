import random
from math import isclose

from harrow.llm.mixing import mix, mixed_documents

from .samples import awkward, nothing, rows_of


def targets_by_hand(sizes):
    """Water filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            open_.discard(s)
    return target


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a"] * 6 + ["b", "c", None]), "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = rows_of(mix(docs))
    assert len(got) == 600 and got and sorted(map(str, rows_of(mix(docs)))) == sorted(map(str, got))
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    wanted = targets_by_hand(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and isclose(r["target"], wanted[r["source"]], rel_tol=1e-9)
    for source in sizes:
        assert abs(taken[source] - wanted[source]) <= 60
    repeated = mixed_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["epochs"] + r["sampled"] for r in got)


def test_mix_awkward(spark):
    docs = awkward(spark)
    assert mix(docs).count() == docs.count()
    assert mix(nothing(spark)).count() == 0


def test_each_row_has_its_own_verdict(spark):
    """Repeated ids, documents without words in a source at its cap, null sources and clashing columns."""
    rows = [(i % 7, "w " * (i % 5), ("small" if i < 40 else "big") if i % 11 else None, 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    drawn = rows_of(mix(docs))
    got = rows_of(mixed_documents(docs))
    assert len(got) == sum(r["epochs"] + r["sampled"] for r in drawn)
    assert sum(len(r["text"].split()) for r in got) == sum(r["taken"] for r in drawn)
    assert all(r["epochs"] + r["sampled"] <= 3 and (r["size"] or not r["sampled"]) for r in drawn)
    assert mixed_documents(nothing(spark)).count() == 0 and mixed_documents(awkward(spark)).columns == awkward(spark).columns
