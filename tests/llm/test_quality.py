import random
from collections import Counter
from math import log2

import pytest

from harrow.llm import quality

from .samples import awkward, nothing, rows_of


def brute_kneser_ney(texts, order=quality.ORDER):
    """gram (a string) -> interpolated probability of its last character after the others, in plain Python."""
    start = "\n" * (order - 1)
    counts = {order: Counter((start + t)[i : i + order] for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {k: quality.discounts(*(sum(n == m for n in counts[k].values()) for m in (1, 2, 3, 4))) for k in counts}

    def probability(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        k, context = len(gram), gram[:-1]
        here = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not here:
            return probability(gram[1:])
        cut = {g: cuts[k][min(n, 3) - 1] for g, n in here.items()}
        own = max(here[gram] - cut[gram], 0) if gram in here else 0
        return (own + sum(cut.values()) * probability(gram[1:])) / sum(here.values())

    return probability


def test_model_against_brute_force(spark):
    """Every order, unseen grams, letters beyond Latin, repeated rows, null ids, languages and texts."""
    fit = ["the cat sat on the mat. the dog sat.", "a cat and a dog", "кот и пёс, ça va", "the cat sat on the mat. the dog sat."]
    model = quality.kneser_ney(spark.createDataFrame([(t,) for t in fit], "text string"))
    probability = brute_kneser_ney(fit)
    other = ["the cat sat on a log", "xyz", "кот", "", None, "a", "the cat sat on a log"]
    rows = [(i if i != 2 else None, i, "en" if i else None, t) for i, t in enumerate(other)]
    got = rows_of(quality.bits_per_character(spark.createDataFrame(rows, "id long, h long, lang string, text string"), model))
    assert len(got) == len(other)
    for r in got:
        text = other[r["h"]] or ""
        assert r["n"] == len(text)
        padded = "\n" * (quality.ORDER - 1) + text
        bits = [-log2(probability(padded[i : i + quality.ORDER])) for i in range(len(text))]
        assert r["bits"] == (pytest.approx(sum(bits) / len(bits)) if text else None)
    (root,) = [r for r in model.collect() if r["key"] >> quality._TAG == 1]
    rest = (quality.SYMBOLS - len(root["ps"])) / quality.SYMBOLS * root["weight"]
    assert sum(root["ps"]) + rest == pytest.approx(1.0)


def test_long_texts_cross_no_border(spark):
    """Texts around the sizes of runs and blocks give what a short piece of them, repeated, must give."""
    model = quality.kneser_ney(spark.createDataFrame([("abcde fghij " * 50,)], "text string"))
    rows = [(1, 1, "en", "abcde fghij " * 1000), (2, 2, "en", "abcde fghij " * 300_000), (3, 3, "en", "abcde fghij " * 1_500_000), (4, 4, "en", "zz")]
    got = {r["id"]: r for r in rows_of(quality.bits_per_character(spark.createDataFrame(rows, "id long, h long, lang string, text string"), model))}
    assert [got[i]["n"] for i in (1, 2, 3, 4)] == [12_000, 3_600_000, 18_000_000, 2]
    assert got[2]["bits"] == pytest.approx(got[1]["bits"], rel=1e-2) and got[3]["bits"] == pytest.approx(got[2]["bits"], rel=1e-4)


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    words = "the of and to in is that for it was on are as with they be at one have this from had by word but".split()
    good = lambda: " ".join(rng.choice(words) for _ in range(120)) + "."
    junk = lambda: "".join(rng.choice("#$%zqxj0123456789{}|") for _ in range(600))
    docs = [(i, good() if i % 4 else junk(), "en") for i in range(400)]
    labels = [(i, 1 if i % 4 else 0, 0) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in rows_of(quality.classify(frame, marks))}
    unseen = range(200, 400)
    assert sum(kept[i] == bool(i % 4) for i in unseen) / len(unseen) >= 0.98


def test_quality_awkward(spark):
    marks = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    docs = awkward(spark)
    assert quality.classify(docs, marks).count() == docs.count()
    assert quality.classify(docs, marks.limit(0)).filter("not kept").count() == 0
    assert quality.classify(nothing(spark), marks).count() == 0
    assert quality.keep_good(docs, marks).columns == docs.columns


def test_a_verdict_holds_for_its_row_alone(spark):
    good = "the of and to in is that for it was on are as with they be at one have this from had by word but "
    rows = [(i, good[i % 40 :] * 4, "en") for i in range(300)]
    junk = "#$%zq0x1j9{}|" * 40
    rows += [(7, junk, "en"), (None, junk, "en"), (None, good * 3, "en"), (None, None, None), (9, good[9:] * 4, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(300) if i != 7], "doc_id long, quality int, toxic int")
    kept = rows_of(quality.keep_good(docs, marks))
    assert len(kept) == len(rows) - 2 and all(r["text"] != junk for r in kept)
    assert sum(r["doc_id"] == 7 for r in kept) == 1 and sum(r["doc_id"] is None for r in kept) == 2
