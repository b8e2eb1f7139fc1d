"""Thresholds come from every held-out row, and a rare language has limits that mean something."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from harrow.llm import quality

from .samples import rows_of


def test_the_cap_is_for_the_fit_only(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    parts = lambda most: {r["part"]: r["n"] for r in quality.trusted_ids(labels, most=most).groupBy("part").agg({"*": "count"}).toDF("part", "n").collect()}
    every, capped = parts(1_000_000), parts(1000)
    assert sum(every.values()) == 20_000 and capped[0] == every[0]
    assert 800 <= sum(n for part, n in capped.items() if part) <= 1200


def test_rare_languages(spark):
    rng = random.Random(3)
    words = "the of and to in is that for it was on are as with they be at one have this from had by word but".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(120))
    docs = [(i, text(), "en") for i in range(400)] + [(i, text().upper(), "rare") for i in range(400, 406)] + [(900, "#$%zqxj" * 90, "new")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], 1, 0) for d in docs if d[2] != "new"], "doc_id long, quality int, toxic int")
    part = {r["id"]: r["part"] for r in quality.trusted_ids(labels).collect()}
    held = sum(part[i] == 0 for i in range(400, 406))
    got = {r["doc_id"]: r for r in rows_of(quality.classify(frame, labels))}
    assert held and got[405]["kept"] and got[405]["limit"] != got[0]["limit"]
    assert got[900]["kept"] and got[900]["limit"] is None


def test_every_trusted_row_is_fitted(spark):
    labels = spark.range(800_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 800_000


def test_workers_hold_few_grams_at_once():
    rng = random.Random(4)
    column = pa.array(["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(2000)])  # 6 MB
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in quality._counts(iter([pa.RecordBatch.from_arrays([column], names=["text"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows < 250_000 and peak < 55e6  # 358,399 and 61 MB in runs of 1 MiB


def test_tallies_and_remembered_bits_equal_plain_ones(monkeypatch):
    rng = random.Random(5)
    columns = [pa.array(["".join(rng.choices("abé漢 ", k=rng.randrange(60))) for _ in range(50)] + [None, ""]) for _ in range(3)]
    whole = Counter(c for column in columns for _, codes, _ in quality.grams(column) for c in codes.tolist())
    monkeypatch.setattr(quality, "RUN", 200)
    monkeypatch.setattr(quality, "MERGE", 500)
    got = Counter()
    for codes, n in quality._tallies(columns):
        got.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    assert got == whole
    distinct = np.array(sorted(whole))
    keys = np.sort(np.concatenate([distinct[::2] + (quality.ORDER << 56), quality.wanted_contexts(distinct)[::3] + (8 << 56)]))
    values = np.array([rng.random() + 0.01 for _ in keys])
    look = quality._remembered_bits(keys, values)
    for part in (distinct[::3], distinct, distinct[1::2], distinct[:0]):
        assert (look(part) == quality.gram_bits(part, keys, values)).all()
