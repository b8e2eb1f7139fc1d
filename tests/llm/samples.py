"""Rows with what is awkward: nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, size long, `key` string, n int"


def awkward(spark, extra=()):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    changed = base.split()
    changed[60] = "other"
    texts = [None, "", " \t\n", "one", "one two", base, base, base.replace(" ", "  "), " ".join(changed), prose(30_000), "Ünïcode – “quotes” 漢字 🎉", *extra]
    rows = [(i, t, "en" if i % 3 else None, ("a", "b", None)[i % 3], None, 1, 2, 3, "k", 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
