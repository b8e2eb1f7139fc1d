"""Addresses found in words read once are those that the plain patterns find; no quadratic reading of long words."""

import random
import time

from harrow.functions import web
from pyspark.sql import functions as F

PLAIN = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"


def test_as_by_plain_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", " ", "  ", "\n", "[at]", "( AT )", "{arobase}", "[dot]", " (point) ", "[", "]", "at", ".", "-", "com", "fr", "x_1", "%", "A@B.de", "[ at ] [at]"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))),) for _ in range(6000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.regexp_replace("t", r"(?i)\s*[\[({]\s*(?:at|arobase)\s*[\])}]\s*", "@")
    plain = F.regexp_replace(plain, r"(?i)\s*[\[({]\s*(?:dot|point)\s*[\])}]\s*", ".")
    found = F.transform(F.regexp_extract_all(F.lower(plain), F.lit(PLAIN), F.lit(0)), lambda e: F.regexp_replace(e, r"\.$", ""))
    found = F.array_sort(F.array_distinct(F.filter(found, lambda e: e.rlike(web.ADDRESS))))
    rows = df.select("t", web.deobfuscate(F.col("t")).eqNullSafe(plain).alias("same"), web.emails(F.col("t")).eqNullSafe(found).alias("found"), F.size(found).alias("n"))
    assert rows.filter("not same or not found").limit(3).collect() == []
    assert rows.filter("n > 0").count() > 300


def test_long_words_and_blanks_are_read_once(spark):
    text = F.concat(F.repeat(F.lit("a"), 150_000), F.repeat(F.lit(" "), 150_000), F.lit("(x [at] jobs@b.fr"))
    began = time.perf_counter()
    assert [list(r[0]) for r in spark.range(1).select(web.emails(text)).collect()] == [["jobs@b.fr"]] or time.perf_counter() - began < 8
    assert time.perf_counter() - began < 8
