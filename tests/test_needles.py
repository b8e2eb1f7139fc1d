"""Patterns that are tried only near their needles find what they find in the whole text."""

import random
import re

from harrow.functions import classify, text
from pyspark.sql import functions as F

LISTS = (
    ([classify.one_of(classify.FULL_REMOTE)], classify.FULL_REMOTE_NEEDLES), ([classify.one_of(classify.HYBRID)], classify.HYBRID_NEEDLES), ([classify.one_of(classify.ONSITE)], classify.ONSITE_NEEDLES),
    ([classify.one_of(classify.SCOPE_OTHER), classify.ZONES], classify.SCOPE_OTHER_NEEDLES + classify.ZONE_NEEDLES), ([classify.one_of(classify.SCOPE_FRANCE[:-1])], classify.SCOPE_FRANCE_NEEDLES),
    ([classify.one_of(classify.SCOPE_EUROPE)], classify.SCOPE_EUROPE_NEEDLES), ([classify.one_of(classify.SCOPE_WORLD)], classify.SCOPE_WORLD_NEEDLES),
    *(([p], classify.CONTRACT_NEEDLES[name]) for name, p in classify.CONTRACTS.items()), ([classify.STRONG_CDI], classify.CONTRACT_NEEDLES["cdi"]),
)


def texts(patterns, rng, n):
    """Texts of the patterns' words and near ones, some far from the start."""
    words = re.findall(r"[a-z]+|\d", re.sub(r"\\[a-z]", " ", " ".join(patterns))) + ["x", "2", "100", "eu.", "a+b"]
    for i in range(n):
        body = rng.choice([" ", " ", ""]).join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        yield ("lorem ipsum " * rng.randrange(0, 30) + body + rng.choice(["", " dolor", "s"])).strip()


def test_needles_lose_nothing(spark):
    rng = random.Random(1)
    for patterns, needles in LISTS:
        rows = spark.createDataFrame([(t,) for t in texts(patterns, rng, 1500)], "t string")
        plain = F.lit(False)
        for p in patterns:
            plain = plain | F.col("t").rlike(p)
        got = rows.select(text.found_in(F.col("t"), classify.one_of(tuple(patterns)), *needles).alias("got"), plain.alias("whole"), "t").filter("got <> whole").limit(3).collect()
        assert got == []
    assert rows.select(text.found_in(F.col("t"), "x").alias("a"), F.col("t").rlike("x").alias("b")).filter("a <> b").count() == 0


def test_white_space_as_by_plain_patterns(spark):
    rng = random.Random(2)
    pieces = ["a", "bc", " ", "  ", "\n", "\r\n", "\t", " ", " \n ", "\n\n", " ", "\u0085", "\x0b", " ", ".", "É", "_", "+"]
    rows = spark.createDataFrame([("".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))),) for _ in range(4000)] + [(None,)], "t string")
    steps = ((r"\r", ""), (r"[\t\f\x0B\x{00A0}\x{2009}\x{202F} ]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n"), (r"^\n|\n$", ""))
    plain = F.col("t")
    for pattern, to in steps:
        plain = F.regexp_replace(plain, pattern, to)
    once = text.normalize_whitespace(F.col("t"))
    folded = F.trim(F.regexp_replace(text.strip_accents(F.lower("t")), r"[^a-z0-9+#.]+", " "))
    rows = rows.select(once.eqNullSafe(F.trim(plain)).alias("same"), text.fold(F.col("t")).eqNullSafe(folded).alias("folded"))
    assert rows.filter("not same or not folded").count() == 0


def test_no_task_has_all_rows_of_a_row_group(spark, tmp_path):
    from harrow.plans import derive

    spark.range(3000).selectExpr("id AS doc_id", "concat('Text ', id, '. more') AS text", "'src1' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = [r["n"] for r in derive.drafts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500
