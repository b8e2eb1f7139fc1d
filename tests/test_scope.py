"""A word that ends as a time zone's name is none, wherever a search for needles cuts the text."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.functions import classify
from harrow.plans import catalogue

from .test_queries import SF, TABLES, plain

#: 64 characters before " remote" stands the end of "forest".
WOODS = "Deep in the forest " + " ".join(["abcde"] * 9 + ["abcdef"]) + " remote paths"


def test_a_zone_is_a_whole_word(spark):
    rows = spark.createDataFrame([(WOODS,), (WOODS.replace("forest", "for est"),), ("x" * 80 + " from us remote",), ("x" * 80 + " campus remote",)], "t string")
    assert [r[0] for r in rows.select(classify.detect_scope(F.lit(None).cast("string"), F.col("t"))).collect()] == ["unknown", "other", "other", "unknown"]


def test_near_needles_as_in_the_whole_text(spark):
    """Every list as ``classify`` uses it, with all places where a cut may be."""
    lists = ((classify.ZONES, classify.ZONE_NEEDLES), (classify.one_of(classify.SCOPE_OTHER_BUT_ZONES), classify.SCOPE_OTHER_NEEDLES))
    texts = [f"forest honest {'y' * n} us only {word} us remote paths" for n in range(1, 90) for word in ("est", "campus", "remote uk")]
    texts += [f"forest honest {'y' * n} remote paths" for n in range(1, 90)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, needles in lists:
        assert rows.filter(classify.found_in(F.col("t"), pattern, *needles) != F.col("t").rlike(pattern)).limit(3).collect() == []


@pytest.fixture(scope="module")
def woods(spark, tmp_path_factory):
    """Tables whose documents all hold such a place."""
    at = tmp_path_factory.mktemp("woods")
    for name in set(TABLES.split()) - {"documents", "labels"}:
        os.symlink(f"{SF}/{name}.parquet", at / f"{name}.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    text = f"rpad('Note ' || i, 33, 'n') || '. {WOODS}. Number ' || i"
    con.execute(f"COPY (SELECT i AS doc_id, {text} AS text, 'en' AS lang, 'src' || i % 20 AS source, 100 AS n_chars FROM range(400) r(i)) TO '{at}/documents.parquet'")
    con.execute(f"COPY (SELECT i AS doc_id, i % 2 AS quality, 0::BIGINT AS toxic FROM range(400) r(i)) TO '{at}/labels.parquet'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet')")
    return str(at), con


@pytest.mark.parametrize("name", "canonical_pick cluster_rollup dry_run feed_lever score_outcomes sources_overview reject_first_reason reject_reason_histogram".split())
def test_queries_of_postings_with_such_words(spark, woods, name):
    at, con = woods
    assert plain(catalogue.QUERIES[name](spark, at).toPandas()) == plain(con.execute(catalogue.SQL[name]).df())
