"""The stream over payload files, versions of a snapshot, and the steps of ingestion on small cases of our own."""

import json

import pytest
from pyspark.sql import functions as F

from harrow.functions import keys
from harrow.functions.text import normalize_company, normalize_title
from harrow.operators.rules import Criteria, CriteriaFile
from harrow.operators.snapshot import cut
from harrow.plans import derive
from harrow.sources import feeds, registry
from harrow.sources.build import build
from harrow.streaming import ingest
from harrow.streaming.table import BucketTable



def now():
    return F.to_timestamp(F.lit("2024-05-01"))


JOBS = (
    "source_id string, external_id string, title string, title_norm string, company_name string, company_norm string, dedup_key string, content_hash string, "
    "cluster_id string, first_seen timestamp, last_seen timestamp, closed_at timestamp"
)


def read(payloads):
    """Postings of payload files as a step takes them."""
    rows = build(feeds.greenhouse(payloads)).filter(F.size("failed") == 0)
    rows = rows.withColumns({"title_norm": normalize_title(F.col("title")), "company_norm": normalize_company(F.col("company_name")), "at": F.lit(0)})
    rows = rows.withColumns(
        {"dedup_key": keys.dedup_key(F.col("company_norm"), F.col("title_norm")), "content_hash": keys.content_hash(F.col("title_norm"), F.col("company_norm"), F.col("description"))}
    )
    return rows.select("source_id", "external_id", "title", "title_norm", "company_name", "company_norm", "dedup_key", "content_hash", "at")


def payload(folder, name, source, *jobs):
    body = json.dumps({"jobs": [{"id": i, "title": t, "absolute_url": f"https://x.example/{i}", "company_name": "Acme", "content": c} for i, t, c in jobs]})
    (folder / name).write_text(json.dumps({"source_id": source, "company": "Acme", "slug": "acme", "body": body}))


SCHEMA = "source_id string, company string, slug string, body string"


def bucket_table(spark, path, **options):
    schema = spark.createDataFrame([], JOBS).schema
    return BucketTable(spark, f"{path}/jobs", schema, ("source_id",), ("external_id",), buckets=16, **options)


def test_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    jobs = bucket_table(spark, tmp_path)
    run = lambda: ingest.run_stream(spark, str(feed), SCHEMA, f"{tmp_path}/check", read, jobs, now, complete=True)
    payload(feed, "a.json", "a", (1, "Data engineer", "one"), (2, "Python developer", "two"), (None, "No id", "three"))
    payload(feed, "z.json", "z", *((i, f"Sales manager {i}", "text") for i in range(200)))
    run()
    first = {r["external_id"]: r for r in jobs.read(0).filter("source_id = 'a'").collect()}
    assert set(first) == {"1", "2"} and all(r["closed_at"] is None for r in first.values())
    payload(feed, "b.json", "a", (2, "Python developer", "changed"), (3, "Data engineer", "other"))
    run()
    second = {r["external_id"]: r for r in jobs.read(1).filter("source_id = 'a'").collect()}
    assert second["1"]["closed_at"] is not None and second["2"]["cluster_id"] == first["2"]["cluster_id"]
    assert second["3"]["cluster_id"] == first["1"]["cluster_id"]  # the exact key has no test of sources
    others = jobs.read(1).filter("source_id = 'z'")
    assert others.count() == 200 and others.filter("closed_at is not null").isEmpty()  # no source of the second batch
    # the second version shares the buckets of z with the first, and has written a's alone
    before, after = jobs.manifest(0), jobs.manifest(1)
    assert sum(before[b] != after[b] for b in before) == 1
    assert jobs.size(next(f for b, f in after.items() if before[b] != f)) < jobs.size(next(iter(before.values()))) / 2
    run()  # nothing new: no further version
    assert not jobs.has(2) and jobs.size() > 0


def test_versions_of_a_table(spark, tmp_path):
    jobs = bucket_table(spark, tmp_path, keep=2)
    rows = lambda source, *ids: spark.createDataFrame([(source, str(i), *[None] * 10) for i in ids], JOBS)
    read = lambda *v: sorted((r["source_id"], r["external_id"]) for r in jobs.read(*v).collect())
    assert read() == [] and jobs.versions() == []
    jobs.commit(0, rows("a", 1, 2).unionByName(rows("b", 3)), jobs.touched(rows("a", 1).unionByName(rows("b", 1))))
    only = jobs.touched(rows("a", 1))
    with pytest.raises(ValueError, match="does not replace"):  # files are written, but nothing is published
        jobs.commit(1, rows("b", 9), only)
    assert read() == [("a", "1"), ("a", "2"), ("b", "3")] and jobs.versions() == [0]
    jobs.commit(1, rows("a", 2), only)
    assert read() == [("a", "2"), ("b", "3")] and read(0) == [("a", "1"), ("a", "2"), ("b", "3")]
    with pytest.raises(RuntimeError, match="there already"):
        jobs.commit(1, rows("a", 5), only)
    jobs.commit(2, rows("a"), only)  # an empty bucket
    assert read() == [("b", "3")]
    jobs.vacuum()
    assert jobs.versions() == [1, 2] and read(1) == [("a", "2"), ("b", "3")]
    used = {f for v in (1, 2) for f in jobs.manifest(v).values()}
    assert {f"data/{n}" for n in jobs._names("data")} == used  # what died or is too old is gone


def test_step_keeps_what_the_hash_leaves_out(spark):
    old = spark.createDataFrame([("a", "1", "Old title", "t", "C", "c", "c|t", "h", "1", None, None, None)], JOBS)
    new = spark.createDataFrame([("a", "1", "New title", "t", "C", "c", "c|t", "h")], "source_id string, external_id string, title string, title_norm string, company_name string, company_norm string, dedup_key string, content_hash string")
    done = ingest.step(old, new, now(), complete=True)
    assert [r["title"] for r in done.jobs.collect()] == ["Old title"] and done.refresh.count() == 0


def test_feeds_skip_what_is_unusable(spark):
    body = json.dumps({"jobs": [{"id": "x", "title": "t", "absolute_url": "u"}, {"id": 5, "title": " ", "absolute_url": "u"}, {"id": 6, "title": "t", "absolute_url": "u", "extra": [1]}]})
    rows = spark.createDataFrame([("s", "c", "g", body), ("s", "c", "g", "not json"), ("s", "c", "g", None)], "source_id string, company string, slug string, body string")
    built = build(feeds.greenhouse(rows)).collect()
    assert sorted((r["external_id"] or "", *r["failed"]) for r in built) == [("", "external_id"), ("5", "title"), ("6",)]


def test_registry(spark):
    known = {r["kind"]: r for r in registry.adapters(spark).collect()}
    assert len(known) == 8 and known["jobicy"]["least_minutes"] == 360 and not known["france_travail"]["complete"]


def test_nothing_is_judged_twice_by_one_version_of_the_criteria(spark):
    one, two = Criteria(), Criteria(title_exclusions=("engineer",))
    assert one.stamp == Criteria().stamp != two.stamp
    jobs = derive.jobs(spark, "/root/testdata/sf0.001").withColumns({"forced_pass": F.lit(False), "cluster_id": F.col("external_id"), "criteria_stamp": F.lit(None).cast("string")})
    judged = lambda rows, criteria: rows.filter(ingest.stale(rows, criteria)).count()
    able = jobs.filter("closed_at is null and description <> ''").count()
    assert able == judged(jobs, one) > 0
    first, refresh = ingest.refilter(jobs, one)
    first = cut(first, "first")
    assert judged(first, one) == 0 and judged(first, two) == able and refresh.count() > 0
    again, refresh = ingest.refilter(first, one)
    assert refresh.count() == 0 and again.exceptAll(first).count() == 0
    changed = cut(ingest.refilter(first, two)[0], "changed")
    fresh = ingest.refilter(jobs.drop("criteria_stamp"), two)[0]
    assert changed.drop("criteria_stamp").exceptAll(fresh).count() == 0 and changed.count() == jobs.count()


def test_criteria_file(tmp_path):
    path = tmp_path / "criteria.json"
    path.write_text(json.dumps({"$comment": "x", "roleTitlePatterns": ["dev"], "requiredStack": ["spark"], "rejectRemoteScopes": ["other"]}))
    assert CriteriaFile(path).load().role_title == ("dev",)
    path.write_text(json.dumps({"roleTitlePatterns": [], "requiredStack": ["spark"]}))
    with pytest.raises(ValueError):
        CriteriaFile(path).load()
