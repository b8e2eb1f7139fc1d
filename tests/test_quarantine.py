"""Nothing that was fetched vanishes."""

import json

from harrow.sources import quarantine


def test_rejected_items_and_unreadable_bodies(spark):
    good = {"id": 1, "title": "Data engineer", "absolute_url": "https://x.example/1", "content": "text"}
    bodies = [
        json.dumps({"jobs": [good, {**good, "id": None}, {**good, "id": 3, "title": " ", "absolute_url": ""}]}),
        json.dumps({"jobs": []}),
        json.dumps({"error": "gone"}),
        "<html>not json</html>",
        "",
        None,
    ]
    payloads = spark.createDataFrame([("s" if i < 5 else "other", "c", "g", b) for i, b in enumerate(bodies)], "source_id string, company string, slug string, body string")
    found = quarantine.listing(payloads, "greenhouse")
    assert [r.external_id for r in found.postings.collect()] == ["1"] and found.seen == {"items": 3, "rejected": 2}
    rows = [(r.source_id, r.what, r.reason) for r in found.rejected.collect()]
    assert sorted(rows) == [("other", "body", "unreadable"), *[("s", "body", "unreadable")] * 3, ("s", "item", "external_id"), ("s", "item", "url,title")]
    kept = [json.loads(r.raw)["external_id"] for r in found.rejected.filter("reason = 'url,title'").collect()]
    assert kept == ["3"]
    counts = {r.source_id: tuple(r)[1:] for r in quarantine.counts(found).collect()}
    assert counts == {"s": (3, 1, 2, 3), "other": (0, 0, 0, 1)}


def test_every_vendor_says_what_it_can_read(spark):
    empty = {"lever": "[]", "teamtailor": "<rss><channel></channel></rss>"}
    for kind in quarantine.ADAPTERS:
        field = quarantine.SHAPES.get(kind, (None, None))[1]
        body = empty.get(kind) or json.dumps({field: []})
        rows = spark.createDataFrame([(body,), ("nothing",)], "body string")
        assert [r[0] for r in rows.select(quarantine.readable(kind, rows["body"])).collect()] == [True, False], kind
