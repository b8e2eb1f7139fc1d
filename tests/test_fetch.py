"""The source of listings: windows, cursors, restarts and incomplete answers."""

import json

from pyspark.sql import functions as F

from harrow.sources import fetch


def answer(folder, source, name, items, complete=True):
    (folder / source).mkdir(parents=True, exist_ok=True)
    rows = [{"id": i, "created": t, "title": f"t{i}"} for i, t in items]
    (folder / source / f"{name}.json").write_text(json.dumps({"complete": complete, "items": rows}))


def test_batch(spark, tmp_path):
    fetch.register(spark)
    folder = tmp_path / "feed"
    read = lambda: spark.read.format("listings").load(f"file://{folder}")
    assert read().count() == 0
    answer(folder, "a", "1", [(1, "2024-01-01T10:00:00"), (2, "2024-01-03T10:00:00"), (1, "2024-01-02T10:00:00"), (None, "2024-01-01T00:00:00")])
    answer(folder, "b", "1", [(1, "2024-01-01T10:00:00")])
    (folder / "b" / "bad.json").write_text("not json")
    rows = read()
    assert rows.rdd.getNumPartitions() == 2  # one for each source
    assert sorted((r.source_id, r.external_id) for r in rows.collect()) == [("a", "1"), ("a", "1"), ("a", "2"), ("b", "1")]
    one = {(r.source_id, r.external_id): r.created.isoformat() for r in fetch.deduplicated(rows).select("source_id", "external_id", F.col("created").cast("timestamp_ntz")).collect()}
    assert one["a", "1"] == "2024-01-01T10:00:00" and len(one) == 3


def test_cursor_moves_by_complete_answers_only(tmp_path):
    folder = tmp_path / "feed"
    reader = fetch._StreamReader(fetch.FolderAdapter(f"file://{folder}"), fetch.BEGIN)
    start = reader.initialOffset()
    answer(folder, "a", "1", [(1, "2024-01-05T00:00:00")])
    answer(folder, "b", "1", [(1, "2024-01-05T00:00:00")], complete=False)
    one = reader.latestOffset()
    assert one["cursors"] == {"a": "2024-01-05T00:00:00"} and set(one["seen"]) == {"a", "b"}
    assert [(w.source_id, w.since) for w in reader.partitions(start, one)] == [("a", fetch.BEGIN), ("b", fetch.BEGIN)]
    answer(folder, "a", "2", [(2, "2024-01-06T00:00:00")])
    answer(folder, "b", "2", [(2, "2024-01-06T00:00:00")])
    two = reader.latestOffset()
    windows = {w.source_id: w for w in reader.partitions(one, two)}
    assert windows["a"].since == "2024-01-04T00:00:00"  # a day before the cursor
    assert windows["b"].since == fetch.BEGIN  # its cursor has not moved


def test_stream_restarts_from_its_offsets(spark, tmp_path):
    fetch.register(spark)
    folder, out = tmp_path / "feed", f"{tmp_path}/out"

    def run():
        stream = fetch.deduplicated(spark.readStream.format("listings").load(f"file://{folder}"))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    answer(folder, "a", "1", [(i, f"2024-01-05T0{i}:00:00") for i in range(5)])
    assert run() == 5
    assert run() == 0  # nothing new, nothing read
    answer(folder, "a", "2", [(4, "2024-01-05T04:00:00"), (5, "2024-01-05T12:00:00")])
    assert run() > 1  # the overlap is fetched again
    got = sorted((r.source_id, r.external_id) for r in spark.read.parquet(out).collect())
    assert got == [("a", str(i)) for i in range(6)]  # and nothing comes out twice
