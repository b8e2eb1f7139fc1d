"""The stream with expiring state against the batch form."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from harrow.streaming import horizon

SCHEMA = "external_id long, dedup_key string, at timestamp"


def test_stream_equals_batch_and_state_expires(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows, day = [], 0
    for batch in range(4):  # the last comes long after the others
        for i in range(40):
            at = start + timedelta(days=day, seconds=rng.randrange(20 * 86400))
            rows.append((batch, batch * 100 + i, rng.choice(["a|x", "a|y", "b|z", f"c|{batch}-{i % 9}", None]), at))
        day += (25, 70, 200)[batch] if batch < 3 else 0
    df = spark.createDataFrame(rows, "batch int, " + SCHEMA)
    feed, found = f"{tmp_path}/feed", f"{tmp_path}/out"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", horizon.STORE)
    try:
        sizes = []
        for batch in range(4):
            df.filter(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").json(feed)
            stream = spark.readStream.schema(SCHEMA).json(feed)
            query = horizon.clustered(stream, late="60 days").writeStream.format("parquet").option("path", found)
            query.option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            sizes.append(horizon.state_rows(spark, f"{tmp_path}/check"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    expected = sorted(tuple(r) for r in horizon.in_batch(df).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(found).select("external_id", "dedup_key", "at", "cluster_id", "started").collect()) == expected
    keys = [len({k for b, _, k, _ in rows if b <= upto and k}) for upto in range(4)]
    assert sizes[0] == keys[0] and sizes[3] < keys[3] / 2  # keys of the first batches are gone
