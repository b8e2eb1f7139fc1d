"""Contacts whose ids meet: the typed-in ones have numbers that others may have too."""

from pyspark.sql import functions as F

from harrow.operators import actions


def test_marks_do_not_multiply_contacts(spark):
    rows = spark.createDataFrame([(1, "a@x"), (1, "b@x"), (2, "c@x"), (3, "d@x")], "contact_id long, email string")
    rows = rows.withColumn("opted_out_at", F.lit(None).cast("timestamp"))
    wanted = rows.filter("contact_id < 3").select("contact_id")
    got = actions.mark_contacts(rows, wanted, "opted_out_at", F.to_timestamp(F.lit("2024-05-01")))
    assert sorted((r.email, r.opted_out_at is not None) for r in got.collect()) == [("a@x", True), ("b@x", True), ("c@x", True), ("d@x", False)]
