"""Exact dedup by skew-safe combining.

Rows with equal normalised text form a group. Three combining steps find the row of each group that stays:

1. *local*: Spark's map-side partial aggregation leaves one row per text and input partition;
2. *salted*: those rows meet by (digest, text, salt), so even a group that holds a third of all rows is
   spread over ``salts`` tasks;
3. *global*: at most ``salts`` winners per text meet by (digest, text).

The whole text is part of the grouping key at these steps: the digest only spreads and sorts the rows. Each
document then looks its group up by the digests, in a join that adaptive execution can split where a digest is hot.
That the digests stand for one text each is not assumed: the texts that share them are counted, and a second one
stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import quoted

#: Deleted before comparing: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _marks(id_col: Column, text_col: Column) -> list[Column]:
    """The normalised text and what orders the rows of a group: the longest first, then the smallest id, null last."""
    rank = F.struct((-F.length(F.coalesce(text_col, F.lit("")))).alias("length"), id_col.isNull().alias("none"), id_col.alias("id"))
    return [normalised(text_col).alias("text"), rank.alias("rank")]


def _digests() -> list[Column]:
    return [F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("second")]


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """``digest``, ``second``, ``rank`` of the row that stays and ``group_size`` of each group of ``text``."""
    # the salt depends on the input partition, so what step 1 has merged is not taken apart again
    salted = rows.groupBy("digest", "text", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = salted.agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "text").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))
    texts = groups.groupBy("digest", F.xxhash64("text").alias("second"))
    texts = texts.agg(F.min("rank").alias("rank"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    two = F.raise_error(F.lit("two texts have equal digests"))
    return texts.select("digest", "second", "rank", F.when(F.col("texts") > 1, two.cast("long")).otherwise(F.col("group_size")).alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The row with the most code points in its original text stays, then the one with the smallest id.
    Null and white-space-only texts are empty texts and equal each other. A null id loses every tie and is
    never the kept id of a group where a row as long has another id. Rows that repeat an id and text count in
    ``group_size``, and have the same verdict. Ids may be of any type with an order. A very long text is one row like
    others. Other columns of the input are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), *_marks(F.col(id_col), F.col(text_col))).select("*", *_digests())
    groups = _groups(rows, salts).select("digest", "second", F.col("rank.id").alias("keep_id"), "group_size")
    return (
        rows.select("id", "digest", "second")
        .join(groups, ["digest", "second"])
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row of each group, with all its columns and nothing else.

    It is the row that ``exact_duplicates`` keeps; of several rows with its id, length and normalised text, any one.
    """
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), *_marks(F.col(id_col), F.col(text_col))).select("*", *_digests())
    # a string of the rank, so that null ids are equal
    mark = lambda rank: F.concat_ws(":", f"{rank}.length", f"{rank}.none", F.coalesce(F.col(f"{rank}.id").cast("string"), F.lit("")))
    key = ["digest", "second", "mark"]
    best = _groups(rows.drop("row"), salts).withColumn("mark", mark("rank")).filter("group_size > 0").select(*key)
    # few rows have the mark of their group's best, so a hot group is spread by it
    found = rows.select("row", "digest", "second", mark("rank").alias("mark")).join(best, key)
    # merged in each task first, so rows that are equal in id and text do not meet in one task
    return found.groupBy(*key).agg(F.first("row").alias("row")).select("row.*")
