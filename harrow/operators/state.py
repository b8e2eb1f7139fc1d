"""Snapshot in, snapshot out: Parquet has no row updates, so each step derives the next state as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    a = old.select(*key, F.struct(*[c for c in old.columns if c not in key]).alias("was"))
    b = new.select(*key, F.struct(*[c for c in new.columns if c not in key]).alias("now"))
    return a.join(b, key, "full_outer")


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Key, ``was``, ``now`` and ``change``: new, reopened, changed, unchanged or missing, by content hash."""
    change = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), "missing")
        .when(F.col("was.closed_at").isNotNull(), "reopened")
        .when(F.col("was.content_hash") != F.col("now.content_hash"), "changed")
        .otherwise("unchanged")
    )
    return _sides(old, new, key).withColumn("change", change)


def counters(classes: DataFrame, by: str) -> DataFrame:
    count = lambda *names: F.count_if(F.col("change").isin(*names))
    return classes.groupBy(by).agg(
        count("new", "changed", "unchanged", "reopened").alias("fetched"), count("new").alias("created"),
        count("changed", "reopened").alias("updated"), count("missing").alias("missing"),
    )


def close_missing(old: DataFrame, new: DataFrame, key: list[str], as_of: Column, complete: bool, days: int = 30) -> DataFrame:
    """Closes open rows that a complete listing lacks, or that no listing has had for ``days`` days."""
    seen = new.select(*key).distinct().withColumn("_seen", F.lit(True))
    unseen = F.col("_seen").isNull() & F.col("closed_at").isNull()
    if not complete:
        unseen = unseen & (F.col("last_seen") < as_of - F.make_dt_interval(F.lit(days)))
    rows = old.join(seen, key, "left").withColumn("closed_now", unseen)
    return rows.withColumn("closed_at", F.when(F.col("closed_now"), as_of).otherwise(F.col("closed_at"))).drop("_seen")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows over the old ones; ``inserted`` tells rows that had no old one."""
    names = [c for c in old.columns if c not in key]
    both = _sides(old, new, key)
    values = [F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in names]
    return both.select(*key, *values, F.col("was").isNull().alias("inserted"))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def accumulate(old: DataFrame, new: DataFrame, key: list[str], sums: list[str], order: str) -> DataFrame:
    """Of each key the row latest by ``order``, with ``sums`` added up over all."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in (*key, *sums)]
    latest = F.max(F.struct(order, *[c for c in rest if c != order])).alias("_last")
    out = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], latest)
    return out.select(*key, *sums, *[F.col(f"_last.{c}").alias(c) for c in rest])


def touch(rows: DataFrame, seen: DataFrame, key: list[str], as_of: Column) -> DataFrame:
    """Marks rows as seen now and open."""
    marks = seen.select(*key).distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(marks, key, "left")
    now = F.col("_seen").isNotNull()
    return rows.withColumns({"last_seen": F.when(now, as_of).otherwise(F.col("last_seen")), "closed_at": F.when(~now, F.col("closed_at"))}).drop("_seen")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the keys in ``gone``."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def set_null(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent is gone keep their row and lose the reference."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return children.join(marks, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def erase(rows: DataFrame, when: Column, columns: list[str]) -> DataFrame:
    """Sets identifying columns to null where the condition holds."""
    return rows.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})


def fill(rows: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Fills columns that are null from ``values`` and overwrites none."""
    names = [c for c in values.columns if c not in key]
    other = values.select(*key, *[F.col(c).alias(f"_{c}") for c in names])
    return rows.join(other, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])
