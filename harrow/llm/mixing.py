"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target of words. Its documents are taken whole for as many complete epochs as the target
holds; the rest of the target is filled by weighted sampling without replacement: each document draws the
key ``-ln(u) / weight`` (u is a hash of its id, so reruns agree), documents are sorted by key within their
source and prefix sums of their sizes are cut at the budget.

A source may hold a third of all rows, so no task sorts a source. Keys fall into about sqrt(n) ranges; sums
per (source, range) show in which range the budget ends; only that range is sorted.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored
from .vectors import quoted

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating.
CYCLE = (5, 2, 1)
#: No target is above so many times its source's size.
MOST = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.75 to 1: the larger the share of letters among the code points, the likelier a document is sampled."""
    whole = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(whole, r"[^\p{L}]+", ""))
    return F.lit(0.75) + F.lit(0.25) * letters / F.greatest(F.length(whole), F.lit(1))


def uniform(id_col: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of a digest of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST, share: float = 1.0) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``.

    Sources weigh ``cycle`` in code-point order, null last. ``share`` of all sizes is given out in proportion;
    what exceeds ``most`` times a source's size is given to the others by weight until none is above. This is
    water filling: target = least(most * size, level * weight), with the level from one pass in the order in
    which sources reach their cap.
    """
    whole = Window.partitionBy(F.lit(0))
    weights = F.array(*[F.lit(w) for w in cycle])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(weights, F.pmod(F.col("rank") - 1, F.lit(len(cycle))).cast("int") + 1))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = whole.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / F.sum("weight").over(after),
    )
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    cycle: tuple[int, ...] = CYCLE,
    most: int = MOST,
    weight: Column | None = None,
) -> DataFrame:
    """One row per document: id, source, ``size``, ``source_size``, ``target``, ``epochs``, ``sampled``, ``taken``.

    ``taken`` = size * (complete epochs + 1 if the fractional sample has the document). The document on the
    budget's edge is taken if that brings the source nearer to its target, so a source misses its target by
    half a document at most. Null texts and texts without words have size 0 and are never sampled; a null source is a
    source of its own and comes last; a source without words has target 0. Repeated rows count each. Ties of keys
    (equal ids) are settled by size. A very long text is one row like others. An empty table gives an empty result;
    other columns are ignored.
    """
    drawn = _drawn(docs, F.struct(F.col(id_col).alias("id")), id_col, text_col, source_col, seed, cycle, most, weight)
    taken = F.col("size") * (F.col("epochs") + F.col("sampled").cast("long"))
    plan = ["size", "source_size", "target", "epochs", "sampled"]
    return drawn.select(F.col("carried.id").alias(id_col), F.col("source").alias(source_col), *plan, taken.alias("taken"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    cycle: tuple[int, ...] = CYCLE,
    most: int = MOST,
    weight: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` repeated as often as ``mix`` takes them, ``most`` times at most; rows that it does not take go.

    Each row has its own verdict, whatever its id. A document without words is repeated in complete epochs only.
    """
    drawn = _drawn(docs, F.struct(*map(quoted, docs.columns)), id_col, text_col, source_col, seed, cycle, most, weight)
    times = (F.col("epochs") + F.col("sampled").cast("long")).cast("int")
    repeated = drawn.filter(times > 0).select("carried", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select("carried.*")


def _drawn(
    docs: DataFrame, carried: Column, id_col: str, text_col: str, source_col: str, seed: str, cycle: tuple[int, ...], most: int, weight: Column | None
) -> DataFrame:
    """``carried`` of each document with what ``mix`` decides."""
    weight = quality_weight(F.col(text_col)) if weight is None else weight
    rows = stored(
        docs.select(
            carried.alias("carried"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            (-F.log(uniform(F.col(id_col), seed)) / weight).alias("key"),
        ),
        "mix",
    )
    buckets = 2 * isqrt(rows.count()) + 1
    # 1 - exp(-key) is monotone in the key and near uniform for weights near 1
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets))
    slim = rows.drop("carried")
    targets = source_targets(slim, cycle, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
    plan = targets.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = (
        _null_safe(sums, plan, "source")
        .filter(F.col("before") + F.col("words") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "before")).alias("edge"))
        .select("source", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))
    )
    # written, so that its size is known: Spark broadcasts it below its limit and can split a hot source beyond it
    plan = stored(_null_safe(plan, edge, "source", "left"), "plan")
    rows = _null_safe(rows, plan, "source")
    whole = (F.col("edge").isNull() & (F.col("rest") > 0)) | F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))
    clear = rows.filter(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("sampled", whole & (F.col("size") > 0))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    near = (end + F.col("size") / 2 <= F.col("rest")) & (F.col("size") > 0)
    on_edge = rows.filter(F.col("bucket") == F.col("edge")).withColumn("sampled", near)
    return clear.unionByName(on_edge)


def _null_safe(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets the null key; Spark broadcasts a side only below its size limit."""
    other = right.withColumnRenamed(key, "_other")
    return left.join(other, left[key].eqNullSafe(other["_other"]), how).drop("_other")
