"""Similarity joins of short texts by their trigrams.

The texts of a block are dealt into parts, and a task compares one part with another: it counts the grams that each two
texts have in common, frequent grams by a product of matrices and the others by their lists of texts, and hands on only
pairs that are similar enough, or the best few of each text. So no candidate pairs are shuffled or written, a group
holds two parts whatever the block's size, and what is shuffled is each text once for each part of the other side.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.functions import keys

from .snapshot import cut

#: Texts of a part, about; pairs that share a gram beyond which a matrix counts it; its columns at once; rows judged at once.
PART, DENSE, COLUMNS, ROWS = 4096, 200_000, 1024, 512


def gram_codes(text: Column) -> Column:
    """The distinct trigrams of a text as numbers: the three bytes of each."""
    return F.transform(keys.grams(text), lambda g: F.conv(F.hex(g), 16, 10).cast("int"))


def _lists(table: pa.Table, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the grams ``common`` the rows that have it: where its rows start, and the rows."""
    g = table["g"].combine_chunks()
    flat, rows = g.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(g)), g.value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
    hit = common[at] == flat
    at, rows = at[hit], rows[hit]
    order = np.argsort(at, kind="stable")
    return np.searchsorted(at[order], np.arange(len(common) + 1)), rows[order]


def _shared(left: pa.Table, right: pa.Table) -> np.ndarray:
    """How many grams each text of ``left`` has in common with each of ``right``."""
    both = np.zeros((left.num_rows, right.num_rows), np.float32)
    common = np.intersect1d(*(t["g"].combine_chunks().flatten().to_numpy(zero_copy_only=False) for t in (left, right)))
    if not len(common):
        return both
    (a, a_rows), (b, b_rows) = _lists(left, common), _lists(right, common)
    frequent = np.diff(a) * np.diff(b) > DENSE
    for k in np.nonzero(~frequent)[0]:
        both[np.ix_(a_rows[a[k] : a[k + 1]], b_rows[b[k] : b[k + 1]])] += 1
    dense = np.nonzero(frequent)[0]
    for first in range(0, len(dense), COLUMNS):
        some = dense[first : first + COLUMNS]
        x, y = (np.zeros((n, len(some)), np.float32) for n in both.shape)
        for c, k in enumerate(some):
            x[a_rows[a[k] : a[k + 1]], c] = 1
            y[b_rows[b[k] : b[k + 1]], c] = 1
        both += x @ y.T
    return both


def _compared(key: tuple, left: pa.Table, right: pa.Table, least: float, most: int | None, own: bool) -> pa.Table:
    """(a, b, sim) of the pairs of two parts that are similar enough, or of each a the ``most`` best: ties go to the smaller b."""
    left, right = left.sort_by("id"), right.sort_by("id")
    a, b = (t["id"].to_numpy() for t in (left, right))
    found = [(a[:0], b[:0], np.zeros(0))]
    if len(a) and len(b):
        shared = _shared(left, right)
        n_a, n_b = (pa.compute.list_value_length(t["g"]).to_numpy().astype(np.float64) for t in (left, right))
        for start in range(0, len(a), ROWS):
            both = shared[start : start + ROWS].astype(np.float64)
            either = n_a[start : start + ROWS, None] + n_b - both
            sim = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
            keep = sim >= least
            if own and key[1].as_py() == key[2].as_py():
                keep &= a[start : start + ROWS, None] < b
            if most is not None and len(b) > most:
                keep &= sim >= np.partition(sim, len(b) - most, axis=1)[:, len(b) - most, None]
            i, j = np.nonzero(keep)
            if most is not None:
                order = np.lexsort((j, -sim[i, j], i))
                i, j = i[order], j[order]
                few = np.arange(len(i)) - np.searchsorted(i, i) < most
                i, j = i[few], j[few]
            found.append((a[start + i], b[j], sim[i, j]))
    return pa.table([pa.array(np.concatenate(column)) for column in zip(*found, strict=True)], names=["a", "b", "sim"])


def _pairs(a: DataFrame, b: DataFrame, block: str, least: float, most: int | None = None, own: bool = False) -> DataFrame:
    """(``a``, ``b``, ``sim``) of the ids of texts (block, id, g) of one block; ``own``: both sides are one, and each pair is there once."""
    parts = lambda rows, name: rows.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias(name))
    sizes = cut(parts(a, "of_a").join(parts(b, "of_b"), block), "parts")
    dealt = lambda rows, of: rows.join(sizes, block).withColumn("part", F.pmod(F.xxhash64("id"), F.col(of)))
    zero, part = F.lit(0).cast("long"), F.col("part")
    left = dealt(a, "of_a").select(block, part.alias("p"), F.explode(F.sequence(part if own else zero, F.col("of_b") - 1)).alias("q"), "id", "g")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of its own, as both sides may be one
    right = dealt(b, "of_b").select(block, F.explode(F.sequence(zero, part if own else F.col("of_a") - 1)).alias("p"), part.alias("q"), "id", "g")
    by = partial(_compared, least=least, most=most, own=own)

    def compared(key, one: pa.Table, other: pa.Table) -> pa.Table:
        return by(key, one, other)

    return left.groupBy(block, "p", "q").cogroup(right.groupBy(block, "p", "q")).applyInArrow(compared, "a long, b long, sim double")


def similar_pairs(probes: DataFrame, targets: DataFrame | None, block: str, text: str, least: float) -> DataFrame:
    """Pairs (block, ``a`` of ``probes``, ``b`` of ``targets``, ``sim``) of distinct texts of one block, equal ones included.

    Without ``targets``: pairs a < b of the probes' texts. Texts without grams are similar to nothing. A null block is no
    block.
    """

    def texts(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col(block).isNotNull() & F.col(text).isNotNull()).select(block, text).distinct()
        return cut(rows.withColumn("g", gram_codes(F.col(text))).filter(F.size("g") > 0).withColumn("id", F.monotonically_increasing_id()), "texts")

    own = targets is None
    a = texts(probes)
    b = a if own else texts(targets)
    pairs = _pairs(a.select(block, "id", "g"), b.select(block, "id", "g"), block, least, own=own)
    pairs = pairs.join(a.select(F.col("id").alias("a"), F.col(text).alias("a_text")), "a").join(b.select(F.col("id").alias("b"), block, F.col(text).alias("b_text")), "b")
    if own:
        return pairs.select(block, F.least("a_text", "b_text").alias("a"), F.greatest("a_text", "b_text").alias("b"), "sim")
    return pairs.select(block, F.col("a_text").alias("a"), F.col("b_text").alias("b"), "sim")


def nearest(probes: DataFrame, targets: DataFrame, block: str, text: str, number: str, most: int) -> DataFrame:
    """(block, text of ``probes``, ``to``, ``sim``): the ``most`` targets most similar to each text of their block, down to 0.

    Of a target text ``to`` is its smallest ``number`` there; no two have the same. Of equally similar ones the smaller comes first.
    """
    a = cut(probes.select(block, text).distinct().withColumns({"g": gram_codes(F.col(text)), "id": F.monotonically_increasing_id()}), "probes")
    b = cut(targets.groupBy(block, text).agg(F.min(number).alias("id")).withColumn("g", gram_codes(F.col(text))), "targets")
    pairs = _pairs(a.select(block, "id", "g"), b.select(block, "id", "g"), block, 0.0, most)
    found = top(pairs, most).drop("n")
    return found.join(a.select(F.col("id").alias("a"), block, text), "a").select(block, text, F.col("b").alias("to"), "sim")


def top(pairs: DataFrame, most: int, by: str = "a") -> DataFrame:
    """The ``most`` most similar b of each a, with their places as ``n``."""
    order = Window.partitionBy(by).orderBy(F.col("sim").desc(), "b")
    return pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
