"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``limit`` tokens. A piece's length is all that packing needs, so the plan
is made on the histogram of lengths: ``limit`` counts, whatever the corpus holds. The plan says how many
sequences have which lengths; the pieces of each length are numbered in a distributed way and each looks up
the sequence and offset that the plan has for its number.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored
from .tokenizers_io import byte_bpe, vocabulary_path

LIMIT = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"

_PIECES = "id {id}, piece int, start long, length int, ids_crc32 long"


def cut(n_ids: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: ``limit`` tokens each, but the first may be shorter."""
    first = (n_ids - 1) % limit + 1
    return [(0, first), *((start, limit) for start in range(first, n_ids, limit))]


def _pieces(limit: int, end_id: int, vocabulary: str):
    """Arrow batches of (id, text) -> arrow batches of pieces."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary_path(vocabulary))
        for batch in batches:
            rows, piece, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for number, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                    rows.append(row)
                    piece.append(number)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int32()),
                    pa.array(sums, pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Rows of id, ``piece``, ``start``, ``length``, ``ids_crc32``; a null text is empty and has the end id only."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(limit, end_id, vocabulary), _PIECES.format(id=rows.schema["id"].dataType.simpleString()))


class _Complements:
    """Lengths that are left, by count, and the one, two or three of them that fill a gap exactly."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.counts = np.zeros(limit + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] = n

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """The pair with the largest length, which must not be above ``most``."""
        top = min(gap - 1, most if most is not None else gap - 1)
        large = np.arange(top, (gap - 1) // 2, -1)
        if not len(large):
            return None
        small = gap - large
        fits = (self.counts[large] > 0) & (self.counts[small] > (large == small))
        at = int(fits.argmax())
        return (int(large[at]), int(small[at])) if fits[at] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for large in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.counts[large]:
                self.counts[large] -= 1
                rest = self.pair(gap - large, large)
                self.counts[large] += 1
                if rest:
                    return (large, *rest)
        return None

    def exact(self, gap: int, most: int) -> tuple[int, ...] | None:
        """The first of up to ``most`` lengths that fill the gap."""
        return next(filter(None, (fill(gap) for fill in (self.single, self.pair, self.triple)[:most])), None)

    def most(self, pattern: tuple[int, ...]) -> int:
        return min(int(self.counts[length]) // n for length, n in Counter(pattern).items())

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for length in pattern:
            self.counts[length] -= times


def plan_sequences(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using every length as often as ``counts`` has it.

    From the longest length down, gaps are filled exactly by one, two or three available lengths, as often
    as the counts allow. Each step uses up some length, so there are at most ``limit`` such patterns. What
    no combination completes is packed best fit, longest first. Where long pieces abound, large combinations use
    up the short lengths that other gaps need, so plans with smaller ones are made too and the shortest is taken.
    """
    plans = [_plan_with(counts, limit, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan_with(counts: dict[int, int], limit: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan that fills gaps with up to ``most`` lengths."""
    left, plan = _Complements(counts, limit), []
    residual: dict[int, int] = {}
    for length in range(limit, 0, -1):
        while left.counts[length]:
            left.counts[length] -= 1
            rest = () if length == limit else left.exact(limit - length, most)
            left.counts[length] += 1
            if rest is None:
                residual[length] = int(left.counts[length])
                left.counts[length] = 0
                break
            pattern = (length, *rest)
            times = left.most(pattern)
            left.take(pattern, times)
            plan.append((pattern, times))
    return plan + _best_fit(residual, limit)


def _best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal sequences are held as one pattern with a number."""
    open_by_gap: dict[int, Counter] = {limit: Counter()}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g, patterns in open_by_gap.items() if g >= length and patterns), default=None)
            if gap is None:
                each = min(limit // length, left)
                times = left // each
                open_by_gap.setdefault(limit - each * length, Counter())[(length,) * each] += times
                left -= times * each
                continue
            pattern, there = next(iter(open_by_gap[gap].items()))
            times = min(there, left)
            open_by_gap[gap][pattern] -= times
            open_by_gap[gap] += Counter()  # without patterns that are used up
            open_by_gap.setdefault(gap - length, Counter())[(*pattern, length)] += times
            left -= times
    return [(pattern, n) for patterns in open_by_gap.values() for pattern, n in patterns.items() if n]


def placements(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(length, first number, last number, first sequence, offsets): where the pieces of a length go."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        offsets: dict[int, list[int]] = {}
        place = 0
        for length in pattern:
            offsets.setdefault(length, []).append(place)
            place += length
        for length, at in offsets.items():
            rows.append((length, used[length], used[length] + times * len(at) - 1, sequence, at))
            used[length] += times * len(at)
        sequence += times
    return rows


def numbered(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``number``: 0, 1, ... within each length.

    One length may have a third of all pieces, so they are dealt into about sqrt(n) parts; a part's first
    number is the sum of the counts of the parts before it.
    """
    parts = isqrt(total) // 4 + 1
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    firsts = firsts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    dealt = dealt.withColumn("inside", F.row_number().over(inside) - 1)
    return dealt.join(firsts, ["length", "part"]).withColumn("number", F.col("first") + F.col("inside")).drop("part", "inside", "first")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null and empty texts are one piece that holds the end id. Repeated rows are packed each. Null ids are
    ids like others. A very long text is cut into pieces, all of which are packed; pieces of one length are alike, so ties
    between them are settled by their order in the table of pieces. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, id_col, text_col, limit, end_id, vocabulary), "pieces")
    # at most `limit` rows reach the driver
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "length int, lo long, hi long, first_sequence long, offsets array<int>"
    runs = spark.createDataFrame(placements(plan_sequences(counts, limit)), schema)
    rows = numbered(pieces, sum(counts.values())).alias("p")
    # the plan's size is bounded by `limit` and not by the corpus, so it can be broadcast
    at = F.col("p.number") - F.col("lo")
    slots = F.size("offsets")
    return rows.join(
        F.broadcast(runs.alias("r")),
        (F.col("p.length") == F.col("r.length")) & F.col("p.number").between(F.col("lo"), F.col("hi")),
    ).select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        F.col("p.length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("first_sequence") + F.floor(at / slots)).alias("sequence_id"),
        F.element_at("offsets", (at % slots).cast("int") + 1).cast("long").alias("offset"),
    )
