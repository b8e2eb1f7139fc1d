"""Near-duplicates by SetSketch registers.

A document's set of word shingles is sketched by registers of exponentially spaced truncated minima: each
register holds ``floor(1 - log_b(x))``, cut to 0..q+1, of the smallest of the set's exponential variates.
Registers of a union are the maxima of the registers, and with b near 1 two registers agree about as often as
the sets' Jaccard similarity says. Steps:

1. documents with equal sets form a class with a number of its own; classes are what is compared;
2. a class is put into one bucket per band of registers; classes that share a bucket are candidates;
3. each bucket's class with the smallest id is its pivot and is compared with all others of the bucket: that is linear
   in the bucket's size, and joins the many variants of a large group without listing their pairs;
4. where a bucket still holds several components, members outside its largest one meet the others. A bucket with
   many such members, as where a long passage is shared, is first banded again by a finer sketch, as often as it
   takes: a pair that may be linked shares one of the new buckets. In each that is left, finer sketches are compared
   in blocks, and only pairs that may be linked leave it. So a class meets at most about ``WIDE * BLOCK`` such
   members in each of its buckets;
5. a comparison first estimates the similarity from both sketches jointly by maximum likelihood, and what is
   not clearly below the threshold is confirmed on the full sets;
6. components over the confirmed links; the second search adds to the components of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import seeds, shingle_sets
from .storage import stored

BASE = 1.001
RATE = 20.0
LARGEST = 2**16 - 2
#: Registers of a band, and the chance at most that a pair at the threshold shares no band.
ROWS = 8
MISS = 1e-6
#: Standard errors of the estimate below the threshold from which a pair is dropped unread.
ERRORS = 5.0
#: Shingles that are sketched together.
TOGETHER = 1 << 16
#: Registers of the finer sketch (their low bytes), and the rows of each side of a block.
FINE, BLOCK = 1024, 1024
#: A bucket with more blocks than this outside its largest component is banded again; below it, that would cost more.
WIDE = 4
#: How often; from then on buckets are cut into blocks of BLOCK rows of each side, all of which are compared.
LEVELS = 4


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """So many bands that a pair at the threshold is missed with a chance of ``miss`` at most."""
    return ceil(log(miss) / log(1 - (percent / 100) ** rows))


def registers(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` registers for each of the sets, none of which is empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    salt, factor = seeds(size, 5), seeds(size, 6) | np.uint64(1)
    least = np.empty((len(sets), size), np.uint64)
    for j in range(size):
        least[:, j] = np.minimum.reduceat((values ^ salt[j]) * factor[j], starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / log(BASE)), 0, LARGEST + 1).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows of a and b) of sets of known sizes.

    The numbers of registers in which a is above, below and equal to b have probabilities that depend on the
    similarity and the sizes; their likelihood is concave in the similarity, so a ternary search finds it.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return (
            above * np.log(np.maximum(more, tiny))
            + below * np.log(np.maximum(less, tiny))
            + equal * np.log(np.maximum(1 - more - less, tiny))
        )

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _packed(sets: list[np.ndarray], size: int) -> list[bytes | None]:
    """The registers of each set as bytes; an empty set has none."""
    full = [s for s in sets if len(s)]
    rows = iter(registers(full, size)) if full else iter(())
    return [next(rows).tobytes() if len(s) else None for s in sets]


def _sketch(words: int, size: int):
    """(id, h, text) -> (id, h, n, digest, registers)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sketches = [], [], []
            waiting: list[np.ndarray] = []
            held = 0
            for found in shingle_sets(batch.column(2), words):
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                waiting.append(found)
                held += len(found)
                if held > TOGETHER:
                    sketches += _packed(waiting, size)
                    waiting, held = [], 0
            sketches += _packed(waiting, size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                names=["id", "h", "n", "digest", "registers"],
            )

    return run


def _fine(words: int):
    """The low bytes of FINE registers of each text; equal registers have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: list[np.ndarray] = []
            first = held = 0

            def emit() -> pa.RecordBatch:
                low = (registers(waiting, FINE) & 0xFF).astype(np.uint8)
                rows = batch.column(0).slice(first, len(waiting))  # noqa: B023
                return pa.RecordBatch.from_arrays([rows, pa.array([x.tobytes() for x in low], pa.binary())], names=["rep", "fine"])

            for found in shingle_sets(batch.column(1), words):
                waiting.append(found)
                held += len(found)
                if held > TOGETHER:
                    yield emit()
                    first, waiting, held = first + len(waiting), [], 0
            if waiting:
                yield emit()

    return run


def _within_blocks(percent: int, bands: int):
    """Rows sorted by block -> the pairs of each block that may be linked.

    A pair is looked at in the first band that it shares.
    """
    least = percent / 100 - ERRORS * sqrt(percent / 100 * (1 - percent / 100) / FINE)

    def pairs(block: pa.RecordBatch) -> pa.RecordBatch:
        few, rest = (np.flatnonzero(block.column("side").to_numpy() == side) for side in (0, 1))
        keys = block.column("keys").flatten().to_numpy().reshape(-1, bands)
        fine = np.frombuffer(b"".join(block.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        n, component, order = (block.column(c).to_numpy() for c in ("n", "c", "o"))
        apart, pivot = (block.column(c).to_numpy(zero_copy_only=False) for c in ("apart", "is_pivot"))
        band = block.column("band")[0].as_py()
        of_rest, left, right = keys[rest], [], []
        for i in few if len(rest) else ():
            fit = 100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])
            # those of the smaller components meet from both sides; pivots have met everyone
            fit &= (component[rest] != component[i]) & (~apart[rest] | (order[rest] < order[i])) & ~(pivot[rest] | pivot[i])
            at = np.flatnonzero(fit)
            at = at[(of_rest[at] == keys[i]).argmax(1) == band]
            at = at[(fine[rest[at]] == fine[i]).sum(1) >= least * FINE]
            left += [i] * len(at)
            right += rest[at].tolist()
        rep = block.column("rep")
        return pa.RecordBatch.from_arrays([rep.take(pa.array(x, pa.int64())) for x in (left, right)], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if held and first < last and held[0].column("block")[0].as_py() != block[first]:
                    yield pairs(merged())
                    held = []
                if first < last:
                    held.append(batch.slice(first, last - first))
        if held:
            yield pairs(merged())

    return run


def _likely(least: float):
    """Keeps the pairs whose estimated similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (
                    np.array([np.frombuffer(x, "<u2") for x in batch.column(name).to_pylist()]) for name in ("ra", "rb")
                )
                na, nb = (batch.column(name).to_numpy().astype(np.float64) for name in ("na", "nb"))
                keep = pa.array(estimate(a, b, na, nb) >= least)
                yield batch.select(["u", "v"]).filter(keep)

    return run


def _confirmed(words: int, percent: int):
    """Keeps the pairs whose full sets are as similar as the threshold asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                left = shingle_sets(batch.column("ta"), words)
                known: dict[int, np.ndarray] = {}  # a pivot's rows follow each other
                keep = []
                texts, ids = batch.column("tb"), batch.column("v").to_pylist()
                for row, a in enumerate(left):
                    if ids[row] not in known:
                        known = {ids[row]: next(shingle_sets(texts.slice(row, 1), words))}
                    b = known[ids[row]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rebanded(large: DataFrame, fine: DataFrame, percent: int, miss: float, level: int) -> DataFrame:
    """The members of large buckets in smaller ones: a pair that may be linked shares one of these."""
    bands = min(bands_for(percent, ROWS, miss), FINE // ROWS)
    first = (level * FINE // LEVELS) % FINE  # another level starts at other registers
    part = lambda j: F.substring(F.col("turned"), j * ROWS + 1, F.lit(ROWS))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64("key", F.lit(level), j, part(j)))
    turned = F.concat(F.expr(f"substring(fine, {first + 1}, {FINE})"), F.expr(f"substring(fine, 1, {first})"))
    rows = large.join(fine.select("rep", turned.alias("turned")), "rep")
    return rows.select(F.explode(keys).alias("key"), "band", "rep", "is_pivot", "component")


def _open(placed: DataFrame) -> DataFrame:
    """Members of buckets with several components, with the bucket's size, its largest component and whether they are outside it."""
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("key").agg(
        F.max(F.struct("members", "component")).alias("top"), F.sum("members").alias("all"), F.count(F.lit(1)).alias("components")
    )
    main = main.filter("components > 1").select("key", F.col("top.component").alias("main"), "all", (F.col("all") - F.col("top.members")).alias("few"))
    return placed.join(main, "key").withColumn("apart", F.col("component") != F.col("main"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    miss: float = MISS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a set has the distinct shingles of ``words``
    words, or the whole sequence where there are fewer. Rows are linked if 100 * intersection >= percent
    * union; ``component_id`` is the smallest id that links reach. A pair exactly at the threshold goes
    unseen with a chance of about ``miss``, a closer one with less; copies are never missed. Null texts and
    texts without words have an empty set, link to nothing and are kept. A row with a null id links like others;
    a component without any id has a null ``component_id``, and its rows are kept. Rows that repeat an id are rows of
    their own, each with the links of its own text. A very long text is one row like others. Other columns
    are ignored; an empty table gives an empty result.
    """
    return _verdict(docs, id_col, text_col, words, percent, rows, miss, block).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept"
    )


def _verdict(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, rows: int, miss: float, block: int) -> DataFrame:
    """id, ``h`` (hash of the text), ``n``, ``component``, ``kept``."""
    bands = bands_for(percent, rows, miss)
    size = bands * rows
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    sketches = stored(
        texts.mapInArrow(_sketch(words, size), f"id {kind}, h long, n long, digest binary, registers binary"), "sketches"
    )
    # equal sets have equal registers, so these keys make one row per distinct set; ``at`` is a row with its text
    classes = sketches.filter("n > 0").groupBy("digest", "n", "registers").agg(F.min("id").alias("id"), F.min(F.struct("id", "h")).alias("at"))
    # the table is written, so the numbers are the same for every reader
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * rows) + 1, F.lit(2 * rows))),
    )
    # the pivot is the class with the smallest id, so a text from which others were made tends to be the pivot of all its
    # buckets, and each of the others meets one pivot instead of one for each bucket
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "rep")
    banded = classes.select(F.posexplode(keys).alias("band", "key"), "rep", "id")
    pivots = banded.groupBy("key").agg(F.min(rank)["rep"].alias("pivot"), F.count(F.lit(1)).alias("there")).filter("there > 1")
    shared = stored(banded.drop("id").join(pivots.select("key", "pivot"), "key"), "buckets")
    near = classes.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("at.id").alias("_id"), F.col("at.h").alias("_h"))
    same_row = texts["id"].eqNullSafe(near["_id"]) & texts["h"].eqNullSafe(near["_h"])
    near_texts = stored(texts.join(near, same_row).select("rep", "text").dropDuplicates(["rep"]), "texts")
    sketched = classes.select("rep", "n", "registers")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sketched.select(F.col("rep").alias("u"), F.col("n").alias("na"), F.col("registers").alias("ra"))
        b = sketched.select(F.col("rep").alias("v"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
        fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        least = percent / 100 - ERRORS * sqrt(percent / 100 * (1 - percent / 100) / size)
        both = pairs.join(a, "u").join(b, "v").filter(fit).select("u", "v", "na", "nb", "ra", "rb")
        likely = both.mapInArrow(_likely(least), "u long, v long")
        ta = near_texts.select(F.col("rep").alias("u"), F.col("text").alias("ta"))
        tb = near_texts.select(F.col("rep").alias("v"), F.col("text").alias("tb"))
        read = likely.join(ta, "u").join(tb, "v").select("u", "v", "ta", "tb")
        return read.mapInArrow(_confirmed(words, percent), "u long, v long")

    first = shared.filter("rep != pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct()
    groups = connected_components(confirmed(first)).select(F.col("node").alias("rep"), "component")
    placed = shared.join(groups, "rep", "left").select(
        "key", "band", "rep", (F.col("rep") == F.col("pivot")).alias("is_pivot"), F.coalesce("component", "rep").alias("component")
    )
    open_ = stored(_open(placed), "open")
    wanted = near_texts.join(open_.select("rep").distinct(), "rep", "left_semi").select("rep", "text")
    fine = wanted.mapInArrow(_fine(words), "rep long, fine binary").join(classes.select("rep", "n", keys.alias("keys")), "rep")
    fine = stored(fine, "fine")
    fits, small = F.col("few") <= WIDE * block, None
    for level in range(LEVELS):
        part = open_.filter(fits)
        small = part if small is None else small.unionByName(part)
        large = open_.filter(~fits)
        if large.isEmpty():
            break
        # a finer bucket that holds one component is settled
        open_ = stored(_open(_rebanded(large, fine, percent, miss, level)), "open")
    else:
        small = small.unionByName(open_)
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    small = small.withColumn("b_parts", parts("all")).withColumn("a_parts", parts("few"))
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cells = ["key", "band", "rep", "component", "apart", "is_pivot"]
    a = small.filter("apart").select(*cells, F.lit(0).alias("side"), spread(F.col("a_parts")).alias("i"), upto(F.col("b_parts")).alias("j"))
    b = small.select(*cells, F.lit(1).alias("side"), spread(F.col("b_parts")).alias("j"), upto(F.col("a_parts")).alias("i"))
    cut = a.unionByName(b).withColumn("block", F.xxhash64("key", "i", "j")).join(fine, "rep")
    cut = cut.select("block", "side", "band", "rep", "apart", "is_pivot", F.xxhash64("component").alias("c"), F.xxhash64("rep").alias("o"), "n", "keys", "fine")
    cut = cut.repartition("block").sortWithinPartitions("block")
    second = cut.mapInArrow(_within_blocks(percent, bands), "x long, y long")
    second = second.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    # the second search joins components of the first
    of = lambda name: groups.select(F.col("rep").alias(name), F.col("component").alias(f"{name}c"))
    more = confirmed(second).join(of("u"), "u", "left").join(of("v"), "v", "left")
    more = connected_components(more.select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v")))
    final = classes.select("digest", "rep", "id").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = more.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    final = final.join(more, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    final = stored(final.select("digest", "id", "component"), "final")
    named = stored(final.groupBy("component").agg(F.min("id").alias("least")), "named")
    labelled = final.join(named, "component").select("digest", "least")
    members = sketches.select("id", "h", "n", "digest").join(labelled, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    return members.select("id", "h", "n", component.alias("component"), (component.isNull() | F.col("id").eqNullSafe(component)).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    miss: float = MISS,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns and nothing else.

    A verdict holds for the rows with its id and text, so rows that are equal in both stay or go together.
    """
    verdict = _verdict(docs, id_col, text_col, words, percent, rows, miss, block)
    gone = verdict.filter("not kept").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    same = docs[id_col].eqNullSafe(gone["_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(gone["_h"])
    return docs.join(gone, same, "left_anti")
