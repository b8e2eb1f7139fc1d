"""Product codes of vectors, fitted by Lloyd rounds in which the members stay where they live.

A vector is cut into parts; each part position has a codebook. The parts are rows of a table with buckets by
(position, entry, salt), the owners: a group of parts with the same nearest entry lives in one bucket for each salt,
so a popular entry is spread over as many owners as there are salts.

1. owners add up the members that live with them, without a shuffle; the salts' sums meet in one row per entry, and
   the driver turns those rows into the next codebooks;
2. a round looks up every part's nearest entry where the part lives. Parts that keep their entry are written back to
   the same bucket by the task that has read them; only parts that change their entry cross the network to the new owner;
3. after the last round, whole vectors are coded where they are read, as codebooks are small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored, stored_in_buckets
from .vectors import integers, matrix, quoted

SCALE, PARTS, ENTRIES, ROUNDS, SALTS = 256, 16, 64, 2, 32
OWNER = ("position", "entry", "salt")
#: Parts that are compared with a codebook together.
TOGETHER = 8192


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, of equal ones the lowest, and its exact squared distance."""
    index, squared = [], []
    for first in range(0, len(parts), TOGETHER):
        far = np.zeros((len(parts[first : first + TOGETHER]), len(book)), np.int64)
        for axis in range(book.shape[1]):
            far += (parts[first : first + TOGETHER, axis, None] - book[None, :, axis]) ** 2
        index.append(far.argmin(1))
        squared.append(far.min(1))
    return np.concatenate([*index, np.zeros(0, np.int64)]), np.concatenate([*squared, np.zeros(0, np.int64)])


def _split(books):
    """(salt, x) -> a row per part with its nearest entry"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, _, width = books.value.shape
        names = [*OWNER, *(f"p{i}" for i in range(width))]
        for batch in batches:
            x = matrix(batch.column(1), positions * width)
            for position, book in enumerate(books.value):
                part = x[:, position * width : (position + 1) * width]
                entry, _ = nearest(part, book)
                own = [pa.array(np.full(len(x), position, np.int32)), pa.array(entry.astype(np.int32)), batch.column(0)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(part[:, i].astype(np.int32)) for i in range(width))], names=names)

    return run


def _looked_up(books):
    """Rows of the owners -> the same with the entry that is nearest now as ``next``"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = np.asarray(batch.column(0))
            part = np.stack([np.asarray(c) for c in batch.columns[3:]], 1).astype(np.int64)
            entry = np.zeros(len(part), np.int32)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                entry[at] = nearest(part[at], books.value[p])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry)], names=[*batch.schema.names, "next"])

    return run


def _coded(books):
    """(id, label, x) -> (id, label, code, error)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, _, width = books.value.shape
        for batch in batches:
            x = matrix(batch.column(2), positions * width)
            entries, error = np.zeros((len(x), positions), np.uint8), np.zeros(len(x), np.int64)
            for position, book in enumerate(books.value):
                entries[:, position], squared = nearest(x[:, position * width : (position + 1) * width], book)
                error += squared
            code = pa.array([row.tobytes().hex() for row in entries], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], code, pa.array(error)], names=["id", "label", "code", "error"])

    return run


def owners(rows: DataFrame, books, buckets: int, salts: int = SALTS) -> DataFrame:
    """The table of all parts of (id, x) with their entries, in buckets by owner: the one shuffle of all parts."""
    width = books.value.shape[2]
    schema = ", ".join([*(f"{c} int" for c in OWNER), *(f"p{i} int" for i in range(width))])
    salt = F.pmod(F.xxhash64("id", "x"), F.lit(salts)).cast("int").alias("salt")
    parts = rows.select(salt, "x").mapInArrow(_split(books), schema)
    return stored_in_buckets(parts.repartition(buckets, *OWNER), "code-parts", buckets, *OWNER)


def entry_sums(members: DataFrame, width: int) -> DataFrame:
    """One row per entry in use: ``n`` and the sums ``s0`` ... of its members; owners add up what lives with them."""
    sums = [F.sum(F.col(f"p{i}").cast("long")).alias(f"s{i}") for i in range(width)]
    own = members.groupBy(*OWNER).agg(F.count("*").alias("n"), *sums)
    return own.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))


def migrated(members: DataFrame, books, buckets: int) -> DataFrame:
    """The owners' table after a look-up: parts that keep their entry stay in their bucket, the others are shuffled."""
    columns = members.columns
    found = members.mapInArrow(_looked_up(books), ", ".join(f"{c} int" for c in [*columns, "next"]))
    stay = found.where("next = entry").select(*columns)
    move = found.where("next <> entry").select(*(F.col("next").alias(c) if c == "entry" else F.col(c) for c in columns))
    return stored_in_buckets(stay.unionByName(move.repartition(buckets, *OWNER)), "code-parts", buckets, *OWNER)


def next_books(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of the mean of its members; an unused one stays. A row per entry reaches the driver."""
    out = books.copy()
    for row in entry_sums(members, books.shape[2]).collect():
        out[row["position"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(books.shape[2])]
    return out


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """Per kept vector: id, ``code`` (two hexadecimal digits for each part), squared ``error``, ``label_error`` (over
    all vectors with its label) and ``codebooks_sha256``.

    Kept are vectors without null or non-finite components whose length is that of the smallest id with a length that
    ``parts`` divides; others can't be compared with them. Null ids are kept and come last among the first entries;
    rows that repeat an id come in the order of their vectors, and equal rows are rows of their own. Null labels are
    one label. With fewer vectors than ``entries`` a codebook has as many entries; equal entries leave all parts to
    the lower one. Other columns are ignored; an empty table gives an empty result. A component beyond
    ``LARGEST / scale`` stops the job. Broadcast are the codebooks alone: ``entries`` numbers for each component.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hexadecimal digits hold up to 256 entries")
    spark = vectors.sparkSession
    size = F.size(quoted(vector_col))
    whole = vectors.where((size > 0) & (size % parts == 0))
    rows = stored(integers(whole, vector_col, scale, quoted(id_col).alias("id"), quoted(label_col).alias("label")), "code-vectors")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    order = F.col("id").asc_nulls_last(), F.col("x")
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        empty = f"id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], empty).withColumnRenamed("id", id_col)
    width = len(first[0]["x"]) // parts
    rows = rows.where(F.size("x") == parts * width)
    seeds = np.array([r["x"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        if members is None:
            members = owners(rows, shared, buckets)
        else:
            old, members = members, migrated(members, shared, buckets)
            discard(old)
        books = next_books(members, books)
        shared.unpersist()
    if members is not None:
        discard(members)
    shared = spark.sparkContext.broadcast(books)
    found = rows.select("id", "label", "x").mapInArrow(_coded(shared), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    found = stored(found, "codes")
    # written, so that its size decides how it is joined
    per = stored(found.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "code-labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return found.join(per, F.col("label").eqNullSafe(F.col("own"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
