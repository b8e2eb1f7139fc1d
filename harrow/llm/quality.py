"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Text is a sequence of characters; the model is over character n-grams of order 5. Counts are tables of (gram, count)
sharded by gram, and all of the model (discounts, continuation counts, context sums, interpolated probabilities) is
joins and groupings of them.

Scoring packs documents into blocks, which are shuffled once. Each block asks for its distinct contexts; these meet the
sharded model in one join, and what the join finds goes back to the block. So the rows of the join grow with the
corpus, no task and no broadcast holds the model, and a block's answer is about as large as the block's grams. A document is
rejected where its bits per character are, beyond doubt from its length, above a limit that quantiles of held-out
trusted documents in its language give. There is no lower limit: the documents that the model was fitted on, and their
copies, have fewer bits than others because of that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import chunks, text_buffer
from .storage import stored

#: A gram is a 55-bit number: ORDER symbols of BITS bits. Characters below FIRST are symbols of their own, which covers
#: Latin and Greek; those above share FIRST symbols by their code, so no two letters of one Cyrillic, Arabic or Hebrew
#: block fall together.
ORDER, BITS = 5, 11
SYMBOLS = 1 << BITS
FIRST = SYMBOLS // 2
#: One in so many trusted rows is held out to set the thresholds.
HELD_OUT = 4
#: Held-out rows below which a language takes the distances of its limits from its median from all languages.
OWN_SPREAD = 50
#: Bytes of text scored together.
BLOCK = 16 << 20
#: Bytes of text whose grams a worker holds at once (a character takes about a hundred bytes there), or one longer text;
#: and grams of several runs that are held before equal ones are put together.
RUN, MERGE = 256 << 10, 1 << 19
#: A document may be so many times as far from its language's median as the outer quantile is.
OUTER, REACH = 0.98, 2.0
#: Standard errors that a document's mean must be beyond the threshold.
DOUBT = 2.0

_TAG = 56  # keys: tag << 56 | gram or context
_WEIGHT = 8  # tag of a gram or context: its order; of a context's weight: 8 + order
_START = ord("\n")


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts (about RUN bytes each): the first row, the gram that ends at each character, the texts' bounds.

    A text starts after ORDER - 1 line ends; null counts as empty.
    """
    data, at = text_buffer(column)
    for first, last in chunks(at, RUN):
        part = data[at[first] : at[last]]
        characters = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = np.where(characters < FIRST, characters, FIRST + characters % FIRST)
        upto = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        ends = upto[at[first : last + 1] - at[first]]
        out, starts = symbols.copy(), ends[:-1]
        for back in range(1, ORDER):
            before = np.full(len(symbols), _START, np.int64)
            before[back:] = symbols[:-back] if back < len(symbols) else symbols[:0]
            for offset in range(back):  # the first characters of a text do not see the text before
                before[(starts + offset)[starts + offset < ends[1:]]] = _START
            out |= before << (BITS * back)
        yield first, out, ends


def _low(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def _tallies(columns: Iterator[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams, rising, and their numbers; of all texts, or of as many as have MERGE distinct ones in their runs."""
    found, times, waiting = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, place = np.unique(np.concatenate(found), return_inverse=True)
        return codes, np.bincount(place, np.concatenate(times)).astype(np.int64)

    for column in columns:
        for _, codes, _ in grams(column):
            one, n = np.unique(codes, return_counts=True)
            found.append(one)
            times.append(n)
            waiting += len(one)
            if waiting >= MERGE:
                yield merged()
                found, times, waiting = [], [], 0
    if found:
        yield merged()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts -> (code, n) for runs of texts."""
    for codes, n in _tallies(batch.column(0) for batch in batches):
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])


def kneser_ney(texts: DataFrame) -> DataFrame:
    """The model of a one-column table of texts, one row per context: ``key``, ``weight``, ``symbols``, ``ps``.

    Key ``order << 56 | context`` stands for a context of order - 1 symbols. ``ps`` are the interpolated probabilities of
    the ``symbols`` that follow it (SYMBOLS at most), and ``weight`` is what it gives to the next lower order.
    """
    top = texts.mapInArrow(_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    level = stored(top, "counts")
    levels = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols before a gram
        level = level.groupBy(_low(F.col("code"), order).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        levels[order] = level
    every = None
    for order, level in levels.items():
        part = level.select(F.lit(order).alias("order"), "code", "n")
        every = part if every is None else every.unionByName(part)
    every = stored(every, "orders")
    # four numbers for each order reach the driver
    of = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    seen = {r["order"]: (r["n1"], r["n2"], r["n3"], r["n4"]) for r in every.groupBy("order").agg(*of).collect()}
    lower, parts = None, []
    for order in range(1, ORDER + 1):
        cut = discounts(*seen.get(order, (0, 0, 0, 0)))
        discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        here = every.filter(F.col("order") == order).select("code", "n", F.shiftright("code", BITS).alias("context"))
        sums = here.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("cut"))
        rows = here.join(sums, "context")
        own = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        weight = F.col("cut") / F.col("total")
        if lower is None:
            rows = rows.select("code", (own + weight / SYMBOLS).alias("p"), weight.alias("weight"))
        else:
            below = lower.select(F.col("code").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", _low(F.col("code"), order - 1)).join(below, "suffix")
            rows = rows.select("code", (own + weight * F.col("below")).alias("p"), weight.alias("weight"))
        lower = stored(rows, f"order-{order}")
        follower = F.struct(F.col("code").bitwiseAND(F.lit(SYMBOLS - 1)).cast("short").alias("symbol"), F.col("p").cast("float").alias("p"))
        contexts = lower.groupBy(F.shiftright("code", BITS).alias("context")).agg(F.first("weight").alias("weight"), F.collect_list(follower).alias("f"))
        parts.append(contexts.select((F.lit(order << _TAG) + F.col("context")).alias("key"), "weight", F.col("f.symbol").alias("symbols"), F.col("f.p").alias("ps")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return stored(model, "model")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams seen one to four times."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def wanted_contexts(codes: np.ndarray) -> np.ndarray:
    """The keys of the model that the grams ``codes`` (distinct, of the highest order) may need."""
    keys, here = [], codes
    for order in range(ORDER, 0, -1):
        keys.append(np.unique(here >> BITS) + (order << _TAG))
        here = np.unique(here & ((1 << (BITS * (order - 1))) - 1))
    return np.concatenate(keys)


def looked_up(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the model as rising keys and values: ``order << 56 | gram`` of probabilities, ``8 + order << 56 | context`` of weights."""
    answers = answers.combine_chunks()
    one = lambda name: answers[name].chunk(0) if answers[name].num_chunks else answers[name].combine_chunks()
    context, symbols, ps = one("key").to_numpy(), one("symbols"), one("ps")
    if not len(context):
        return np.zeros(0, np.int64), np.zeros(0)
    tag = (context >> _TAG) << _TAG
    n = symbols.value_lengths().to_numpy()
    grams_ = np.repeat(tag, n) + (np.repeat(context - tag, n) << BITS) + symbols.flatten().to_numpy().astype(np.int64)
    keys = np.concatenate([grams_, context + (_WEIGHT << _TAG)])
    values = np.concatenate([ps.flatten().to_numpy().astype(np.float64), one("weight").to_numpy()])
    order = np.argsort(keys)
    return keys[order], values[order]


def gram_bits(codes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """-log2 of the probability of each gram, from the part of the model (by rising keys) that holds what they need."""

    def look(wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    p = np.full(len(codes), 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        here = codes & ((1 << (BITS * order)) - 1)
        seen = look(here + (order << _TAG), -1.0)
        weight = look((here >> BITS) + ((_WEIGHT + order) << _TAG), 1.0)
        p = np.where(seen >= 0, seen, weight * p)
    return -np.log2(p)


def _remembered_bits(keys: np.ndarray, values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``gram_bits`` of distinct grams in rising order; those asked for before are not looked up again."""
    known, bits = np.zeros(0, np.int64), np.zeros(0)

    def look(codes: np.ndarray) -> np.ndarray:
        nonlocal known, bits
        new = np.setdiff1d(codes, known, assume_unique=True)
        if len(new):
            at = np.searchsorted(known, new)
            known, bits = np.insert(known, at, new), np.insert(bits, at, gram_bits(new, keys, values))
        return bits[np.searchsorted(known, codes)]

    return look


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows -> (block, rows): about BLOCK bytes of text as a compressed Arrow stream, which takes less disk than rows do.

    A block is named by the digest of its rows: what asks and what is scored only meet if they have the same rows.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def emit() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        rows = sink.getvalue().to_pybytes()
        name = int.from_bytes(hashlib.blake2b(rows, digest_size=8).digest(), "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.binary())], names=["block", "rows"])

    for batch in batches:
        _, at = text_buffer(batch.column("text"))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK - size, "right")) - 1)
            last = min(last, batch.num_rows)
            held.append(batch.slice(first, last - first))
            size += int(at[last] - at[first])
            first = last
            if size >= BLOCK:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()


def _unpack(rows: bytes) -> tuple[pa.Table, pa.Array]:
    """The rows of a block and their texts as one array."""
    table = pa.ipc.open_stream(rows).read_all().combine_chunks()
    text = table["text"].combine_chunks()
    return table, text.chunk(0) if isinstance(text, pa.ChunkedArray) else text


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, rows) -> (block, key) of what each block needs of the model."""
    for batch in batches:
        for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
            distinct = np.zeros(0, np.int64)
            for codes, _ in _tallies([_unpack(rows.as_py())[1]]):
                distinct = np.union1d(distinct, codes)
            keys = wanted_contexts(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], names=["block", "key"])


_SCORES = "h long, lang string, n long, bits double, error double"


def _score(blocks: pa.Table, answers: pa.Table, kind: pa.DataType, empty: bool) -> pa.Table:
    keys, values = looked_up(answers)
    bits_of = _remembered_bits(keys, values)
    if len(keys) and not blocks.num_rows:
        raise RuntimeError("answers for a block that is not there: its rows were put together in another way when it asked")
    names = ["id", "h", "lang", "n", "bits", "error"]
    out = [pa.table([pa.array([], t) for t in (kind, pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64())], names=names)]
    for packed in blocks["rows"].to_pylist():
        rows, text = _unpack(packed)
        size, total, squares = (np.zeros(len(text)) for _ in range(3))
        for first, codes, ends in grams(text):
            distinct, place = np.unique(codes, return_inverse=True)
            each = np.append(bits_of(distinct)[place], 0.0)
            part, n = slice(first, first + len(ends) - 1), np.diff(ends)
            size[part] = n
            total[part], squares[part] = (np.where(n > 0, np.add.reduceat(x, ends[:-1]), 0.0) for x in (each, each**2))
        if size.any() and not (empty or len(keys)):
            raise RuntimeError("no answers for a block: its rows were put together in another way when it asked")
        n = np.maximum(size, 1)
        mean = total / n
        spread = np.sqrt(np.maximum(squares / n - mean**2, 0) / n)
        none = pa.array(size == 0)
        masked = [pa.compute.if_else(none, None, pa.array(x)) for x in (mean, spread)]
        out.append(pa.table([rows["id"].cast(kind), rows["h"], rows["lang"].cast(pa.string()), pa.array(size.astype(np.int64)), *masked], names=names))
    return pa.concat_tables(out)


def bits_per_character(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Rows of ``id``, ``h``, ``lang`` and ``text`` -> id, h, lang, ``n`` (characters), ``bits`` (mean per character; null
    without text) and its standard ``error``. ``model`` is what ``kneser_ney`` returns."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["id"].dataType
    # the blocks are shuffled once, as Spark reuses that exchange for those that ask and those that are scored. Where it is
    # made again from rows in another order, blocks have other digests, and the job stops instead of using wrong answers
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a block ends with its partition; small ones are put together, as small blocks ask for much of the model each
    packed = docs.select("id", "h", "lang", "text").coalesce(-(-size // BLOCK) or 1).mapInArrow(_pack, "block long, rows binary")
    blocks = packed.repartition("block")
    answers = blocks.mapInArrow(_ask, "block long, key long").join(model, "key").select("block", "key", "weight", "symbols", "ps")
    score = partial(_score, kind=to_arrow_type(id_type), empty=model.isEmpty())

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return score(left, right)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, f"id {id_type.simpleString()}, {_SCORES}")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """``id`` and ``part`` (0: held out) of rows that every label calls good and none toxic.

    All of them are there, unless a caller asks for ``most``: of the rows that are not held out, about so many are then chosen by their hash.
    """
    good = (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"))
        .filter("quality = 1 and toxic = 0")
        .select("id", F.xxhash64("id").alias("hash"))
        .withColumn("part", F.pmod(F.shiftright("hash", 24), F.lit(HELD_OUT)))
    )
    if most is not None and (n := good.filter("part > 0").count()) > most:
        slots = 1 << 20
        good = good.filter((F.col("part") == 0) | (F.pmod("hash", F.lit(slots)) < int(slots * 0.98 * most / n)))
    return good.select("id", "part")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    outer: float = OUTER,
    reach: float = REACH,
    doubt: float = DOUBT,
    training_rows: int | None = None,
) -> DataFrame:
    """One row per input row: id, ``lang``, ``n_chars``, ``perplexity`` (per character), ``limit`` and ``kept``.

    The model is fitted on the texts of all trusted labelled rows (``training_rows``: about so many of them); every fourth of them is held out and gives each
    language its quantiles of bits per character: the median m and, at ``outer``, b. A document is rejected if its
    bits are above m + reach * (b - m) by more than ``doubt`` standard errors of its own mean. With fewer than
    ``OWN_SPREAD`` held-out rows, m is the language's own and b - m is that of all rows. A language without held-out rows keeps its documents, as the
    model may not have seen it; these, documents without text and all documents where nothing is trusted have null
    limits or perplexity. A null language is a language like others. A text of any length is one row of one block. A bit
    value at the limit is kept. Null ids and repeated rows stay rows of their own; other columns are ignored; an empty
    table gives an empty result.
    """
    verdict = _verdict(docs, labels, id_col, text_col, lang_col, outer, reach, doubt, training_rows)
    return verdict.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_chars", "perplexity", "limit", "kept")


def _verdict(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, outer: float, reach: float, doubt: float, training_rows: int | None
) -> DataFrame:
    """id, ``h`` (hash of the text) and the columns of ``classify``."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    trusted = stored(trusted_ids(labels, most=training_rows), "trusted")
    # the ids grow with the input, so Spark chooses the joins
    model = kneser_ney(rows.join(trusted.filter("part > 0").select("id"), "id", "left_semi").select("text"))
    scores = stored(bits_per_character(rows, model), "scores")
    held = scores.join(trusted.filter("part = 0").select("id"), "id", "left_semi").filter("bits is not null")
    # rounded, so that exact quantiles need no more than a few thousand distinct values for each language
    at = F.percentile(F.round("bits", 3), F.array(F.lit(0.5), F.lit(outer)))
    overall = held.agg(at.alias("all"))  # one row
    by_lang = held.groupBy("lang").agg(at.alias("q"), F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(overall))
    spread = F.when(F.col("rows") < OWN_SPREAD, F.col("all")).otherwise(F.col("q"))
    limit = F.col("q")[0] + reach * (spread[1] - spread[0])
    limits = stored(by_lang.select(F.col("lang").alias("of"), limit.alias("limit")), "limits")
    out = scores.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    bad = F.col("bits") - doubt * F.col("error") > F.col("limit")
    power = lambda name: F.pow(F.lit(2.0), F.col(name)).alias
    kept = (~F.coalesce(bad, F.lit(False))).alias("kept")
    return out.select("id", "h", "lang", F.col("n").alias("n_chars"), power("bits")("perplexity"), power("limit")("limit"), kept)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    outer: float = OUTER,
    reach: float = REACH,
    doubt: float = DOUBT,
    training_rows: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns and nothing else.

    A verdict holds for the rows with its id, language and text, whatever other rows have that id.
    """
    verdict = _verdict(docs, labels, id_col, text_col, lang_col, outer, reach, doubt, training_rows)
    out = verdict.filter("not kept").select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("lang").alias("_l")).distinct()
    same = docs[id_col].eqNullSafe(out["_id"]) & F.xxhash64(docs[text_col]).eqNullSafe(out["_h"])
    return docs.join(out, same & docs[lang_col].cast("string").eqNullSafe(out["_l"]), "left_anti")
