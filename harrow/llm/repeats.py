"""Repeated byte strings by content-defined sampling and grouping of hashes, in place of a difference-cover sort.

Wanted is every start i whose ``length`` bytes also start anywhere else: in a suffix array, those whose ``length``-byte
prefix equals that of a neighbour. A suffix array over all positions needs a record of 16 bytes or more for every
byte of the corpus and sorts them several times. This algorithm groups only sampled positions by their hashes; positions
whose hash is unique are discarded at once, since no repeat can cover them. There are no triples, ranks or merges.

*Sampling.* A cover of fixed residues (modulo 3) meets two equal strings at common offsets because it is dense. This
cover is content-defined: start i is represented by its anchor, the position of the smallest hash among the first
``window`` positions of its string. Equal strings have their anchors at equal offsets, which is the property that
difference covers are for, with one sample in about window / 2 positions.

*Naming.* All starts with one anchor form a run s..e. Its core is what all strings of the run share from the anchor
on; its extent is all that they cover. Runs are grouped by core and extent, and equal ones get equal names (128-bit
fingerprints):
  - a core that occurs once: no start of the run is repeated; the run is discarded;
  - an extent that occurs again: every start of the run is repeated;
  - otherwise the core has several extents, and the starts of one run may be repeated or not.

*Recursion and merging.* For the third kind, one run per name is cut into shorter runs, which are named in turn, down
to single starts, where core and extent are the string itself: adjacent equal strings are the repeats.

Groups are only counted and combined, never collected, so a string that a third of all documents share costs one row
for each place that it stands at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import CHUNK, chunks, prefix_hashes, rolling_hashes, text_buffer, window_hashes
from .storage import discard, stored

LENGTH = 400
WINDOW, GRAIN = 256, 16
#: Starts in a run after each cut.
STEPS = (16, 1)
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)


def anchors(prefix: np.ndarray, window: int) -> np.ndarray:
    """For each start the position of the smallest hash among ``window`` positions; the last of equal ones."""
    hashes = rolling_hashes(prefix, GRAIN)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ranked = (hashes >> _HIGH) << _HIGH | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    padded = np.full(-(-len(ranked) // window) * window, ~np.uint64(0))
    padded[: len(ranked)] = ranked
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
    return (_LOW - (least & _LOW)).astype(np.int64)


def runs(data: np.ndarray, ends: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, s, e (in the text), anchor - s, core and the halves of the extent's name."""
    prefix, other = prefix_hashes(data), prefix_hashes(data, 1)
    anchor = anchors(prefix, window)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= ends[1:][text])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    anchor, text = anchor[start], text[start]
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(start)) - 1
    s, e, at = start[first], start[last], anchor[first]
    text = text[first]
    core = window_hashes(prefix, at, at + length - window + 1)
    extent = [window_hashes(p, s, e + length, f) for f, p in enumerate((prefix, other))]
    base = ends[:-1][text]
    return text, s - base, e - base, at - s, *(x.view(np.int64) for x in (core, *extent))


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in its text, bytes, text ends): chunks of texts, or stretches of one long text."""
    data, at = text_buffer(column)
    for first, last in chunks(at):
        whole = data[at[first] : at[last]]
        if last - first > 1 or len(whole) <= 2 * CHUNK:
            yield first, 0, whole, at[first : last + 1] - at[first]
            continue
        for offset in range(0, max(len(whole) - length + 1, 1), CHUNK):
            part = whole[offset : offset + CHUNK + length - 1]
            yield first, offset, part, np.array([0, len(part)])


def _emit_runs(batches: Iterator[pa.RecordBatch], length: int, window: int, cores_only: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, offset, data, ends in _pieces(batch.column("text"), length):
            text, s, e, a, core, g1, g2 = runs(data, ends, length, window)
            if not len(s):
                continue
            if cores_only:
                yield pa.RecordBatch.from_arrays([pa.array(core)], names=["core"])
                continue
            rows = pa.array(first + text)
            columns = [batch.column("id").take(rows), batch.column("h").take(rows), pa.array(s + offset), pa.array(e + offset), pa.array(a)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (core, g1, g2))], names=["id", "h", "s", "e", "a", "core", "g1", "g2"])


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(run, lo, a, bytes) of the runs listed with each text."""
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        names, anchor, out = [], [], []
        for row, places in enumerate(batch.column("places").to_pylist()):
            text = data[at[row] : at[row + 1]]
            for place in places:
                names.append((place["core"], place["g1"], place["g2"]))
                anchor.append(place["a"])
                out.append(text[place["s"] : place["e"] + length].tobytes())
        columns = list(zip(*names, strict=True)) if names else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array([0] * len(out), pa.int64()), pa.array(anchor, pa.int64()), pa.array(out, pa.binary())],
            names=["core", "g1", "g2", "lo", "a", "bytes"],
        )


def _take(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The wanted stretches (lo, hi, a) of each run as runs of their own."""
    for batch in batches:
        data, at = text_buffer(batch.column("bytes"))
        lists = batch.column("wanted")
        wanted = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        lo, hi, far = (wanted.field(c).to_numpy() for c in ("lo", "hi", "a"))
        starts = at[:-1][row] + lo - batch.column("lo").to_numpy()[row]
        for first in range(0, len(row), 4096):
            part = slice(first, first + 4096)
            held = [data[s : s + n + length].tobytes() for s, n in zip(starts[part].tolist(), (hi - lo)[part].tolist(), strict=True)]
            names = [batch.column(c).take(pa.array(row[part])) for c in ("core", "g1", "g2")]
            yield pa.RecordBatch.from_arrays(
                [*names, pa.array(lo[part]), pa.array(far[part]), pa.array(held, pa.binary())], names=["core", "g1", "g2", "lo", "a", "bytes"]
            )


def _cut_up(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """Runs (core, g1, g2: the first run's name; lo, a, bytes) -> shorter runs with their own names.

    Cells of ``step`` starts are counted from the anchor, so that runs that begin at different distances from it are
    cut at the same places. A part's core is what all strings of its whole cell share.
    """
    for whole in batches:
        for first in range(0, whole.num_rows, 512):
            batch = whole.slice(first, 512)
            data, at = text_buffer(batch.column("bytes"))
            data, ends = data[at[0] : at[-1]], at - at[0]
            starts = np.diff(ends) - length + 1
            far = batch.column("a").to_numpy()
            parts = far // step - (far - starts + 1) // step + 1
            row = np.repeat(np.arange(batch.num_rows), parts)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            base, near = ends[:-1][row], far[row] - (far[row] // step - nth) * step  # near: the cell's last start
            s, e = base + np.maximum(near - step + 1, 0), base + np.minimum(near, starts[row] - 1)
            hashes = [prefix_hashes(data, f) for f in (0, 1)]
            core = window_hashes(hashes[0], base + near, base + near - step + 1 + length)
            extent = [window_hashes(p, s, e + length, f) for f, p in enumerate(hashes)]
            of = pa.array(row)
            low = batch.column("lo").to_numpy()[row] + s - base
            columns = [pa.array(x.view(np.int64)) for x in ((core, *extent) if step > 1 else extent)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(of) for c in ("core", "g1", "g2")), pa.array(low), pa.array(low + e - s), pa.array(far[row] - (s - base)), *columns],
                names=["core", "g1", "g2", "lo", "hi", "a", *(["part_core"] if step > 1 else []), "p1", "p2"],
            )


def _cut_wanted(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    return _cut_up(_take(batches, length), length, step)


def _contested(runs_: DataFrame, core: str, names: tuple[str, str]) -> DataFrame:
    """Of runs (one row per core and extent) those whose core has more than one extent."""
    several = runs_.groupBy(core).agg(F.count(F.lit(1)).alias("extents")).filter("extents > 1").select(core)
    return runs_.join(several, core, "left_semi")


def repeated_starts(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Rows of id, ``h``, ``lo``, ``hi``: stretches of starts in the text (id, h) whose ``length`` bytes occur elsewhere.

    ``texts`` has ``id``, ``h`` and ``text``; rows with equal id and h have equal texts.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    cores = texts.select("text").mapInArrow(partial(_emit_runs, length=length, window=window, cores_only=True), "core long")
    shared = stored(cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"), "cores")
    schema = f"id {id_type}, h long, s long, e long, a long, core long, g1 long, g2 long"
    every = texts.mapInArrow(partial(_emit_runs, length=length, window=window, cores_only=False), schema)
    open_ = stored(every.join(shared, "core", "left_semi"), "runs")
    name = ["core", "g1", "g2"]
    named = stored(open_.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "s", "e", "a")).alias("at")), "names")
    settled = named.filter("n > 1").select(*name, F.lit(0).cast("long").alias("lo"), (F.col("at.e") - F.col("at.s")).alias("hi"))
    # one place for each extent of a contested core; a text's list is no longer than its runs
    places = _contested(named, "core", ("g1", "g2")).select(F.col("at.id").alias("id"), F.col("at.h").alias("h"), *name, "at.s", "at.e", "at.a")
    places = places.groupBy("id", "h").agg(F.collect_list(F.struct(*name, "s", "e", "a")).alias("places"))
    places = places.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "places")
    whole = texts.join(places, texts["id"].eqNullSafe(places["_id"]) & (texts["h"] == places["_h"]))
    whole = whole.select("text", "places")
    run_schema = "core long, g1 long, g2 long, lo long, a long, bytes binary"
    # the bytes of contested runs are written once; what is cut from them later is named by its place
    level = stored(whole.mapInArrow(partial(_cut_out, length=length), run_schema), "places")
    everything = F.array(F.struct("lo", (F.length("bytes") - length).cast("long").alias("hi"), "a"))
    cut = level.withColumn("wanted", everything)
    flagged, passing = settled, [shared, named]
    for step in STEPS:
        schema = "core long, g1 long, g2 long, lo long, hi long, a long, " + "part_core long, " * (step > 1) + "p1 long, p2 long"
        parts = stored(cut.mapInArrow(partial(_cut_wanted, length=length, step=step), schema), f"parts-{step}")
        passing.append(parts)
        part = ["part_core", "p1", "p2"] if step > 1 else ["p1", "p2"]
        again = parts.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*part)
        flagged = flagged.unionByName(parts.join(again, part, "left_semi").select(*name, "lo", "hi"))
        if step > 1:
            # of equal parts one is enough to meet the others; those that stand alone are there themselves
            firsts = parts.groupBy(*part).agg(F.min(F.struct(*name, "lo", "hi", "a")).alias("one"))
            one = _contested(firsts, "part_core", ("p1", "p2")).select("one.*")
            # a run's list is no longer than its starts
            wanted = one.groupBy(*name).agg(F.collect_list(F.struct("lo", "hi", "a")).alias("wanted"))
            cut = level.join(wanted, name)
    flagged = stored(flagged, "flagged")
    discard(level, *passing)
    return open_.join(flagged, name).select("id", "h", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi"))


def covered(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that strings of ``length`` bytes at the starts lo..hi cover."""
    found: list[tuple[int, int]] = []
    for i in np.argsort(lo, kind="stable"):
        a, b = int(lo[i]), int(hi[i]) + length
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], b))
        else:
            found.append((a, b))
    return found


def _remove(batches: Iterator[pa.RecordBatch], length: int, texts_too: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, places in zip(batch.column("text"), batch.column("places").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            pairs = np.array([(p["lo"], p["hi"]) for p in places or ()], np.int64).reshape(-1, 2)
            spans = covered(pairs[:, 0], pairs[:, 1], length)
            cuts = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            row = [len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
            rows.append([*row, kept] if texts_too else row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if texts_too else [])]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts_too else [])]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *names])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    window: int = WINDOW,
    with_bytes: bool = False,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept``.

    Every byte covered by a ``length``-byte string that also starts anywhere else, in any document, is removed; all
    occurrences go. Matches do not cross documents. Null and short texts lose nothing. Repeated rows are copies of
    each other, so a repeated row of ``length`` bytes or more is removed whole. Null ids are ids like others; other
    columns are ignored; an empty table gives an empty result. A very long text is one row, read whole; strings are
    judged on the input, so there are no ties to settle.
    """
    if not GRAIN <= length - window + 1:
        raise ValueError(f"length must be at least window + {GRAIN - 1}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    places = repeated_starts(texts, length, window).groupBy("id", "h")
    # a text's list is no longer than the text
    places = places.agg(F.collect_set(F.struct("lo", "hi")).alias("places"))
    places = places.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "places")
    joined = texts.join(places, texts["id"].eqNullSafe(places["_id"]) & (texts["h"] == places["_h"]), "left")
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    out = joined.select("id", "text", "places").mapInArrow(partial(_remove, length=length, texts_too=with_bytes), schema)
    return out.withColumnRenamed("id", id_col)
