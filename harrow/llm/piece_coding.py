"""SentencePiece encoding that keeps offsets, and decoding.

1. ``charmap.Normaliser`` rewrites the text by the longest keys of the model's compiled character map and records
   for every character that it writes the byte of the source it stands for;
2. the normalised text is cut where no piece of the vocabulary can cross: before a mark of a word's start that
   follows another character, and around line ends if no piece has one. A bounded cache keeps the pieces of a cut,
   as cuts repeat;
3. within a cut, neighbours are joined in the order of the scores of the pieces they make, of equal ones the left one
   first; a character outside the vocabulary becomes its UTF-8 bytes. Short cuts that the cache lacks take their
   joins together: arrays hold one cut in each column, and a round makes the best join of every cut that has one;
4. the characters behind each piece give its span of bytes in the source. Spans follow each other without gaps from
   the first to the last byte kept; of the bytes of one character, the last has its span and the others are empty.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charmap import MARK, Normaliser, read_map
from .tokenizers_io import vocabulary_path

MODEL = "piece_bpe_32k.model"
#: Cuts kept with their pieces in each Python worker, and the longest cut that is kept.
CACHE_CUTS, CACHE_LENGTH = 300_000, 64
#: Cuts that are looked up together, and fewest new ones among them that are joined in arrays.
STRETCH, TOGETHER = 1 << 17, 32
#: Longest cuts of the arrays in which cuts are joined; the last is CACHE_LENGTH.
HEIGHTS = (4, 8, 12, 16, 24, 32, CACHE_LENGTH)
#: Characters of text, or pieces, that leave a task in one batch; a longer text is a batch of its own.
BATCH = 1 << 20
#: Kinds of pieces in a model file, the kind of model, the text of an unknown piece.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
UNKNOWN_TEXT = " ⁇ "
#: Fixed value: more than any join of two symbols.
NO_JOIN = 1 << 62


class PieceCoder:
    """A BPE model with byte fallback: ``encode`` and ``decode`` as the library that reads its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, training = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if training.model_type != BPE or not training.byte_fallback or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are read")
        if training.treat_whitespace_as_suffix or not rules.escape_whitespaces or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("word-start marks in front of words and no map for decoding are expected")
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == training.eos_piece)
        self.normalise = Normaliser(read_map(rules.precompiled_charsmap), rules.add_dummy_prefix, rules.remove_extra_whitespaces)
        self._ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        order = {score: i for i, score in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self._ranks = {p.piece: order[p.score] for p in model.pieces if p.type == NORMAL}
        self._bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        alone = "" if any("\n" in piece for piece in self._ids) else "\n"
        crossed = any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self._ids)
        cut = f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else "")
        self._cuts = (lambda text: [text]) if crossed else re.compile(cut).findall
        self._cache: dict[str, bytes] = {}
        self._read_pairs(len(model.pieces))
        surface = {UNKNOWN: lambda p: UNKNOWN_TEXT, CONTROL: lambda p: "", BYTE: lambda p: bytes((int(p[3:5], 16),))}
        plain = lambda p: p.replace(MARK, " ")
        found = [surface.get(p.type, plain)(p.piece) for p in model.pieces]
        self._surface = [x if isinstance(x, bytes) else x.encode() for x in found]
        self._is_control = np.array([p.type == CONTROL for p in model.pieces])
        self._one_space = rules.add_dummy_prefix or rules.remove_extra_whitespaces
        self._all_spaces = rules.remove_extra_whitespaces
        self._starts_word = np.array([p.type == NORMAL and p.piece.startswith(MARK) for p in model.pieces])

    def _read_pairs(self, count: int) -> None:
        """Numbers of symbols (pieces by id, then other characters of pieces), and what each two of them make."""
        symbols = {**self._ids}
        for sign in sorted({c for p in self._ids for c in p} - symbols.keys()):
            symbols[sign] = count + len(symbols) - len(self._ids)
        # symbols that join with none: one for all other characters, and one behind a cut's end.
        self._count, self._other = count, count + len(symbols) - len(self._ids)
        self._behind = self._other + 1
        self._signs = np.full(0x110000, self._other, np.int32)
        self._widths = np.ones(self._behind + 1, np.int64)
        for text, symbol in symbols.items():
            self._widths[symbol] = len(text)
            if len(text) == 1:
                self._signs[ord(text)] = symbol
        get, size = symbols.get, self._behind + 1
        splits = ((get(p[:k]), get(p[k:]), p) for p in self._ids for k in range(1, len(p)))
        made = {a * size + b: self._ranks[p] << 40 | self._ids[p] for a, b, p in splits if a is not None and b is not None}
        self._pairs = np.array([*sorted(made), np.iinfo(np.int64).max])
        self._made = np.array([*(made[k] for k in self._pairs[:-1].tolist()), NO_JOIN])

    def _makes(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank, place in the cut and symbol of what each two neighbours make, in one number; NO_JOIN or more without."""
        keys = left.astype(np.int64) * (self._behind + 1) + right
        at = np.searchsorted(self._pairs, keys)
        return np.where(self._pairs[at] == keys, self._made[at], NO_JOIN) + (place.astype(np.int64) << 32)

    def _joined_together(self, cuts: list[str]) -> list[bytes]:
        """``_cut_pieces`` of each of many cuts of CACHE_LENGTH characters at most."""
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        signs = self._signs[np.frombuffer("".join(cuts).encode("utf-32-le"), "<u4")]
        first = np.cumsum(sizes) - sizes
        found = [b""] * len(cuts)
        for low, height in zip((0, *HEIGHTS), HEIGHTS, strict=False):
            of = np.flatnonzero((sizes > low) & (sizes <= height))
            if not len(of):
                continue
            rows = np.arange(height)[:, None]
            inside = rows < sizes[of]
            parts = np.where(inside, signs[np.where(inside, first[of] + rows, 0)], self._behind)
            for columns, done in self._rounds(parts):
                there = done != self._behind
                flat = done.T[there.T].astype(np.int64)
                packed = (flat | self._widths[flat] << 32).tobytes()
                ends = 8 * np.cumsum(there.sum(axis=0))
                known = ((done < self._count) | ~there).all(axis=0)
                spans = zip(of[columns].tolist(), [0, *ends.tolist()], ends.tolist(), known.tolist(), strict=False)
                for i, start, end, whole in spans:
                    found[i] = packed[start:end] if whole else self._cut_pieces(cuts[i])
        return found

    def _rounds(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers and symbols of the columns of ``parts`` that have all their joins, as they come to their ends."""
        columns = np.arange(parts.shape[1])
        pairs = self._makes(parts[:-1], parts[1:], np.arange(len(parts) - 1)[:, None])
        while len(pairs) and len(columns):
            best = pairs.min(axis=0)
            live = best < NO_JOIN
            if not live.all():
                yield columns[~live], parts[:, ~live]
                columns, parts, pairs, best = columns[live], parts[:, live], pairs[:, live], best[live]
            at = best >> 32 & 0xFF
            each = np.arange(len(columns))
            parts[at, each] = best & 0xFFFFFFFF
            rows = np.arange(len(parts) - 1)[:, None]
            parts = np.where(rows > at, parts[1:], parts[:-1])
            pairs = np.where(rows[:-1] >= at, pairs[1:] - (1 << 32), pairs[:-1])
            for shift in (-1, 0):  # the join's neighbours on both sides
                some = each[(at + shift >= 0) & (at + shift < len(pairs))]
                left = at[some] + shift
                pairs[left, some] = self._makes(parts[left, some], parts[left + 1, some], left)
        yield columns, parts

    def _joined(self, text: str) -> list[str]:
        """The segments of a cut after all joins: the best pair first, of equal ones the left one."""
        if len(text) > CACHE_LENGTH:
            return self._joined_long(text)
        parts, rank, none = list(text), self._ranks.get, len(self._ranks)
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _joined_long(self, text: str) -> list[str]:
        """The same with a heap and links, for cuts in which a search of all pairs for each join would take long."""
        parts: list[str] = list(text)
        before, after = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        ranks, waiting = self._ranks, []

        def offer(left: int, right: int) -> None:
            made = parts[left] + parts[right]
            if (rank := ranks.get(made)) is not None:
                heapq.heappush(waiting, (rank, left, right, len(made)))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while waiting:
            _, left, right, size = heapq.heappop(waiting)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[left] < len(text):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p]

    def _cut_pieces(self, text: str) -> bytes:
        """Pieces of a cut as 64-bit numbers: the id, and from bit 32 the characters; a character's bytes but the last have none."""
        parts = self._joined(text)
        try:
            found = [self._ids[p] | len(p) << 32 for p in parts]
        except KeyError:
            found = []
            for part in parts:
                if (known := self._ids.get(part)) is not None:
                    found.append(known | len(part) << 32)
                else:
                    found += (self._bytes[b] for b in part.encode("utf-8"))
                    found[-1] |= len(part) << 32
        return array("q", found).tobytes()

    def _looked_up(self, cuts: list[str]) -> list[bytes]:
        """``_cut_pieces`` of each of the cuts, most of them from the cache."""
        found: list[bytes] = []
        for first in range(0, len(cuts), STRETCH):
            part = cuts[first : first + STRETCH]
            own = list(map(self._cache.get, part))
            missing = [i for i, x in enumerate(own) if x is None]
            new = {part[i] for i in missing}
            short = [x for x in new if len(x) <= CACHE_LENGTH]
            together = len(short) >= TOGETHER
            pieces = dict(zip(short, self._joined_together(short) if together else map(self._cut_pieces, short), strict=True))
            if len(self._cache) + len(short) > CACHE_CUTS:
                self._cache.clear()
            self._cache.update(pieces)
            pieces.update((x, self._cut_pieces(x)) for x in new if len(x) > CACHE_LENGTH)
            for i in missing:
                own[i] = pieces[part[i]]
            found += own
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text and the first and last bytes (exclusive) of each piece's span in it."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of each text; cuts that are new are joined together."""
        normal = list(map(self.normalise, texts))
        cuts = [self._cuts(text) for text, _ in normal]
        pieces = self._looked_up([cut for own in cuts for cut in own])
        out, done = [], 0
        for (_, places), own in zip(normal, cuts, strict=True):
            ids, widths = np.frombuffer(b"".join(pieces[done : done + len(own)]), "<i4").reshape(-1, 2).T
            done += len(own)
            ends = np.cumsum(widths)
            out.append((ids.copy(), places[ends - widths], places[ends]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Control pieces have none; bytes that are not UTF-8 become U+FFFD one by one.

        Bytes on both sides of a control piece make no character together.
        """
        if len(stops := np.flatnonzero(self._is_control[ids])):
            parts = [p for p in np.split(ids, stops) if len(p)]
            texts = [p[1:] if self._is_control[p[0]] else p for p in parts]
            texts = [t for t in texts if len(t)]
            return "".join(self._text(t, first=k == 0) for k, t in enumerate(texts))
        return self._text(ids, first=True)

    def _text(self, ids: np.ndarray, first: bool) -> str:
        skip = 0
        if first and self._one_space and len(ids) and self._starts_word[ids[0]]:
            skip = 1
        surface = self._surface
        out = b"".join([surface[i] for i in ids.tolist()])[skip:]
        if first and self._all_spaces:
            out = out.lstrip(b" ")
        try:
            return out.decode("utf-8")
        except UnicodeDecodeError:
            return _byte_wise(out)


def _byte_wise(data: bytes) -> str:
    """UTF-8 in which every byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """The model at ``path``, read once in each Python worker."""
    return PieceCoder(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32)))


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, last + 1) with about BATCH units, or one row that is longer."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + BATCH, "right")))
        yield first, last
        first = last


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, end: bool = True, with_decoded: bool = False
) -> DataFrame:
    """One row per input row: id, ``ids``, and ``starts`` and ``ends`` of the pieces' spans in the UTF-8 of the text.

    With ``with_decoded`` a column ``decoded`` has the text of the ids, as ``decode`` gives it, from the same Python worker.

    With ``end`` the end id closes each list; its span is empty. A null or empty text has no other ids. Texts are
    encoded whole, whatever their length; a long one is a batch of its own. Null ids and repeated rows stay rows of
    their own and equal texts get equal lists; other columns are ignored; an empty table gives an empty result. There
    is no shuffle: a row needs only itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary_path(model))
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for first, last in _runs(np.array(pa.compute.binary_length(texts))):
                found = own.encode_all(texts.slice(first, last - first).to_pylist())
                if end:
                    found = [(np.append(i, own.end_id), np.append(a, b[-1:] if len(b) else 0), np.append(b, b[-1:] if len(b) else 0)) for i, a, b in found]
                columns = [_lists([x[k] for x in found]) for k in range(3)]
                if with_decoded:
                    columns.append(pa.array([own.decode(x[0]) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names=names)

    names = ["id", "ids", "starts", "ends", *(["decoded"] if with_decoded else [])]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * with_decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` without ``ids_col`` and with the text of its ids as ``out_col``; other columns, ``ids_col`` aside, stay.

    Null or empty lists give an empty text. An id outside the vocabulary is an error, as in the library.
    """
    kept = [f for f in encoded.schema.fields if f.name != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary_path(model))
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = np.array(pa.compute.list_value_length(lists).fill_null(0))
            for first, last in _runs(sizes):
                part = lists.slice(first, last - first)
                flat = np.asarray(part.flatten())
                stops = np.cumsum(sizes[first:last])
                texts = [own.decode(flat[b - n : b]) for n, b in zip(sizes[first:last], stops, strict=True)]
                rest = [batch.column(i).slice(first, last - first) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=names)

    # positions stand in for names while rows are in Python, as names may clash
    names = [f"c{i}" for i in range(len(kept))] + ["text"]
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    rows = encoded.select(*(quoted(f.name).alias(n) for f, n in zip(kept, names, strict=False)), quoted(ids_col).alias("text"))
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for f, n in zip(kept, names, strict=False)), "text string"])
    return rows.mapInArrow(run, schema).toDF(*(f.name for f in kept), out_col)


def code_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, number of ids, their digest, the bytes that their spans cover, and the digest of the decoded text.

    Digests are SHA-256 in lower-case hexadecimal: of the decimal ids joined by a space, and of the text in UTF-8.
    Awkward rows are treated as in ``encode`` and ``decode``.
    """
    return encode(docs, id_col, text_col, model, with_decoded=True).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )
