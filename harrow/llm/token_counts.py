"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each position; dynamic programming
carries the best score and the number of pieces on the best path, never the path itself. Ties follow the
unigram tokenizer: of equally good pieces that end at a position, the one that starts first wins, and an
unknown character only wins where it is strictly better.

No piece crosses the start of a word (a word-start mark after another character), so the best path of a text
is the concatenation of the best paths of its words; words repeat, and a bounded cache keeps their counts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizers_io import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
#: Fixed values of the tokenizer: the mark of a word's start, and an unknown character's distance below the lowest score.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept with their counts in each Python worker, and the longest word that is kept.
CACHE_WORDS = 300_000
CACHE_LENGTH = 64


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a public vocabulary file, taken as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


def best_path_counter(vocabulary: Iterable[tuple[str, float]]) -> Callable[[str], int]:
    """marked text -> number of tokens on its best path; a character outside the vocabulary is its UTF-8 bytes."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    scores: dict[str, float] = {}
    for piece, score in vocabulary:
        if piece:
            scores[piece] = score
            automaton.add_word(piece, (len(piece), score))
    if scores:
        automaton.make_automaton()
    unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
    single = {piece for piece in scores if len(piece) == 1}
    matches = automaton.iter if scores else (lambda text: ())

    def count(text: str) -> int:
        size = len(text)
        best, tokens = [0.0] * (size + 1), [0] * (size + 1)
        done = 0

        def close(end: int, reached: float | None, pieces: int) -> None:
            """Settles position ``end``, with an unknown character as the last candidate."""
            last = text[end - 1]
            if last not in single:
                score = best[end - 1] + unknown
                if reached is None or score > reached:
                    reached, pieces = score, tokens[end - 1] + len(last.encode("utf-8", "surrogatepass"))
            best[end], tokens[end] = reached, pieces

        reached: float | None = None
        pieces = 0
        for at, (length, score) in matches(text):  # longest first at each end, so the earliest start comes first
            end = at + 1
            while done + 1 < end:
                done += 1
                close(done, reached, pieces)
                reached, pieces = None, 0
            score += best[end - length]
            if reached is None or score > reached:
                reached, pieces = score, tokens[end - length] + 1
        while done < size:
            done += 1
            close(done, reached, pieces)
            reached, pieces = None, 0
        return tokens[size]

    return count


class _Words(dict):
    """Word with its leading spaces -> token count; emptied when full."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self._count = count

    def __missing__(self, word: str) -> int:
        found = self._count(word.replace(" ", MARK))
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


def text_counter(vocabulary: list[tuple[str, float]]) -> Callable[[str], int]:
    """text -> token count; the text gets a word-start mark in front and its spaces become such marks.

    Texts are cut before a mark that follows another character, and around line ends if no piece has one.
    A vocabulary with a piece across such a cut is searched over whole texts.
    """
    count = best_path_counter(vocabulary)
    if any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in vocabulary):
        return lambda text: count(MARK + text.replace(" ", MARK)) if text else 0
    alone = "" if any("\n" in piece for piece, _ in vocabulary) else "\n"
    split = re.compile(rf" *[^ {alone}]+| *{alone}| +" if alone else " *[^ ]+| +").findall
    words = _Words(count)
    return lambda text: sum(map(words.__getitem__, split(" " + text))) if text else 0


@functools.lru_cache(maxsize=2)
def _counter_of(path: str) -> Callable[[str], int]:
    return text_counter(read_vocabulary(path))


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per input row: id, ``n_chars`` (code points) and ``n_tokens``.

    Null and empty texts have no tokens. A text of any length is counted whole; paths with equal scores are
    settled as the module says. The model file's own normaliser is left out. Null ids and repeated rows stay rows of their own; other columns are
    ignored; an empty table gives an empty result. There is no shuffle: a row needs only itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter_of(vocabulary_path(vocabulary))
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            sizes = [pa.array(map(f, texts), pa.int64()) for f in (len, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes], names=["id", "n_chars", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_chars long, n_tokens long").withColumnRenamed("id", id_col)
