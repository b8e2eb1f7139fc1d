import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harrow.llm.packing import pack, plan_sequences
from harrow.llm.token_counts import best_path_counter, text_counter, token_counts

from .samples import awkward, nothing, rows_of


def test_pieces_are_the_tokenizers_and_sequences_have_no_gaps(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = awkward(spark, ["a <|endoftext|> b", "x " * 511 + "x", "tab\t\tand space  end "])
    rows = rows_of(pack(docs))
    wanted = []
    for r in rows_of(docs):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        starts = [0, *range(first, len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            wanted.append((r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(wanted, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert pack(nothing(spark)).count() == 0


def test_plan_uses_every_length_and_few_sequences():
    rng = random.Random(2)
    counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 1025), 300)}
    used, total, sequences = {}, 0, 0
    for pattern, times in plan_sequences(counts):
        assert sum(pattern) <= 1024
        sequences += times
        for n in pattern:
            used[n] = used.get(n, 0) + times
            total += n * times
    assert used == counts
    # no two lengths above the half fit together
    assert sequences <= 1.01 * max(total / 1024, sum(n for length, n in counts.items() if length > 512)) + 2


def by_hand(text, vocabulary):
    """Plain Viterbi over all substrings."""
    unknown = min(vocabulary.values()) - 10.0
    best, pieces = [0.0], [0]
    for end in range(1, len(text) + 1):
        top, n = None, 0
        for start in range(end):
            if (score := vocabulary.get(text[start:end])) is not None and (top is None or best[start] + score > top):
                top, n = best[start] + score, pieces[start] + 1
        if text[end - 1] not in vocabulary and (top is None or best[-1] + unknown > top):
            top, n = best[-1] + unknown, pieces[-1] + len(text[end - 1].encode())
        best.append(top)
        pieces.append(n)
    return pieces[-1]


@pytest.mark.parametrize("seed", range(20))
def test_counts_equal_a_plain_search(seed):
    rng = random.Random(seed)
    letters = "ab▁c"
    vocabulary = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): -rng.randrange(1, 8) / 2 for _ in range(25)}
    vocabulary = {k: v for k, v in vocabulary.items() if "▁" not in k[1:]}
    count, whole = best_path_counter(vocabulary.items()), text_counter(list(vocabulary.items()))
    for _ in range(30):
        text = "".join(rng.choice("abc dé\n") for _ in range(rng.randrange(1, 40)))
        marked = "▁" + text.replace(" ", "▁")
        assert count(marked) == by_hand(marked, vocabulary) == whole(text)


def test_rows_and_awkward_texts(spark):
    docs = awkward(spark)
    got = rows_of(token_counts(docs))
    assert len(got) == docs.count()
    assert all(r["n_tokens"] == 0 and r["n_chars"] == 0 for r in got if r["doc_id"] in (0, 1))
    assert token_counts(nothing(spark)).count() == 0
