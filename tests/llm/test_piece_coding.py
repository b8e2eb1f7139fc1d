import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from harrow.llm.charmap import Normaliser, char_starts, read_map
from harrow.llm.piece_coding import MODEL, PieceCoder, code_digests, coder, decode, encode
from harrow.llm.tokenizers_io import vocabulary_path

from .samples import awkward, nothing, rows_of

SIGNS = list(" ▁aAbe\n\t\x00éß漢字🎉ﬁ①<s>/0x41‍́'")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL))


@pytest.fixture(scope="module")
def own():
    return coder(vocabulary_path(MODEL))


def test_ids_spans_and_texts_equal_the_library(library, own):
    rng = random.Random(1)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(14))) for _ in range(4000)]
    for text in [*texts, "x" * 5000, " " * 300, "pneumonoultra " * 400, "漢" * 999]:
        ids, starts, ends = own.encode(text)
        assert ids.tolist() == library.encode(text)
        assert own.decode(ids) == library.decode(ids.tolist())
        proto = library.encode(text, return_type="proto").pieces
        assert [(p.begin, p.end) for p in proto] == list(zip(starts.tolist(), ends.tolist(), strict=True))
        assert not len(ids) or (starts[0] == 0 and ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all())


def test_any_ids_decode_as_in_the_library(library, own):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, 3, 20, 259, 28705, 264, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert own.decode(np.array(ids, int)) == library.decode(ids), ids


def test_longest_prefix_normalisation_keeps_offsets(rule="nmt_nfkc"):
    """The compiled maps of the library itself, with its own offsets."""
    rng = random.Random(3)
    for prefix in (True, False):
        for squeeze in (True, False):
            theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(theirs.serialized_model_proto())
            keys = read_map(proto.normalizer_spec.precompiled_charsmap)
            ours = Normaliser(keys, prefix, squeeze)
            signs = [*"  \t　aÅｱﾞﷺﬁ①é́̈½漢▁¨\x01​한", *rng.sample(sorted(keys), 100)]
            for _ in range(1000):
                text = "".join(rng.choices(signs, k=rng.randrange(12)))
                found, places = ours(text)
                expected, offsets = theirs.normalize(text, with_offsets=True)
                assert (found, places.tolist()) == (expected, char_starts(text)[offsets].tolist()), text


def test_digests_of_awkward_rows(spark, library):
    docs = awkward(spark, extra=["</s> <s>", "▁ ▁▁", "a\x00b"])

    def expected(text):
        ids = library.encode(text or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), len((text or "").encode())

    got = Counter(tuple(r.values()) for r in rows_of(code_digests(docs)))
    assert got == Counter((r["doc_id"], *expected(r["text"])) for r in rows_of(docs))
    assert code_digests(nothing(spark)).count() == 0


def test_other_columns_pass_through_decoding(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, None)], "doc_id long, text string")
    coded = encode(docs).withColumnsRenamed({"starts": "a.b", "ends": "text"})
    got = rows_of(decode(coded))
    assert list(got[0]) == ["doc_id", "a.b", "text", "decoded"]
    assert [r["decoded"] for r in got] == ["one two", ""]
    assert rows_of(decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")))[0]["decoded"] == ""


def test_digests_take_one_python_worker_a_task(spark):
    """Each worker holds the vocabulary and a cache, so texts are encoded and decoded in the same one."""
    docs = awkward(spark, extra=["one two", "x" * 5000])
    plan = code_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both = rows_of(encode(docs, with_decoded=True).select("ids", "decoded"))
    assert Counter(r["decoded"] for r in both) == Counter(r["decoded"] for r in rows_of(decode(encode(docs))))


def new_words(own, count, seed):
    rng = random.Random(seed)
    pieces = [p for p in own._ids if "▁" not in p]
    signs = [*"abcdefghijklmnopqrstuvwxyzäöüßé'-", "漢", "🎉", "\x00"]
    return ["".join(rng.choices(signs if k % 2 else pieces, k=rng.randrange(1, 25))) for k in range(count)]


def test_new_words_of_a_text_are_joined_together(library, own, monkeypatch):
    """Words that no cache has are most of the work, so they are not joined one by one."""
    text = " ".join(w for w in new_words(own, 6000, 4) if w.isascii() and len(w) < 60 and "\x00" not in w)
    one_by_one = []
    joined = own._joined
    monkeypatch.setattr(own, "_joined", lambda cut: one_by_one.append(cut) or joined(cut))
    assert own.encode(text)[0].tolist() == library.encode(text)
    assert len(one_by_one) < 10


def test_words_joined_together_equal_the_library(library, own, monkeypatch):
    """Also while the cache overflows within a text, and with characters that the vocabulary lacks."""
    monkeypatch.setattr("harrow.llm.piece_coding.CACHE_CUTS", 500)
    monkeypatch.setattr("harrow.llm.piece_coding.STRETCH", 300)
    words = new_words(own, 5000, 5)
    texts = [" ".join(words[k : k + 900]) for k in range(0, 5000, 450)] + ["", "x" * 64, "y" * 65]
    for text, (ids, starts, ends) in zip(texts, own.encode_all(texts), strict=True):
        proto = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in proto]
        assert [(p.begin, p.end) for p in proto] == list(zip(starts.tolist(), ends.tolist(), strict=True))
    assert len(own._cache) <= 500


def test_of_equal_scores_the_left_join_comes_first():
    own = PieceCoder(vocabulary_path(MODEL))
    own._ranks = {p: r // 3000 for p, r in own._ranks.items()}
    own._read_pairs(len(own._surface))
    words = sorted({w[:64] for w in new_words(own, 4000, 6)})
    assert own._joined_together(words) == [own._cut_pieces(w) for w in words]
