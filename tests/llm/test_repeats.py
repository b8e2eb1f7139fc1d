import hashlib
import random
from collections import Counter

from harrow.llm.repeats import remove_repeats

from .samples import awkward, nothing, rows_of


def brute_force(text, counts, length):
    data = (text or "").encode()
    gone = bytearray(len(data))
    for i in range(len(data) - length + 1):
        if counts[data[i : i + length]] > 1:
            gone[i : i + length] = b"\1" * length
    kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
    return len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def test_against_brute_force(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage = noise(700)
    texts = [noise(300) + passage[: 350 + 40 * i] + noise(200) + passage[600 - 50 * i :] for i in range(8)]
    texts += ["ab" * 900, noise(50) + "x" * 450, "x" * 399, "y" * 400, passage[100:520], noise(100) + passage[100:499]]
    docs = awkward(spark, texts)
    rows = rows_of(docs)
    counts = Counter()
    for r in rows:
        data = (r["text"] or "").encode()
        counts.update(data[i : i + 400] for i in range(len(data) - 399))
    wanted = Counter((r["doc_id"], *brute_force(r["text"], counts, 400)) for r in rows)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(remove_repeats(docs)))
    assert got == wanted
    assert any(w[2] for w in wanted)


def test_empty_table(spark):
    assert remove_repeats(nothing(spark)).count() == 0
