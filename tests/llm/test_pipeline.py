"""The pipeline as a whole against a brute-force version, and on awkward and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log, log2

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from harrow.llm import quality, queries
from harrow.llm.tokenizers_io import vocabulary_path

from .samples import rows_of
from .test_mixing import targets_by_hand
from .test_near_dedup import shingles
from .test_quality import brute_kneser_ney

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, size long, row string"
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def fixture():
    rng = random.Random(2)
    words = "the of and to in is that for it was on are as with they be at one have this from had by word but".split()
    rows = []
    for i in range(60):
        rows.append([i, " ".join(rng.choice(words) for _ in range(rng.randrange(40, 70))), "en", ("a", "a", "a", "b", None)[i % 5]])
    near = rows[3][1].split()
    near[20] = "changed"
    rows += [[60, " ".join(near), "en", "b"], [61, rows[5][1] + " ", "en", "b"], [62, rows[5][1], "en", "a"], rows[7], [7, rows[8][1], "en", "b"]]
    rows += [[63, "#$%zq0x1j9{}|" * 60, "en", "a"], [64, None, None, None], [65, "", "xx", "b"], [None, "no id but some words here", None, "c"], [4, "#$zq|" * 90, "en", "a"]]
    return [(*r, i, 1, 2, 3, "clash") for i, r in enumerate(rows)]


def by_hand(spark, rows, labels):
    """(doc_id, times) of what the first four stages leave."""
    # quality
    parts = {r["id"]: r["part"] for r in quality.trusted_ids(labels).collect()}
    probability = brute_kneser_ney([r[1] for r in rows if parts.get(r[0], 0) and r[1]])
    known = {}

    def bits(text):
        padded = "\n" * (quality.ORDER - 1) + text
        each = []
        for i in range(len(text)):
            gram = padded[i : i + quality.ORDER]
            known[gram] = known.get(gram) or -log2(probability(gram))
            each.append(known[gram])
        return np.mean(each), np.std(each) / len(each) ** 0.5

    scores = [bits(r[1]) if r[1] else None for r in rows]
    held = [(r[2], round(s[0], 3)) for r, s in zip(rows, scores, strict=True) if s and parts.get(r[0]) == 0]
    middle, outer = np.percentile([b for _, b in held], [50, 100 * quality.OUTER])
    limit = {lang: np.median([b for x, b in held if x == lang]) + quality.REACH * (outer - middle) for lang, _ in held}
    rows = [r for r, s in zip(rows, scores, strict=True) if not (s and r[2] in limit and s[0] - quality.DOUBT * s[1] > limit[r[2]])]
    # exact
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[ \t-\r]", "", r[1] or ""), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    # near
    sets = [shingles(r[1], 5) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None) for g, r in zip(group, rows, strict=True) if r[0] is not None}
    rows = [r for r, g in zip(rows, group, strict=True) if g not in least or r[0] == least[g]]
    # mixing
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    targets = targets_by_hand(sizes)
    taken = Counter()
    for source, target in targets.items():
        inside = []
        for r in rows:
            if r[3] == source:
                digits = hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13]
                text = r[1] or ""
                weight = 0.75 + 0.25 * sum(c.isalpha() for c in text) / max(len(text), 1)
                inside.append((-log((int(digits, 16) + 0.5) / 2**52) / weight, r[0], len(text.split())))
        epochs = min(int(target // sizes[source]), 3) if sizes[source] else 0
        rest, before = target - epochs * sizes[source], 0
        for _, i, n in sorted(inside, key=lambda x: x[0]):
            taken[i] += epochs + (n > 0 and before + n / 2 <= rest)
            before += n
    return +taken


def test_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60) if i != 4] + [(63, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    wanted = by_hand(spark, rows, labels)
    assert not {5, 60, 62, 63} & wanted.keys()  # 61 is longer than 5 and 62
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    firsts = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert firsts == wanted
    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts, sequences = {}, {}
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        texts.setdefault(r[0], []).append(np.array(ids, "<u4"))
    for r in got:
        pieces = [ids[r["start"] : r["start"] + r["length"]] for ids in texts[r["doc_id"]]]
        assert r["ids_crc32"] in [zlib.crc32(p.tobytes()) for p in pieces if len(p) == r["length"]]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


@pytest.mark.parametrize("rows", [[], fixture()[60:]])
def test_empty_and_awkward_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == COLUMNS, name
    assert (corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).count() > 0) == bool(rows)


def test_stages_pass_columns_of_any_name(spark, tmp_path):
    extra = [c for c in ("a.b", "carried", "rank", "_id", "mark", "c`d", "target") if c not in COLUMNS]
    rows = [(*r, *("x" * len(extra))) for r in fixture()[:12]]
    spark.createDataFrame(rows, ", ".join([SCHEMA, *("`" + c.replace("`", "``") + "` string" for c in extra)])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == [*COLUMNS, *extra], name
    assert corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).count() > 0


def test_all_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")) == list(range(1, 14))
