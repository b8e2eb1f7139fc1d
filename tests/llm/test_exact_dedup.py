import hashlib
import re

from harrow.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

from .samples import awkward, nothing, rows_of


def test_against_brute_force(spark):
    docs = awkward(spark)
    groups = {}
    for r in rows_of(docs):
        text = r["text"] or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), r["doc_id"] is None, r["doc_id"] or 0))
    got = rows_of(exact_duplicates(docs))
    assert len(got) == docs.count()
    wanted = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = wanted[r["text_sha256"]]
        best = min(members)
        keep = None if best[1] else best[2]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), r["doc_id"] == keep)


def test_empty_and_columns(spark):
    assert exact_duplicates(nothing(spark)).count() == 0
    docs = awkward(spark)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows_of(kept) if r["text"] and r["text"].startswith("one")) == [3, 4]


def test_one_row_of_each_group_stays(spark):
    """Rows equal in id and text, losing rows whose id wins elsewhere, null ids, and string ids."""
    rows = [(1, "a b"), (1, "a b"), (1, "long  text"), (2, "long text"), (2, "ab"), (None, "zz z"), (None, "zz z"), (3, "zzz"), (-(2**63), "q"), (0, "q")]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t, "row", 0) for i, t in rows], f"doc_id {kind}, text string, digest string, rank int")
        kept = rows_of(drop_exact_duplicates(docs))
        same = lambda i: i if i is None or kind == "long" else str(i)
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted(
            (str(same(i)), t) for i, t in [(1, "a b"), (1, "long  text"), (None, "zz z"), (-(2**63), "q")]
        )
        assert kept[0].keys() == {"doc_id", "text", "digest", "rank"}


def test_very_long_texts(spark):
    long = "many words " * 400_000
    docs = spark.createDataFrame([(1, long), (2, long + " "), (3, long + "x")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows_of(exact_duplicates(docs))) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
