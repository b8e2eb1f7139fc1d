"""Line dedup: lines of any length, equal lines whatever their fields, and the narrower rule."""

import re
from collections import Counter

import duckdb
import pytest

from harrow.llm import queries
from harrow.llm.line_dedup import LONG_ONLY, drop_recurring_lines

from .samples import awkward, nothing, rows_of


def test_short_and_digit_lines_go(spark):
    shared = ["All rights reserved.", "Les.", "Of, edti", "v1 2 3 4 build9", "2024"]
    rows = [(i, "\n".join([f"own{c} words{c}" for c in "abcdefg"[i]] + shared + [f"page {i} 77 8", ""])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(drop_recurring_lines(docs))}
    for i, r in got.items():
        c = "abcdefg"[i]
        assert r["n_dropped"] == 5 and r["text"] == f"own{c} words{c}\npage {i} 77 8\n"
    few = docs.filter("doc_id < 4")
    assert all(r["n_dropped"] == 0 for r in rows_of(drop_recurring_lines(few)))


def test_long_only(spark):
    shared = [f"Posted on day {i} by the editors of this paper" for i in range(6)]
    rows = [(i, f"own words of number{i} text alone{i} here\n{line}\nshort line") for i, line in enumerate(shared)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string")
    got = {r["doc_id"]: r for r in rows_of(drop_recurring_lines(docs, **LONG_ONLY))}
    assert all(r["n_lines"] == 3 and "Posted" not in r["text"] and r["text"].endswith("short line") for r in got.values())


def test_awkward(spark):
    docs = awkward(spark)
    assert drop_recurring_lines(docs).count() == docs.count()
    assert drop_recurring_lines(nothing(spark)).count() == 0


@pytest.mark.parametrize("name", ["op8_line_dedup", "line_dedup_long"])
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    wanted = sorted(con.execute(queries.ORACLE_SQL[name]).fetchall(), key=repr)
    got = queries.QUERIES[name](spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted


def test_by_hand_with_awkward_rows(spark):
    """Every text of the table, with repeats, nulls and a text of several MiB, against the rules in plain Python."""
    long = "\n".join(f"line {i} of a very long text with the number {i * 7}" for i in range(60_000))
    docs = awkward(spark, ["Shared by two\nand more", long, long + "\nend", *(f"head of page {i} stays here\ntail {i}" for i in range(7))])
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in rows_of(drop_recurring_lines(docs)))
    assert got == Counter(by_hand(rows_of(docs)))


def by_hand(rows, depth=3, least=5, constant=0.6):
    texts = {r["text"] or "" for r in rows}
    lines = {t: [(p, re.sub(r"[^ ]*[0-9][^ ]*", "<*>", p)) for p in (re.sub(r"[ \t-\r]+", " ", x).strip(" ") for x in t.split("\n"))] for t in texts}
    spread = lambda pairs: {k for k, n in Counter(k for k, _ in set(pairs)).items() if n >= least}
    leaf = lambda line: (len(line.split(" ")), tuple(line.split(" ")[:depth]))
    full = [(p, m, t) for t in texts for p, m in lines[t] if p]
    leaves = spread((leaf(m), t) for _, m, t in full)
    held = {(m, t) for _, m, t in full if leaf(m) in leaves}
    support = Counter((leaf(m), at, x) for m, _ in held for at, x in enumerate(m.split(" ")) if x != "<*>")

    def template(m):
        kept = [x if support[leaf(m), at, x] >= least else "<*>" for at, x in enumerate(m.split(" "))]
        return tuple(kept), sum(x != "<*>" for x in kept) / len(kept)

    templates = {m: template(m) for m, _ in held}
    shared = spread((templates[m][0], t) for m, t in held if templates[m][1] >= constant)
    same = spread((p, t) for p, _, t in full)
    gone = lambda p, m: p and (p in same or m in templates and templates[m][1] >= constant and templates[m][0] in shared)
    for r in rows:
        pairs = lines[r["text"] or ""]
        yield r["doc_id"], len(pairs), sum(bool(gone(p, m)) for p, m in pairs)
