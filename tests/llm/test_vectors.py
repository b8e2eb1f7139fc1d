"""Product codes and clusters against plain versions over whole small tables."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import queries
from harrow.llm.clustering import VantageTree, cluster
from harrow.llm.storage import discard
from harrow.llm.vector_codes import OWNER, entry_sums, migrated, nearest, owners, vector_codes
from harrow.session import table

from .samples import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, id int, x string, `a.b` int, sums long"


def sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def vectors(spark, n=300, width=64, seed=1):
    """Ties, repeated rows and ids, one vector that makes up a third, and all that must go."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(1000 + i, centres[0], 3) for i in range(n // 2)]
    rows += [rows[3], rows[3], (5, centres[1], 1), (None, centres[2], None), (None, centres[3], 2)]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.5] * (width - 1), 1), (9003, [math.nan] * width, 1)]
    rows += [(9004, [math.inf] + [0.0] * (width - 1), 1), (9005, [None] + [0.0] * (width - 1), 1), (9006, [-0.0] * width, None)]
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def whole(rows, scale, width):
    good = [r for r in rows if r["embedding"] is not None and len(r["embedding"]) == width and all(v is not None and math.isfinite(v) for v in r["embedding"])]
    return good, np.array([[math.floor(scale * v) for v in r["embedding"]] for r in good], np.int64)


def by_id(rows, x, key):
    return sorted(range(len(rows)), key=lambda i: (rows[i]["vec_id"] is None, key(rows[i]["vec_id"]), x[i].tolist()))


def plain_codes(rows):
    good, x = whole(rows, 256, 64)
    parts = x.reshape(len(x), 16, 4)
    books = parts[by_id(good, x, lambda i: i or 0)[:64]].transpose(1, 0, 2).copy()
    for last in (False, False, True):
        far = ((parts[:, :, None] - books[None]) ** 2).sum(3)
        code, error = far.argmin(2), far.min(2).sum(1)
        for p in range(16 if not last else 0):
            for e in set(code[:, p]):
                books[p, e] = parts[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    per = Counter()
    for r, e in zip(good, error, strict=True):
        per[r["label"]] += int(e)
    digest = sha(books.ravel().tolist())
    return Counter((r["vec_id"], bytes(c.tolist()).hex(), int(e), per[r["label"]], digest) for r, c, e in zip(good, code, error, strict=True))


def plain_clusters(rows, k=8, rounds=10):
    good, x = whole(rows, 1024, 64)
    order = by_id(good, x, lambda i: "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    points = x[order[:k]].copy()
    for last in [False] * rounds + [True]:
        far = ((x[:, None] - points[None]) ** 2).sum(2)
        label, error = far.argmin(1), far.min(1)
        for c in set(label) if not last else ():
            points[c] = x[label == c].sum(0) // (label == c).sum()
    total = [int(error[label == c].sum()) for c in range(len(points))]
    return Counter(
        (r["vec_id"], int(c), int(e), total[c], int(error.sum()), sha(points[c].tolist())) for r, c, e in zip(good, label, error, strict=True)
    )


@pytest.mark.parametrize(("run", "plain"), [(vector_codes, plain_codes), (cluster, plain_clusters)])
def test_against_plain_versions(spark, run, plain):
    for n in (300, 3):  # fewer vectors than entries or centroids, too
        docs = vectors(spark, n)
        assert Counter(tuple(r.values()) for r in rows_of(run(docs))) == plain(rows_of(docs))
    assert run(docs.limit(0)).count() == 0
    given = table(spark, "/root/testdata/sf0.001", "embeddings")
    assert Counter(tuple(r.values()) for r in rows_of(run(given))) == plain(rows_of(given))


def test_too_large_components_stop_the_job(spark):
    docs = spark.createDataFrame([(1, [1e30] * 64, 1)], "vec_id long, embedding array<double>, label int")
    for run in (vector_codes, cluster):
        with pytest.raises(Exception, match="is beyond"):
            run(docs)


def test_owners_add_up_without_a_shuffle_and_only_movers_are_shuffled(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (500, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<int>")
    books = [x[:6].reshape(6, 2, 4).transpose(1, 0, 2), x[6:12].reshape(6, 2, 4).transpose(1, 0, 2)]
    first = owners(rows, spark.sparkContext.broadcast(books[0]), 4, salts=3)
    plan = entry_sums(first, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # salts of an entry, after the owners' sums
    second = migrated(first, spark.sparkContext.broadcast(books[1]), 4)
    discard(first)
    got = {(r["position"], r["entry"]): r["n"] for r in entry_sums(second, 4).collect()}
    expected = Counter()
    for p in range(2):
        expected.update((p, int(e)) for e in nearest(x.reshape(500, 2, 4)[:, p], books[1][p])[0])
    assert got == expected
    homes = second.select(*OWNER, F.input_file_name().alias("file")).distinct().groupBy(*OWNER).agg(F.count("*").alias("files"))
    assert homes.agg(F.max("files")).first()[0] <= 2  # the one of those that stay and the one of those that came


def test_tree_search_equals_a_full_search():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 8, 64, 300):
        points, x = rng.integers(-5, 6, (k, 3)), rng.integers(-6, 7, (2000, 3))  # many equal points and ties
        label, best, taken = VantageTree.over(points).nearest(x)
        far = ((x[:, None] - points[None]) ** 2).sum(2)
        assert (label == far.argmin(1)).all() and (best == far.min(1)).all()
        assert taken <= 2000 * k
    assert taken < 2000 * k / 4  # most of a large tree is not looked at


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_clusters"])
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, folder).select(*names).collect()
    assert Counter(tuple(r) for r in got) == Counter(found.fetchall())
