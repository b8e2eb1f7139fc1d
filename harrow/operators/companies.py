"""Finding companies, filling them in, and attaching postings that name them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import normalize_company

from .graph import components
from .snapshot import cut

#: Keys of a company, the surest first.
KEYS = ("siren", "domain", "name_norm")


def find(probe: DataFrame, known: DataFrame) -> DataFrame:
    """``probe`` with ``found`` (a struct of the company) and ``way``: the first of KEYS that finds one, or ``new``.

    Each key is an equi-join with one row per key value, the smallest id, so the probe's rows are not multiplied.
    """
    fields = F.struct("company_id", *[c for c in known.columns if c != "company_id"])
    for key in KEYS:
        one = known.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min_by(fields, "company_id").alias(f"_{key}"))
        probe = probe.join(one, key, "left")
    way = F.coalesce(*[F.when(F.col(f"_{key}").isNotNull(), F.lit(key.removesuffix("_norm"))) for key in KEYS], F.lit("new"))
    found = F.coalesce(*[F.col(f"_{key}") for key in KEYS])
    return probe.withColumns({"found": found, "way": way}).drop(*[f"_{key}" for key in KEYS])


def attach_orphans(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """Postings without ``company_id`` take that of the company with their normalised name; none without a name.

    The equality of normalised names is all that decides, so accented names are found too.
    """
    names = known.filter("name_norm != ''").groupBy("name_norm").agg(F.min("company_id").alias("_found"))
    rows = jobs.withColumn("name_norm", normalize_company(F.col("company_name"))).join(names, "name_norm", "left")
    return rows.withColumn("company_id", F.coalesce("company_id", "_found")).drop("_found", "name_norm")


def attach_clusters(clusters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Clusters without ``company_id`` take the smallest one of their postings, as after ``attach_orphans``."""
    found = jobs.filter("cluster_id is not null and company_id is not null").groupBy("cluster_id").agg(F.min("company_id").alias("_found"))
    rows = clusters.join(found, "cluster_id", "left").withColumn("company_id", F.coalesce("company_id", "_found"))
    return rows.select(*(F.col(f"`{c}`") for c in clusters.columns))


class _Firms:
    """The companies of a component while its requests are replayed."""

    def __init__(self) -> None:
        self.rows: dict[int, dict] = {}
        self.by: dict[tuple[str, str], set[int]] = {}

    def put(self, company: int, **values: str | None) -> None:
        row = self.rows.setdefault(company, dict.fromkeys(KEYS))
        for key in KEYS:
            if values.get(key) and not row[key]:
                row[key] = values[key]
                self.by.setdefault((key, values[key]), set()).add(company)

    def ask(self, r: dict) -> tuple[str, int]:
        for key in KEYS:
            if r[key] and (known := self.by.get((key, r[key]))):
                company, way = min(known), key.removesuffix("_norm")
                break
        else:
            company, way = r["company_id"], "new"
        self.put(company, **{key: r[key] for key in KEYS})
        return way, company


def _replay(schema: pa.Schema):
    """Records sorted by component, kind and request (0: companies, 1: requests) -> answers (kind 1), then companies (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, firms, out = None, _Firms(), []
        standing = lambda: [{"kind": 0, "company_id": c, **row} for c, row in firms.rows.items()]
        for batch in batches:
            for r in batch.to_pylist():
                if r["component"] != name:
                    out += standing()
                    name, firms = r["component"], _Firms()
                if r["kind"] == 0:
                    firms.put(r["company_id"], **{key: r[key] for key in KEYS})
                else:
                    way, company = firms.ask(r)
                    out.append({"kind": 1, "request": r["request"], "way": way, "company_id": company, **firms.rows[company]})
            yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | o for o in out], schema)
            out = []
        yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | o for o in standing()], schema)

    return run


def find_or_create(requests: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, companies) after requests (request, siren, domain, name_norm), one after the other by their numbers.

    A request takes the first company of the smallest id that one of KEYS finds, and fills in what that lacks; else it
    creates one, which later requests find: its id is the request's number above the largest known id. Only requests that
    share keys, also by way of companies and other requests, depend on each other; such components are replayed by a
    function that holds their companies. ``answers``: request, ``way``, company_id and its keys by then, or ``way``
    refused for a request without a name. ``companies``: company_id and KEYS of all. Companies without any key stay as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    clean = lambda rows: rows.select("*").withColumns({key: F.nullif(F.col(key).cast("string"), F.lit("")) for key in KEYS})
    firms = clean(known.select("company_id", *KEYS))
    after = F.lit((known.agg(F.max("company_id")).first()[0] or 0) + 1)
    asked = clean(requests.select("request", *KEYS))
    good = asked.filter("name_norm is not null").withColumn("company_id", after + F.col("request"))
    rows = cut(firms.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("request"), "company_id", *KEYS).unionByName(
        good.select(F.lit(1).alias("kind"), F.col("request").cast("long"), "company_id", *KEYS)), "firms")
    tag: list[Column] = [F.when(F.col(key).isNotNull(), F.concat(F.lit(f"{key}:"), key)) for key in KEYS]
    own = F.coalesce(*tag)
    edges = rows.select(own.alias("a"), F.explode(F.array_compact(F.array(*tag))).alias("b")).filter("a is not null")
    groups = components(edges).withColumnRenamed("node", "own")
    out = good.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("request"), F.lit("").alias("way"), F.col("company_id").cast("long").alias("company_id"), *KEYS).schema
    placed = rows.withColumn("own", own).join(groups.hint("merge"), "own").repartition("component").sortWithinPartitions("component", "kind", "request", "company_id")
    done = cut(placed.select("component", *rows.columns).mapInArrow(_replay(to_arrow_schema(out)), out.simpleString()[7:-1].replace(":", " ")), "firms")
    refused = asked.filter("name_norm is null").select(F.col("request").cast("long").alias("request"), F.lit("refused").alias("way"), F.lit(None).cast("long").alias("company_id"), *KEYS)
    answers = done.filter("kind = 1").select("request", "way", "company_id", *KEYS).unionByName(refused)
    keyless = firms.filter(" and ".join(f"{key} is null" for key in KEYS)).select("company_id", *KEYS)
    return answers, done.filter("kind = 0").select("company_id", *KEYS).unionByName(keyless)
