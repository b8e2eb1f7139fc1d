"""From raw documents to packed training sequences, in five stages.

A stage is a function of (spark, docs, sf_dir). ``run`` writes each result as Parquet to the shared folder and
hands what it reads back to the next stage. All but the last return the columns of ``documents``, extra ones whatever
their names too. Texts of any length go through as one row each; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import exact_dedup, mixing, near_dedup, packing, quality
from harrow.llm.storage import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, fitted on the trusted ones of ``labels``, rejects go.

    Null and empty texts, and languages without trusted documents, stay. Each row has its own verdict, also where an
    id repeats or is null. A value at the limit stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text, white space aside, stays: the longest, then the smallest id.

    Null and empty texts are one group. Of rows equal in id and text one stays. A null id loses every tie.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 stays: the smallest id.

    Documents without words link to nothing and stay. A group without any id stays whole, as no row stands for it.
    """
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as often as the mix of sources takes them, three times at most.

    A null source is a source. Documents without words take part in complete epochs only. Reruns draw the same rows.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens.

    A null or empty text is a piece of its end token alone. Repeated rows are packed as often as they come.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language-model scores and tokens are beyond SQL; ``run`` is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
