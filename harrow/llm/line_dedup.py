"""Line dedup by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens. Tokens with digits are
variable fields (``<*>``) everywhere. In a leaf that several documents reach, a token stays part of a line's
template if enough documents have it at that position of the leaf; every other token is a variable field. So lines
that differ in their fields get one template, and one leaf can hold several. A template that enough documents
share and that is mostly constant is boilerplate: its lines are dropped. So are lines that enough documents have as
they are, whatever their fields. A line with fewer tokens than the tree is deep has a leaf of its own.

``LONG_ONLY`` are options of a narrower rule: lines of four tokens and more, by their templates alone.

The texts are read and split once; every later step reads the columns that it needs of that table of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SPACE = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
#: Leading tokens on the way to a leaf; lines with fewer tokens than MIN_TOKENS are never dropped.
DEPTH, MIN_TOKENS = 3, 1
#: Documents that must share a token or a template, and the least share of constant tokens in a template.
MIN_DOCS, CONSTANT = 5, 0.6
#: Are lines dropped that enough documents have as they are, whatever their template?
UNMASKED = True
LONG_ONLY = {"min_tokens": 4, "unmasked": False}


def plain_line(line: Column) -> Column:
    """The line's tokens with one space between them. Most lines are so but for their ends, which needs no pattern."""
    other = line.contains("  ")
    for blank in "\t\x0B\x0C\r":
        other = other | line.contains(blank)
    return F.trim(F.when(other, F.regexp_replace(line, SPACE, " ")).otherwise(line))


def masked(plain: Column) -> Column:
    """A plain line where a token with a digit is a variable field."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """id, ``h`` (hash of the whole text), ``pos``, ``line`` (masked), ``key`` of line, ``leaf``; ``exact``: hash of
    the line with its fields as they are, or null if it has none."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the hash is made below the split, once for each text
    texts = texts.select("id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("raw"))
    # a text has one line at least; the outer form spares Spark a test that splits every text once more
    rows = texts.select("id", "h", F.posexplode_outer("raw").alias("pos", "raw"))
    # blank lines are told by their first character that is not blank, before any line is rewritten
    rows = rows.filter(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select("id", "h", "pos", plain_line(F.col("raw")).alias("plain"))
    rows = rows.select("id", "h", "pos", "plain", masked(F.col("plain")).alias("line"))
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "))) + 1
    rows = rows.select(
        "id",
        "h",
        "pos",
        "line",
        F.when(F.col("plain") != F.col("line"), F.xxhash64("plain", F.lit(1))).alias("exact"),
        F.xxhash64("line").alias("key"),
        F.xxhash64(n, F.substring_index("line", " ", depth)).alias("leaf"),
        n.alias("n"),
    )
    # without the test the rewriting of a line is not repeated in a filter below it
    return (rows.filter(F.col("n") >= min_tokens) if min_tokens > 1 else rows).drop("n")


def _shared(rows: DataFrame, name: str, min_docs: int) -> DataFrame:
    """The values of column ``name`` that ``min_docs`` different texts have; equal texts count once.

    Both groupings combine before they shuffle, so a value in every document is a row per task. The result is
    written: its size is known to the join that reads it, which is then broadcast or split where it is skewed.
    """
    docs = rows.select(name, "h").distinct().groupBy(name).agg(F.count(F.lit(1)).alias("docs"))
    return stored(docs.filter(F.col("docs") >= min_docs).select(name), f"shared-{name}")


def recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_tokens: int = MIN_TOKENS,
    min_docs: int = MIN_DOCS,
    constant: float = CONSTANT,
    unmasked: bool = UNMASKED,
) -> DataFrame:
    """Rows of ``id``, ``h`` and ``pos`` for the lines to drop; one that goes for both reasons may come twice."""
    lines = stored(_lines(docs, id_col, text_col, depth, min_tokens), "lines")
    place = ["id", "h", "pos"]
    held = lines.join(_shared(lines, "leaf", min_docs), "leaf", "left_semi")
    variants = held.groupBy("leaf", "key", "h").agg(F.first("line").alias("line"))
    variants = variants.groupBy("leaf", "key").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("docs"))
    variants = stored(variants, "variants")
    tokens = variants.select("leaf", "key", "docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    common = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support"))
    common = common.filter((F.col("support") >= min_docs) & (F.col("token") != FIELD)).select("leaf", "at", "token")
    common = stored(common.withColumn("kept", F.lit(True)), "common")
    parts = tokens.join(common, ["leaf", "at", "token"], "left").select(
        "leaf", "key", F.struct("at", F.when(F.col("kept"), F.col("token")).otherwise(FIELD).alias("token")).alias("part"), F.col("kept").isNotNull().alias("fixed")
    )
    # a variant's list is as long as one line; a template is named by its leaf and a hash
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["token"]), " ")
    templates = parts.groupBy("leaf", "key").agg(F.xxhash64(joined).alias("template"), F.avg(F.col("fixed").cast("double")).alias("share"))
    templates = stored(templates.filter(F.col("share") >= constant).select("leaf", "key", F.xxhash64("leaf", "template").alias("template")), "templates")
    placed = stored(held.select(*place, "leaf", "key").join(templates, ["leaf", "key"]).select(*place, "template"), "placed")
    drops = placed.join(_shared(placed, "template", min_docs), "template", "left_semi").select(*place)
    if not unmasked:
        return drops
    # an equal line without fields is constant everywhere, so only lines with fields are left
    fields = lines.filter("exact is not null").select(*place, "exact")
    same = fields.join(_shared(fields, "exact", min_docs), "exact", "left_semi").select(*place)
    return drops.unionByName(same)


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_dropped`` and ``text`` without the dropped lines.

    Lines end at line feeds. A line is dropped if its template is shared by ``min_docs`` documents with different
    texts (copies of one document count once) and at least ``constant`` of its tokens are constant; lines with
    fewer than ``min_tokens`` tokens, blank ones too, stay. With ``unmasked`` a line also goes if so many documents
    have it with its fields as they are. Null and empty texts are one empty line and stay empty; a text of any
    length is one row. Nothing depends on order, so there are no ties. Repeated rows and null ids stay rows of their
    own; other columns are ignored; an empty table gives an empty result. Lines, leaves and templates are told
    apart by 64-bit hashes.
    """
    drops = recurring_lines(docs, id_col, text_col, **options)
    # a list of positions is as long as one document's lines
    drops = drops.groupBy("id", "h").agg(F.collect_set("pos").alias("dropped"))
    drops = drops.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    joined = rows.join(drops, rows["id"].eqNullSafe(drops["_id"]) & (rows["h"] == drops["_h"]), "left")
    lines = F.split("text", "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")))
    text = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    return joined.withColumn("lines", lines).select(
        F.col("id").alias(id_col),
        F.size("lines").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(text).alias("text"),
    )
