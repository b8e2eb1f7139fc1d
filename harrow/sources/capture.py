"""Pages that a user pushes as postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import keys, web
from harrow.functions.text import page_title

# The lengths of a text and of a page's title that are accepted.
LEAST, MOST, TITLE = 50, 200_000, 500


def received(pushes: DataFrame, known: DataFrame, keep: list[str]) -> DataFrame:
    """``pushes`` (url, page_title, text and the columns ``keep``) with ``errors``, ``outcome``, ``external_id``, ``title``.

    ``refused`` pushes have errors; ``duplicate`` ones a known id, or that of an earlier push by the columns ``keep``; the
    others are ``new`` and go through the same steps as every posting, as advisory ones.
    """
    valid = {
        "url": F.coalesce(F.col("url").rlike("(?i)^https?://[^/?#]+"), F.lit(False)),
        "title": F.length(F.coalesce("page_title", F.lit(""))) <= TITLE,
        "text": F.coalesce(F.length("text").between(LEAST, MOST), F.lit(False)),
    }
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in valid.items()]))
    rows = pushes.select(*keep, errors.alias("errors"), keys.capture_id(web.canonical_url(F.col("url"))).alias("external_id"), page_title(F.col("page_title")).alias("title"))
    rows = rows.withColumn("external_id", F.when(F.size("errors") == 0, F.col("external_id")))
    first = rows.filter("external_id is not null").groupBy("external_id").agg(F.min(F.struct(*keep)).alias("_first"))
    rows = rows.join(known.distinct().withColumn("_known", F.lit(True)), "external_id", "left").join(first, "external_id", "left")
    again = F.col("_known").isNotNull() | (F.col("_first") != F.struct(*keep))
    outcome = F.when(F.size("errors") > 0, "refused").when(again, "duplicate").otherwise("new")
    return rows.withColumn("outcome", outcome).drop("_known", "_first")
