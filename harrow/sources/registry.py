"""What is known of each kind of source, and the files that list sources and criteria."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feeds
from .boards import board_of


@dataclass(frozen=True)
class Adapter:
    """How often a kind may be asked, whether one answer lists everything, the pause per host, and its payloads' reader."""

    drafts: Callable[..., DataFrame]
    complete: bool
    interval_minutes: int = 360
    least_minutes: int = 180
    pause_ms: dict[str, int] = field(default_factory=dict)


# Intervals and pauses that the vendors ask for.
ADAPTERS = {
    "greenhouse": Adapter(feeds.greenhouse, True, pause_ms={"boards-api.greenhouse.io": 500}),
    "lever": Adapter(feeds.lever, True, pause_ms={"api.lever.co": 500, "api.eu.lever.co": 500}),
    "ashby": Adapter(feeds.ashby, True, pause_ms={"api.ashbyhq.com": 500}),
    "smartrecruiters": Adapter(feeds.smartrecruiters, True),
    "recruitee": Adapter(feeds.recruitee, True),
    "teamtailor": Adapter(feeds.teamtailor, True),
    "france_travail": Adapter(feeds.france_travail, False, least_minutes=120, pause_ms={"api.francetravail.io": 150}),
    "jobicy": Adapter(feeds.jobicy, False, least_minutes=360),
}
#: Kinds of boards, the most trusted sources; ``capture`` has no adapter, as its postings are pushed.
BOARDS = ("greenhouse", "lever", "ashby", "smartrecruiters", "recruitee", "teamtailor")


def adapters(spark: SparkSession) -> DataFrame:
    """The registry as a small table: kind, complete, interval_minutes, least_minutes, is_board."""
    rows = [(kind, a.complete, a.interval_minutes, a.least_minutes, kind in BOARDS) for kind, a in ADAPTERS.items()]
    return spark.createDataFrame(rows, "kind string, complete boolean, interval_minutes int, least_minutes int, is_board boolean")


SEED = "boards array<struct<url:string,company:string>>, feeds array<struct<id:string,kind:string,label:string,config:map<string,string>>>"


def seed(file: DataFrame, known: DataFrame) -> DataFrame:
    """Sources of a seed file (rows of ``value``: its JSON) that are not known yet: source_id, kind, label, config.

    Boards are given by their address; one whose vendor is not known is left out, and of repeated ids the first stays.
    """
    parsed = file.select(F.from_json("value", SEED).alias("s"))
    board = parsed.select(F.posexplode("s.boards").alias("at", "b")).withColumn("d", board_of(F.col("b.url"))).filter("d is not null")
    board = board.select("at", "d.source_id", "d.kind", F.coalesce("b.company", "d.slug").alias("label"), "d.config")
    feed = parsed.select(F.posexplode("s.feeds").alias("at", "f"))
    feed = feed.select((F.col("at") + (1 << 20)).alias("at"), F.col("f.id").alias("source_id"), "f.kind", F.coalesce("f.label", "f.id").alias("label"), "f.config")
    rows = board.unionByName(feed.filter("source_id is not null"))
    first = rows.groupBy("source_id").agg(F.min_by(F.struct("kind", "label", "config"), "at").alias("s")).select("source_id", "s.*")
    return first.join(known.select("source_id"), "source_id", "left_anti")


def clamped_interval(kind: Column, minutes: Column) -> Column:
    """An interval that is not below what the kind's vendor asks for."""
    floor = F.create_map(*[F.lit(x) for k, a in ADAPTERS.items() for x in (k, a.least_minutes)])
    return F.greatest(minutes, F.coalesce(F.try_element_at(floor, kind), F.lit(60)))


def half_windows(items: DataFrame, time: str, start: Column, end: Column, most: int, depth: int = 4) -> DataFrame:
    """Rows of ``start``, ``end``, ``n``: the window halved, at most ``depth`` times, wherever it holds more than ``most`` items.

    Both halves have their common moment, as both ask for it; what that repeats is removed by id later.
    """
    spark = items.sparkSession
    windows = spark.range(1).select(start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end"))
    for level in range(depth + 1):
        held = F.col(time).between(F.col("start"), F.col("end"))
        # the windows are at most 2 ** depth rows
        counts = windows.join(items.select(time), held, "left").groupBy("start", "end").agg(F.count(time).alias("n"))
        if level == depth:
            return counts
        middle = F.timestamp_micros(F.floor((F.unix_micros("start") + F.unix_micros("end")) / 2))
        halves = F.array(F.struct(F.col("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end")))
        whole = F.array(F.struct("start", "end"))
        windows = counts.select(F.explode(F.when(F.col("n") > most, halves).otherwise(whole)).alias("w")).select("w.start", "w.end")
