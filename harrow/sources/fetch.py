"""Listings that are fetched by windows of time, as a Spark source: ``spark.read`` and ``spark.readStream`` of ``listings``.

An adapter names what it can fetch, and fetches one source's items of a window, saying whether the answer is complete.
Each window of each source is a partition. A stream's offset is the cursor of every source: a batch fetches from a day
before the cursor, as items appear late, up to what the source has now; the cursor moves only if that fetch is complete.
``deduplicated`` drops what the overlap brings again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, external_id string, created timestamp, body string"
OVERLAP = timedelta(days=1)
BEGIN = "1970-01-01T00:00:00"


@dataclass(frozen=True)
class Window(InputPartition):
    """What one task fetches: items of a source created after ``since`` and up to ``until``."""

    source_id: str
    since: str
    until: str


class FolderAdapter:
    """Stands for an HTTP interface: a folder per source in any store that pyarrow opens, a file per answer.

    A file is ``{"complete": bool, "items": [{"id", "created", ...}]}``; ``created`` is ISO time in UTC without a zone. An
    answer that is not JSON, or has no items, counts as an incomplete one without items.
    """

    def __init__(self, uri: str):
        self.uri = uri

    def _answers(self, source: str | None = None) -> Iterator[tuple[str, dict]]:
        store, root = pyarrow.fs.FileSystem.from_uri(self.uri)
        for info in store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)):
            own = info.path.rsplit("/", 2)[-2]
            if info.is_file and info.base_name.endswith(".json") and source in (None, own):
                try:
                    answer = json.loads(store.open_input_stream(info.path).read())
                    items = [i for i in answer["items"] if i.get("id") is not None and i.get("created")]
                    yield own, {"complete": bool(answer.get("complete")), "items": items}
                except (ValueError, KeyError, TypeError, AttributeError):
                    yield own, {"complete": False, "items": []}

    def state(self) -> dict[str, tuple[str, bool]]:
        """Source -> the newest item's time, and whether all of its answers are complete."""
        found: dict[str, tuple[str, bool]] = {}
        for source, answer in self._answers():
            newest, complete = found.get(source, (BEGIN, True))
            found[source] = max([newest, *(i["created"] for i in answer["items"])]), complete and answer["complete"]
        return found

    def items(self, window: Window) -> Iterator[dict]:
        for _, answer in self._answers(window.source_id):
            yield from (i for i in answer["items"] if window.since < i["created"] <= window.until)


def _rows(adapter: FolderAdapter, window: Window) -> Iterator[pa.RecordBatch]:
    rows = [(window.source_id, str(i["id"]), datetime.fromisoformat(i["created"]), json.dumps(i, sort_keys=True)) for i in adapter.items(window)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source_id", "external_id", "created", "body"])


class _Reader(DataSourceReader):
    def __init__(self, adapter: FolderAdapter, since: str):
        self.adapter, self.since = adapter, since

    def partitions(self) -> list[Window]:
        return [Window(s, self.since, newest) for s, (newest, _) in sorted(self.adapter.state().items())] or [Window("", BEGIN, BEGIN)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return _rows(self.adapter, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are ``{"cursors": {source: time up to which all is fetched}, "seen": {source: newest time fetched}}``."""

    def __init__(self, adapter: FolderAdapter, since: str):
        self.adapter, self.since = adapter, since

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursors": {}, "seen": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        state = self.adapter.state()
        return {"cursors": {s: newest for s, (newest, complete) in state.items() if complete}, "seen": {s: newest for s, (newest, _) in state.items()}}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        found = []
        for source, until in sorted(end["seen"].items()):
            cursor = start["cursors"].get(source)
            if until > (cursor or "") or until > start["seen"].get(source, ""):
                since = (datetime.fromisoformat(cursor) - OVERLAP).isoformat() if cursor else self.since
                found.append(Window(source, since, until))
        return found

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return _rows(self.adapter, partition)


class Listings(DataSource):
    """``listings``: options ``path`` (a folder of answers) and ``since`` (ISO time; the first window begins after it)."""

    @classmethod
    def name(cls) -> str:
        return "listings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(FolderAdapter(self.options["path"]), self.options.get("since", BEGIN))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(FolderAdapter(self.options["path"]), self.options.get("since", BEGIN))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session; executors need this package."""
    spark.dataSource.register(Listings)


def deduplicated(items: DataFrame, overlap: str = "2 days") -> DataFrame:
    """Items once for each source and id: whole tables by their first, streams within the watermark."""
    if items.isStreaming:
        return items.withWatermark("created", overlap).dropDuplicatesWithinWatermark(["source_id", "external_id"])
    first = items.groupBy("source_id", "external_id").agg(F.min_by(F.struct("created", "body"), "created").alias("v"))
    return first.select("source_id", "external_id", "v.*")
