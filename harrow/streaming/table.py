"""A table in hash buckets with versions: a step writes only the buckets that it touches.

``data/`` holds Parquet files by the step that wrote them and by bucket; ``versions/`` holds one manifest per version,
which names the folder of each bucket. A version counts once its manifest is there, and that comes by one rename after
all files: a step that dies before leaves the version before it as it was, and files that no manifest names, which the
next ``vacuum`` removes. Readers take one version, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class BucketTable:
    """Rows of ``schema`` in ``buckets`` by the hash of ``keys``; ``spread`` columns divide a large bucket among files.

    The last ``keep`` versions can be read. One writer at a time; a second writer of a version fails at the rename.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    spread: tuple[str, ...] = ()
    buckets: int = 64
    files: int = 8
    keep: int = 8

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}" if path else self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read."""
        return [int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json")]

    def has(self, number: int) -> bool:
        return number in self.versions()

    def manifest(self, number: int | None = None) -> dict[int, str]:
        """Bucket -> folder of a version, the last one by default; of none before the first."""
        known = self.versions()
        if not known:
            return {}
        fs, target = self._fs(f"versions/v{max(known) if number is None else number:010d}.json")
        stream = fs.open(target)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text)["buckets"].items()}

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows that have the key columns."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # as many as there are buckets at most

    def read(self, number: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """A version's rows, of ``only`` some buckets if given."""
        found = self.manifest(number)
        wanted = [f"{self.path}/{found[b]}/bucket={b}" for b in (found if only is None else only) if b in found]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def commit(self, number: int, rows: DataFrame, only: Iterable[int]) -> None:
        """Version ``number``: the last one with the buckets ``only`` replaced by ``rows``, which all lie in them."""
        only = list(only)
        old = self.manifest()
        folder = f"data/v{number:010d}-{uuid.uuid4().hex}"
        split = F.pmod(F.xxhash64(*self.spread), F.lit(self.files)) if self.spread else F.lit(0)
        placed = rows.select(*(f"`{f.name}`" for f in self.schema.fields)).withColumn("bucket", self.bucket())
        placed.repartition("bucket", split).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        there = {int(n.partition("=")[2]) for n in self._names(folder) if n.startswith("bucket=")}
        if strange := there - set(only):
            raise ValueError(f"rows of buckets {sorted(strange)} that this step does not replace")
        self._publish(number, {b: f for b, f in old.items() if b not in only} | dict.fromkeys(there, folder))

    def _publish(self, number: int, buckets: dict[int, str]) -> None:
        fs, draft = self._fs(f"versions/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": number, "buckets": buckets}).encode()))
        out.close()
        _, target = self._fs(f"versions/v{number:010d}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {number} is there already")

    def vacuum(self) -> None:
        """Removes versions before the last ``keep``, and files that no version left names."""
        known = self.versions()
        for number in known[: -self.keep]:
            fs, target = self._fs(f"versions/v{number:010d}.json")
            fs.delete(target, False)
        used = {folder for number in known[-self.keep :] for folder in self.manifest(number).values()}
        for name in self._names("data"):
            if f"data/{name}" not in used:
                fs, target = self._fs(f"data/{name}")
                fs.delete(target, True)

    def size(self, path: str = "") -> int:
        """Bytes of all versions, or of one folder."""
        fs, target = self._fs(path)
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0
