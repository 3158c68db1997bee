"""A table whose merges touch only the buckets that hold changed rows.

Rows lie in a fixed number of buckets by a hash of their key. A merge reads and rewrites the buckets
that its new rows fall in, into a folder of its own, and then adds one entry to the log, which
names the folder of every bucket. Readers follow the newest entry, so a job that ends halfway changes
nothing, files of other buckets stay as they are, and earlier versions can be read until they are swept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another merge was committed meanwhile."""


class Buckets:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The newest version; 0 where there is none."""
        found = self._fs.globStatus(self._jvm.Path(f"{self.path}/log/*.json"))
        return max((int(f.getPath().getName()[:-5]) for f in found or []), default=0)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.last() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/log/{version:012d}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.folders(version).values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """The next version: how(old, new) of the touched buckets' rows in place of these. `how` must keep rows within their keys."""
        version, present = self.last(), self.folders()
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        if not touched:
            return version
        old = self._rows(present[b] for b in touched if b in present)
        commit = f"data/{uuid.uuid4().hex}"
        made = how(old, new).withColumn("bucket_", self._bucket())
        made.repartition(len(touched), "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{commit}")
        there = self._fs.globStatus(self._jvm.Path(f"{self.path}/{commit}/bucket_=*"))
        own = {int(f.getPath().getName().split("=")[1]): f"{commit}/{f.getPath().getName()}" for f in there or []}
        if extra := set(own) - set(touched):
            raise ValueError(f"the merge moved rows to other buckets: {sorted(extra)[:5]}")
        self._commit(version + 1, {b: f for b, f in (present | own).items() if b in own or b not in touched})
        return version + 1

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        """Writes the entry beside the log and renames it, which fails if the version is taken."""
        beside, entry = self._jvm.Path(f"{self.path}/log/.{uuid.uuid4().hex}"), self._jvm.Path(f"{self.path}/log/{version:012d}.json")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(entry) or not self._fs.rename(beside, entry):
            self._fs.delete(beside, False)
            raise Conflict(f"version {version} of {self.path} exists")

    def sweep(self, keep: int = 1) -> int:
        """Deletes what the newest `keep` versions do not name: folders of failed merges and of earlier versions. Returns their number."""
        last = self.last()
        named = {f for v in range(max(1, last - keep + 1), last + 1) for f in self.folders(v).values()}
        gone = 0
        for f in self._fs.globStatus(self._jvm.Path(f"{self.path}/data/*/bucket_=*")) or []:
            path = f.getPath()
            if f"data/{path.getParent().getName()}/{path.getName()}" not in named:
                gone += self._fs.delete(path, True)
        for v in range(1, last - keep + 1):
            self._fs.delete(self._jvm.Path(f"{self.path}/log/{v:012d}.json"), False)
        return gone
