"""Keyed tables over Parquet: rows in buckets by key, changed by writing the touched buckets anew and committing a manifest.

A table is a folder: data/ holds the files of each change, a folder for each bucket in it; commits/ holds a manifest for each version, which names the
folder that each bucket has. A change reads and writes only the buckets that its rows fall into, puts each together again as few files
(so small files never pile up), and counts once its manifest is there, created in one step and never replaced: a change that dies before leaves files that nothing
names, one that comes second to another fails and may be tried again. A reader has the version that it began with.

Changes carry a name and a number (such as a stream's and its batch's): one whose number the table has seen does nothing, so a batch may be replayed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.overrides import latest_by


#: Rows of a bucket that one task writes; a bucket of more is written by several, each a file.
FILE_ROWS = 500_000


class Conflict(RuntimeError):
    """Another change was committed first."""


class KeyedTable:
    """Rows of schema under path, one for each value of keys; by are the columns (of the key, or that a key's rows share) that tell the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, by: list[str] | None = None) -> None:
        self.spark, self.path, self.schema, self.keys, self.by = spark, path.rstrip("/"), schema, keys, by or keys
        self.columns = spark.createDataFrame([], schema).columns
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self.manifest().get("n", buckets)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names("commits") if x.endswith(".json") and x[0] != "."]

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the newest, if none is named) is made of: {version, n, buckets: {bucket: folder}, seen: {name: number}}."""
        found = self.versions()
        if not found:
            return {"version": 0, "buckets": {}, "seen": {}}
        stream = self._fs.open(self._path(f"{self.path}/commits/{version or found[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        target = self._path(f"{self.path}/commits/{manifest['version']:012d}.json")
        text = json.dumps(manifest).encode()
        draft = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(text)
        stream.close()
        # a rename onto a name that is taken fails, so a version is whole once it can be seen, and has one writer
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{x}" for x in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(sorted(self.manifest(version)["buckets"].values()))

    def seen(self, name: str) -> int:
        """The number of the last change of that name; -1 for none."""
        return self.manifest()["seen"].get(name, -1)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # as many as the table has buckets

    def read_buckets(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the buckets that rows (with the columns that tell one) fall into: what a look-up has to read."""
        held = self.manifest()["buckets"]
        return self._rows([held[str(b)] for b in self.buckets_of(rows) if str(b) in held])

    def change(self, touching: DataFrame, make: Callable[[DataFrame], DataFrame], name: str | None = None, number: int = 0) -> bool:
        """Put make(rows held) in the place of the buckets that touching's rows fall into. False if the table has seen that change."""
        before = self.manifest()
        if name is not None and before["seen"].get(name, -1) >= number:
            return False
        touched = self.buckets_of(touching)
        held = self._rows([before["buckets"][str(b)] for b in touched if str(b) in before["buckets"]])
        folder = f"{before['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        if touched:
            rows = make(held).select(*self.columns).withColumn("bucket", self._bucket())
            most = held.count() + touching.count()  # the first by the files' footers
            part = F.pmod(F.xxhash64(*self.keys, F.lit(7)), F.lit(-(-most // (len(touched) * FILE_ROWS)) or 1))
            rows.repartition("bucket", part).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        made = {x.removeprefix("bucket="): f"{folder}/{x}" for x in self._names(f"data/{folder}") if x.startswith("bucket=")}
        if not set(map(int, made)) <= set(touched):
            raise ValueError("a change made rows of buckets that it doesn't touch")
        buckets = {b: x for b, x in before["buckets"].items() if int(b) not in touched} | made
        seen = before["seen"] | ({} if name is None else {name: number})
        self._commit({"version": before["version"] + 1, "n": self.buckets, "buckets": buckets, "seen": seen})
        return True

    def upsert(self, rows: DataFrame, *order: Column, name: str | None = None, number: int = 0) -> bool:
        """Put rows in their keys' place; of rows with one key the last by order counts."""
        rows = rows.select(*self.columns)
        new = latest_by(rows, self.keys, *(order or [F.lit(0)]))
        return self.change(rows, lambda held: held.join(new.select(*self.keys), self.keys, "left_anti").select(*self.columns).unionByName(new), name, number)

    def insert_new(self, rows: DataFrame, *order: Column, name: str | None = None, number: int = 0) -> bool:
        """Add the rows whose key the table lacks; of rows with one key the first by order counts."""
        rows = rows.select(*self.columns)
        new = _first_by(rows, self.keys, *(order or [F.lit(0)]))
        return self.change(rows, lambda held: held.unionByName(new.join(held.select(*self.keys), self.keys, "left_anti").select(*self.columns)), name, number)

    def delete(self, keys: DataFrame, name: str | None = None, number: int = 0) -> bool:
        """Drop the rows whose key (and what tells the bucket) is among keys."""
        return self.change(keys, lambda held: held.join(keys.select(*self.keys).distinct(), self.keys, "left_anti"), name, number)

    def vacuum(self, keep: int = 1) -> int:
        """Delete what only older versions than the last keep name, and what no version does. The number of folders that went."""
        versions = self.versions()
        kept = versions[-keep:]
        needed = {x.split("/")[0] for v in kept for x in self.manifest(v)["buckets"].values()}
        gone = [x for x in self._names("data") if x not in needed]
        for x in gone:
            self._fs.delete(self._path(f"{self.path}/data/{x}"), True)
        for v in versions[: -keep or None]:
            self._fs.delete(self._path(f"{self.path}/commits/{v:012d}.json"), False)
        return len(gone)


def _first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
