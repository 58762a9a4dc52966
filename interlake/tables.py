"""Keyed tables in a folder that batches change: only the buckets that a batch touches are written anew.

    folder/v3/bucket=17/part-....parquet      what version 3 wrote of bucket 17
    folder/_versions/00000003.json            which version each bucket is at, the schema, and the batches taken in

A row's bucket is a hash of its keys. A change writes the touched buckets as a new version, and then the list of what counts, in one
rename; so a reader sees the table before or after a change, and one that has begun goes on reading what it began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from interlake.operators.changes import first_per_key
from interlake.storage import checkpointed, file_system, remove


class Table:
    """A table of rows by `keys` (no nulls) in a folder that all executors see. One writer at a time: of two, the later to finish fails."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _state(self, version: int | None = None) -> dict:
        """What counts in the newest version, or the one asked for; without any an empty table without a schema."""
        fs, folder = file_system(self.spark, f"{self.path}/_versions")
        if not fs.exists(folder):
            return {"version": 0, "buckets": {}, "schema": None, "taken": {}, "count": self.buckets}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        name = names[-1] if version is None else f"{version:08d}.json"
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/_versions/{name}").collect()))

    @property
    def version(self) -> int:
        return self._state()["version"]

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of these buckets, or all; None of a table that was never written."""
        if state["schema"] is None:
            return None
        places = [f"{self.path}/v{v}/bucket={b}" for b, v in state["buckets"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or as it was in a version that vacuum() has left."""
        rows = self._rows(self._state(version))
        if rows is None:
            raise ValueError(f"{self.path} was never written")
        return rows

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(state["count"])).cast("int")

    def _commit(self, state: dict) -> None:
        fs, folder = file_system(self.spark, f"{self.path}/_versions")
        fs.mkdirs(folder)
        final = f"{self.path}/_versions/{state['version']:08d}.json"
        fs, place = file_system(self.spark, f"{self.path}/_versions/_{uuid.uuid4().hex}")
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, target = file_system(self.spark, final)
        if fs.exists(target) or not fs.rename(place, target):
            fs.delete(place, False)
            raise RuntimeError(f"{self.path} was changed by another writer")

    def _change(self, batch: DataFrame, make: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str | None, number: int | None) -> bool:
        state = self._state()
        if number is not None and state["taken"].get(writer or "", -1) >= number:
            return False
        batch = checkpointed(batch.withColumn("_bucket", self._bucket(state)))
        touched = sorted(r["_bucket"] for r in batch.select("_bucket").distinct().collect())  # as many as there are buckets at most
        old = self._rows(state, touched)
        rows = make(old, batch.drop("_bucket"))
        version = state["version"] + 1
        if touched:
            dealt = rows.withColumn("bucket", self._bucket(state)).repartition(max(1, len(touched)), "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")  # a part of an earlier try that failed goes
        there = {int(r["bucket"]) for r in self.spark.read.parquet(f"{self.path}/v{version}").select("bucket").distinct().collect()} if touched else set()
        buckets = {b: v for b, v in state["buckets"].items() if int(b) not in touched} | {str(b): version for b in there}
        taken = state["taken"] | ({writer or "": number} if number is not None else {})
        self._commit(state | {"version": version, "buckets": buckets, "schema": rows.schema.json(), "taken": taken})
        return True

    def upsert(self, batch: DataFrame, *order: str, writer: str | None = None, number: int | None = None) -> bool:
        """Put the batch's rows in place of those of the same keys; of several in the batch the first in the order given.

        number: a batch of this writer whose number isn't above those taken in changes nothing. Returns whether it was taken in.
        """
        one = first_per_key(batch.withColumn("_key", F.struct(*self.keys)), "_key", *(order or self.keys)).drop("_key")
        return self._change(one, lambda old, new: new if old is None else old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new), writer, number)

    def merge(self, batch: DataFrame, totals: dict[str, Callable[[str], Column]], *, writer: str | None = None, number: int | None = None) -> bool:
        """Combine the batch's rows with those of the same keys by an aggregate for each column (sum, min, max, ...); see upsert() for number."""

        def combined(old: DataFrame | None, new: DataFrame) -> DataFrame:
            rows = new if old is None else old.unionByName(new.select(*old.columns))
            return rows.groupBy(*self.keys).agg(*[f(c).cast(new.schema[c].dataType).alias(c) for c, f in totals.items()]).select(*self.keys, *totals)

        return self._change(batch.select(*self.keys, *totals), combined, writer, number)

    def replace(self, rows: DataFrame) -> None:
        """Truncate and insert, in one step; the rows may come from this very table."""
        state = self._state()
        version = state["version"] + 1
        rows.withColumn("bucket", self._bucket(state)).repartition(state["count"], "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        there = [r["bucket"] for r in self.spark.read.parquet(f"{self.path}/v{version}").select("bucket").distinct().collect()] if not rows.isEmpty() else []
        self._commit(state | {"version": version, "buckets": {str(b): version for b in there}, "schema": rows.schema.json()})

    def vacuum(self, keep: int = 2) -> None:
        """Remove files that none of the last `keep` versions counts."""
        fs, folder = file_system(self.spark, f"{self.path}/_versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        used = {(v, b) for name in names[-keep:] for b, v in self._state(int(name[:8]))["buckets"].items()}
        for name in names[:-keep]:
            remove(self.spark, f"{self.path}/_versions/{name}")
        fs, root = file_system(self.spark, self.path)
        for version in fs.listStatus(root):
            if version.getPath().getName().startswith("v"):
                for bucket in fs.listStatus(version.getPath()):
                    name = bucket.getPath().getName()
                    if name.startswith("bucket=") and (int(version.getPath().getName()[1:]), name[7:]) not in used:
                        fs.delete(bucket.getPath(), True)
