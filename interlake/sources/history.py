"""The history of a mailbox's changes as a stream whose offset is the history id, and the sync that follows it.

History pages are Parquet files of (history_id, message_id), written in ranges of history_id. A stream goes on behind the last id that it took in; after a
failure it reads the same range again. The provider forgets old history: `oldest` is the id from which on it is complete. A stream
that stands before that can't go on, and takes in the whole listing of messages instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from interlake.tables import Table

SCHEMA = "history_id long, message_id string, resync boolean"
ARROW = pa.schema([("history_id", pa.int64()), ("message_id", pa.string()), ("resync", pa.bool_())])


class Range(InputPartition):
    """The rows of a file with ids behind `after` up to `upto`."""

    def __init__(self, file: str, after: int, upto: int, resync: bool):
        self.file, self.after, self.upto, self.resync = file, after, upto, resync


class HistoryReader(DataSourceStreamReader):
    """Ranges of history ids; see HistorySource for the options."""

    def __init__(self, options: dict[str, str]):
        self.path, self.listing, self.cursor = options["path"], options.get("listing"), int(options.get("cursor", 0))
        self.known: dict[str, tuple[int, int]] = {}

    def _files(self) -> dict[str, tuple[int, int]]:
        """Each page's least and largest id, from its footer; footers are read once."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.path.endswith(".parquet") and info.path not in self.known:
                with fs.open_input_file(info.path) as source:
                    meta = pq.read_metadata(source)
                at = meta.schema.to_arrow_schema().get_field_index("history_id")
                ranges = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
                if ranges:
                    self.known[info.path] = (min(s.min for s in ranges), max(s.max for s in ranges))
        return self.known

    def _oldest(self) -> int:
        fs, root = pafs.FileSystem.from_uri(self.path)
        place = f"{root}/_oldest"
        if fs.get_file_info(place).type == pafs.FileType.NotFound:
            return 0
        with fs.open_input_stream(place) as source:
            return int(json.loads(source.read()))

    def initialOffset(self) -> dict:
        return {"history_id": self.cursor}

    def latestOffset(self) -> dict:
        return {"history_id": max([self.cursor, *(most for _, most in self._files().values())])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = start["history_id"], end["history_id"]
        if after >= upto:
            return []
        if after + 1 < self._oldest():
            if not self.listing:
                raise ValueError(f"the history from {after + 1} on is gone, and there is no listing to take instead")
            fs, root = pafs.FileSystem.from_uri(self.listing)
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            return [Range(i.path, -1, upto, True) for i in found if i.path.endswith(".parquet")]
        return [Range(f, after, upto, False) for f, (least, most) in sorted(self._files().items()) if most > after and least <= upto]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.listing if partition.resync else self.path)
        with fs.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=["history_id", "message_id"]):
                ids = batch.column(batch.schema.get_field_index("history_id"))
                inside = batch.filter(pc.and_(pc.greater(ids, partition.after), pc.less_equal(ids, partition.upto)))
                columns = [inside.column(inside.schema.get_field_index(c)) for c in ("history_id", "message_id")]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), columns[1].cast(pa.string()), pa.array([partition.resync] * inside.num_rows, pa.bool_())], schema=ARROW)


class HistorySource(DataSource):
    """spark.readStream.format("mail_history") with the options path (pages), cursor (last id taken in, 0), listing (folder of all messages, for a resync)."""

    @classmethod
    def name(cls) -> str:
        return "mail_history"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return HistoryReader(self.options)


def write_history(rows: DataFrame, path: str, *, pages: int = 8) -> None:
    """Append (history_id, message_id) to a folder of history pages, in ranges of history_id."""
    rows.select("history_id", "message_id").repartitionByRange(pages, "history_id").sortWithinPartitions("history_id").write.mode("append").parquet(path)


def forget_before(path: str, oldest: int) -> None:
    """Say that the history is complete from `oldest` on only."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(f"{root}/_oldest") as out:
        out.write(json.dumps(oldest).encode())


def sync_history(spark: SparkSession, path: str, into: Table, checkpoint: str, *, listing: str | None = None, cursor: int = 0) -> int:
    """Take in what is new since the last call: each message once, under the first history id at which it was seen. Returns the id taken in last.

    into: a table by message_id; its batches are numbered, so one that is repeated after a failure changes nothing. A resync adds every
    message of the listing that isn't known. Null message ids are left out.
    """
    spark.dataSource.register(HistorySource)
    options = {"path": path, "cursor": str(cursor)} | ({"listing": listing} if listing else {})
    stream = spark.readStream.format("mail_history").options(**options).load()

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.filter("message_id IS NOT NULL").groupBy("message_id").agg(F.min("history_id").alias("history_id"), F.bool_and("resync").alias("resync"))
        into.merge(rows, {"history_id": F.min, "resync": F.bool_and}, writer=checkpoint, number=number)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    ends = [re.search(r"\d+", str(s["endOffset"])) for p in query.recentProgress for s in p["sources"]]  # an offset's one number
    return max([cursor, *(int(e[0]) for e in ends if e)])
