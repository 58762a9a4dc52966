"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or what setCheckpointDir() was given.

    Where neither is set, a local master takes a temporary folder (driver and executors are one process there); a cluster gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="interlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing uses any more; it does so only when the driver collects its garbage.

    Python tells the driver's JVM of objects that are gone a little later, and Spark's listeners hold on to the query that ended
    last until they hear of another, so it takes a few rounds, each with a small query.
    """
    gc.collect()
    for _ in range(4):
        time.sleep(0.4)
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most, so that Python objects of few rows live at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def by_batch(fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: pa.Schema):
    """For mapInArrow: call fn on each batch; it returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return run


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that clashing extra columns play no part."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds `nth`, each row's place from 0 in this order over all rows: range partitions, their counts, and a running number inside each."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.join(F.broadcast(counts), "part").withColumn("nth", (F.col("base") + inside).cast("long")).drop("part", "base")


class Documents:
    """Rows (doc_id, text) with a whole number `doc` of each document, in the order of doc_id.

    A document is a doc_id with a text: rows equal in both are one, rows of one doc_id with other texts several, in the order of a hash of their texts.
    Null ids come last (or first). Where doc_id is a whole number, never null and has one text each, doc is doc_id itself; else documents
    are numbered. `plain` tells which, `repeats` whether a doc_id stands in several rows.
    """

    def __init__(self, df: DataFrame, doc_id: str, text: str, *, nulls_first: bool = False, keep_row: bool = False):
        rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep_row else []))
        tagged = rows.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length("text")))
        whole = isinstance(rows.schema["doc_id"].dataType, IntegralType)
        # Counts of ids, not of texts, shuffle: 24 bytes a row.
        per_id = tagged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min("tag") != F.max("tag")).alias("differs"))
        found = per_id.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("repeats"), F.coalesce(F.bool_or(F.col("differs") | F.col("doc_id").isNull()), F.lit(False)).alias("odd")).first()
        self.repeats, self.plain = found["repeats"], whole and not found["odd"]
        if self.plain:
            self.rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))  # never null, so joins of all kinds read it alike
            return
        order = F.col("doc_id").asc_nulls_first() if nulls_first else F.col("doc_id").asc_nulls_last()
        self.names = checkpointed(numbered(tagged.select("doc_id", "tag").distinct(), order, F.col("tag").asc()).select(F.col("doc_id").alias("name"), F.col("tag").alias("own_tag"), F.col("nth").alias("doc")))
        both = tagged.join(self.names, tagged["doc_id"].eqNullSafe(self.names["name"]) & (F.col("tag") == F.col("own_tag")))
        self.rows = both.drop("tag", "own_tag", "name")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with these columns of document numbers turned into doc_ids again."""
        for c in () if self.plain else columns:
            names = self.names.select(F.col("doc").alias("own"), F.col("name"))
            df = df.join(names, df[c] == names["own"]).withColumn(c, F.col("name")).drop("own", "name")
        return df
