"""Where long jobs keep what they have made: checkpoints and folders that the driver and all executors see."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_MADE: list[str] = []
#: Bytes of texts after which in_order_with_texts() hands on a batch.
BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir() was given; a local master without either takes a temporary folder, a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="interlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; clear() removes it."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.delete(place, True)


def clear(spark: SparkSession) -> None:
    """Remove the folders that new_folder() gave in this session; DataFrames that read them can't be used any more.

    Checkpoints go by Spark's own cleaner, with spark.cleaner.referenceTracking.cleanCheckpoints set to true.
    """
    while _MADE:
        remove(spark, _MADE.pop())


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again.

    For loops of many rounds: a checkpoint keeps what Spark knows of its columns' values, and that grows with each self-join.
    """
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in range partitions by this order, stored, with the partition's number in `part`, so that scans over any group can be split."""
    return checkpointed(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def running_sum(dealt: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`, the running sum of `value` inside each group of `by` in this order, of rows from dealt_in_order(by and order).

    What a group has in each partition is summed up first, so a group of any size is scanned by as many tasks as it has partitions.
    """
    sums = dealt.groupBy(*by, "part").agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(sums, [*by, "part"]).withColumn(name, F.col("_base") + F.sum(value).over(inside)).drop("_base")


def last_before(dealt: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`, the last `value` that isn't null in the group's rows before this one; scanned like running_sum()."""
    place = F.struct(*order)
    lasts = dealt.groupBy(*by, "part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_own"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*by, "part", F.last("_own", ignorenulls=True).over(before).alias("_base"))
    inside = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(lasts, [*by, "part"]).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_base"))).drop("_base")


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """Adds `nth`, each row's place from 0 in this order over all rows."""
    parts = dealt_in_order(df, *order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.join(F.broadcast(counts), "part").withColumn("nth", (F.col("base") + inside).cast("long")).drop("part", "base")


def in_order_with_texts(rows: DataFrame, texts: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """rows in this order in one task, each with `text` of those rows of `texts` that have its `key`, null without one.

    The task puts each text into a temporary file once, compressed, and takes it from there for every row that asks for it, so no
    shuffle and no sort holds a text as often as it is used.
    """
    row = F.struct(*rows.columns)
    kind = rows.select(row.alias("_row")).schema["_row"].dataType
    known = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), text, F.lit(None).cast(kind).alias("_row"))
    both = known.unionAll(rows.select(F.col(key).alias("_key"), F.lit(None).cast("string").alias(text), row.alias("_row")))
    first = both.coalesce(1).sortWithinPartitions(F.col("_row").isNotNull(), *[F.col("_row")[c] for c in order])
    return first.mapInArrow(_looked_up, StructType([StructField("_row", kind), StructField(text, StringType())])).select("_row.*", text)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, text, row): texts, whose row is null, come first. at and sizes: where each text begins in the file, and its bytes (-1: null)."""
    codec, places, at, sizes = pa.Codec("zstd", 1), {}, array("q", [0]), array("q")
    with tempfile.TemporaryFile() as file:

        def read(n: int) -> bytes | None:
            if sizes[n] <= 0:
                return None if sizes[n] < 0 else b""
            return codec.decompress(os.pread(file.fileno(), at[n + 1] - at[n], at[n]), sizes[n], asbytes=True)

        for batch in batches:
            keys, texts, rows = batch.columns
            n = rows.null_count
            for key, text in zip(keys.slice(0, n).to_pylist(), texts.slice(0, n).cast(pa.binary()).to_pylist(), strict=True):
                places[key] = (*places.get(key, ()), len(sizes))
                kept = codec.compress(text, asbytes=True) if text else b""
                file.write(kept)
                at.append(at[-1] + len(kept))
                sizes.append(-1 if text is None else len(text))
            file.flush()
            chosen, found, held = [], [], 0
            out = lambda: pa.RecordBatch.from_arrays([rows.take(pa.array(chosen, pa.int64())), pa.array(found, pa.binary()).view(pa.string())], names=["_row", batch.schema.names[1]])  # noqa: B023, E731
            for i, key in enumerate(keys.slice(n).to_pylist(), n):
                for place in places.get(key, (None,)):
                    chosen.append(i)
                    found.append(None if place is None else read(place))
                    held += len(found[-1] or b"")
                    if held >= BATCH:
                        yield out()
                        chosen, found, held = [], [], 0
            if chosen:
                yield out()
