"""Contiguous shards of near-equal bytes by global prefix sums; DataFrame functions only.

Documents are dealt out in order to range partitions. Each partition's total of bytes and rows gives, summed
up over the partitions before it, where the partition begins in the whole order; a running sum inside it
places every document. Cuts stand at equal targets of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlake.llm._spark import checkpointed


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1 for its end; 1 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def assign(docs: DataFrame, *, shards: int = 16, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, and with `keep` a struct `row` of these columns.

    The order is that of doc_id (null first), then size and checksum of the text; rows equal in all
    of these take their places in the order in which they are read. A document belongs to the shard in which the middle of
    its bytes falls when the sum of all sizes is cut into `shards` equal parts, so each shard's bytes miss the target by no more
    than half a document at each end; a document larger than a part may leave a shard empty. slot counts a shard's
    documents from 0 without a gap. A null text has size 1 and checksum 0. An empty table gives no row.
    Sums are exact up to 2^62 / (2 * shards) bytes; beyond that the job fails with an overflow.

    One doc_id may hold any share of the rows: partitions are cut by doc_id, size, checksum and a hash of the row's place. What
    shuffles are sizes and checksums, not texts, unless `keep` names them.
    """
    t = F.col(f"`{text}`")
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), byte_size(t).alias("size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []),
    ).withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc(), F.col("place").asc()]
    dealt = slim.repartitionByRange(partitions, *order) if partitions else slim.repartitionByRange(*order)
    parts = checkpointed(dealt.withColumn("part", F.spark_partition_id()))  # written once: a partition's number is what was written

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))  # one row a partition: small whatever the data
    zero = F.lit(0).cast("long")
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), zero).alias("base"), F.coalesce(F.sum("rows").over(before), zero).alias("base_rows"), F.sum("bytes").over(whole).alias("total"))

    inside = Window.partitionBy("part").orderBy(*order)
    upto = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.join(F.broadcast(totals), "part")
    placed = placed.withColumn("upto", upto).withColumn("nth", F.col("base_rows") + F.row_number().over(inside) - 1)
    twice = F.lit(2).cast("long") * F.col("upto") - F.col("size")  # twice the middle of the document
    placed = placed.withColumn("twice", twice).withColumn("shard", F.expr(f"least({shards - 1}, (twice * {shards}L) div (2L * total))").cast("int"))
    placed = checkpointed(placed.drop("base", "base_rows", "total", "upto", "twice", "part", "place"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # one row a shard
    out = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("nth") - F.col("first"))
    return out.select("doc_id", "size", "text_crc32", *(["row"] if keep else []), "shard", "slot")


def write_shards(docs: DataFrame, path: str, *, shards: int = 16, files: int = 1, **options) -> None:
    """Write all columns of the documents as Parquet, one folder a shard (`_shard=N`), in order, each shard in up to `files` files.

    A column named _shard can't be written besides the folders' own and stops the call.
    """
    if "_shard" in docs.columns:
        raise ValueError("documents have a column _shard, which names the folders")
    placed = assign(docs, shards=shards, keep=docs.columns, **options)
    rows = placed.select(F.col("shard").alias("_shard"), F.struct("slot").alias("_at"), "row")
    dealt = rows.repartitionByRange(shards * files, "_shard", "_at").sortWithinPartitions("_shard", "_at")
    dealt.select("_shard", *[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).write.partitionBy("_shard").parquet(path)
