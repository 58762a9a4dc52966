"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlake.llm._spark import checkpointed

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, *, epochs: float = 3.0) -> DataFrame:
    """Add `target` to rows of (source, source_size, weight): shares by weight of the sum of all sizes, none above epochs times its size.

    What a clamped source can't take is shared by weight among the others, until none is above its
    cap: sources are taken in the order of cap / weight, and the first k of them are clamped for
    the smallest k at which the level of the rest, (total - their caps) / (weights of the rest),
    doesn't exceed the next one's cap / weight. One row per source: small beside the corpus.
    """
    order = [(F.col("source_size") * epochs / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    levels = (
        sources.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(F.col("source_size")).over(before), F.lit(0)) * F.lit(epochs)) / F.col("rest"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(epochs))
    )
    return (
        levels.withColumn("final", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("source_size") * F.lit(epochs)), F.col("source_size") * F.lit(epochs)))
        .drop("total", "rest", "level", "free", "final")
    )


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: float = 3.0, seed: int = 7, buckets: int = 1024
) -> DataFrame:
    """How often each document enters the mix.

    Returns (doc_id, source, size, source_size, target, reps, taken). Sources in the order of their
    code points, null last, weigh `weights` in turn. A source at r times its size gives each
    document floor(r) times, and once more to the documents that come first in a seeded order (by
    SHA-256 of seed and doc_id) as long as the middle of the document lies within the words that
    are missing; so its taken words miss the target by half a document at most, and no document is
    taken more than `epochs` times (rounded up). Empty documents have size 0 and are taken 0 words.

    A source may hold any share of the rows: running sums are made per source and `buckets` ranges
    of the seeded order, on top of a running sum over the buckets' totals. Repeated rows count each.
    """
    sized = checkpointed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size")))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int")))
    targets = checkpointed(water_fill(table, epochs=epochs).select("source", "source_size", "target"))

    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    keyed = sized.withColumn("place", place).withColumn("bucket", (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    per_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.withColumn("base", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    base = base.join(targets, base["s"].eqNullSafe(targets["source"])).drop("source")
    inner = Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.withColumn("run", F.sum("size").over(inner))
    at = run.join(base, run["source"].eqNullSafe(base["s"]) & (run["bucket"] == base["b"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    missing = F.col("target") - whole * F.col("source_size")
    middle = F.col("base") + F.col("run") - F.col("size") / 2
    reps = whole + F.when((F.col("size") > 0) & (middle < missing), 1).otherwise(0)
    return at.select("doc_id", "source", "size", "source_size", "target", reps.alias("reps")).withColumn("taken", F.col("size") * F.col("reps"))


def repeat_mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as mix() takes it; all columns stay, whatever their names. Rows of one doc_id must be equal in source and size, or they are taken as often as that of them that is taken most."""
    key = options.get("doc_id", "doc_id")
    reps = mix(docs, **options).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("reps").alias("reps")).filter("reps > 0")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    both = rows.join(reps, F.col("id").eqNullSafe(F.col("taken_id")))
    each = both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps"))).alias("nth"))
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
