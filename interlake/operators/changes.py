"""Tables as new tables: inserts of what is absent, upserts, column fills, and the phases of a backfill.

Nothing is changed in place; a caller writes the result as a new version. Keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phase and the days before the reference date it covers, newest first (fixed values).
PHASES = [("quick", 0, 7), ("recent", 7, 30), ("deep", 30, 90)]


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first in the order given."""
    at = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows to append: the first of each new key of the batch."""
    return first_per_key(batch.join(target.select(key), key, "left_anti"), key, *order)


def upsert(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The target with the batch's rows in place of those of the same key."""
    return target.join(batch.select(key), key, "left_anti").unionByName(batch)


def update_from(target: DataFrame, values: DataFrame, key: str, *columns: str) -> DataFrame:
    """The target with these columns taken from values (one row a key) where they have one."""
    new = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def delete_where(target: DataFrame, condition: str) -> DataFrame:
    """The target without rows for which the condition is true."""
    return target.filter(~F.coalesce(F.expr(condition), F.lit(False)))


def progressive_phase(mail: DataFrame) -> DataFrame:
    """(id, phase) of messages of the last 90 days before the last date: 0 to 7, 7 to 30, 30 to 90 days old."""
    as_of = mail.agg(F.max("date_parsed").alias("as_of"))
    rows = mail.crossJoin(F.broadcast(as_of))
    phase = F.lit(None).cast("string")
    for name, _, until in reversed(PHASES):
        phase = F.when(F.col("date_parsed") > F.col("as_of") - F.expr(f"INTERVAL {until} DAYS"), name).otherwise(phase)
    return rows.select("id", phase.alias("phase")).filter("phase IS NOT NULL")
