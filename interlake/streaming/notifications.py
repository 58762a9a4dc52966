"""Push notifications as a table or a stream, each change of a mailbox once within the time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.sources.mailbox_files import parse_push
from interlake.streaming import ttl as memory

KEYS = ["email", "history_id"]


def notifications(pushed: DataFrame, *, ttl: float = 300, most: int | None = None, delay: str = "5 minutes", in_order: bool = False) -> DataFrame:
    """(email, history_id, received_at) of (data, received_at); a repeat within `ttl` seconds of the one that passed goes.

    most: how many changes of an account are remembered (None: all within the time to live), the oldest forgotten first. A stream
    judges rows as they come, or with in_order once they are `delay` old, which gives what the table gives. Notifications
    that can't be read, and those without a time, go.
    """
    rows = pushed.withColumn("n", parse_push(F.col("data"))).filter("n.emailAddress IS NOT NULL AND n.historyId IS NOT NULL")
    rows = rows.select(F.col("n.emailAddress").alias("email"), F.col("n.historyId").cast("string").alias("history_id"), "received_at")
    if rows.isStreaming:
        found = memory.let_through_stream(rows, ["email"] if most else KEYS, KEYS, "received_at", ttl=ttl, delay=delay, most=most, in_order=in_order)
        return found.select(F.from_json("key", "email string, history_id string").alias("n"), "received_at").select("n.*", "received_at")
    if most:
        return memory.let_through_limited(rows, ["email"], KEYS, "received_at", ttl=ttl, most=most)
    return memory.let_through(rows, KEYS, "received_at", ttl=ttl)
