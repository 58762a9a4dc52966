"""Figures of threads, contacts and senders that micro-batches keep up: partial sums by key, merged into stored tables.

Each batch of messages is summed up by itself; its rows meet those of the same keys in the buckets that it touches. The partial sums are such that
the figures of all messages follow from them, in whatever order and number of batches the messages came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interlake.operators import mail as m
from interlake.tables import Table

TOTALS: dict[str, dict[str, Callable[[str], Column]]] = {
    "threads": {"subject": F.min, "n": F.sum, "dated": F.sum, "sent": F.sum, "replies": F.sum, "least": F.min, "most": F.max, "has_attachments": F.bool_or, "attached": F.sum},
    "contacts": {"name": F.max, "emails_from": F.sum, "emails_to": F.sum, "reply_count": F.sum, "first_contact": F.min, "last_contact": F.max},
    "arrivals": {"n": F.sum},
    "initiated": {"n": F.sum},
    "links": {"sender": F.max, "at": F.max, "n_received": F.sum, "n_replies": F.sum, "replied": F.sum, "own_sender": F.max, "n_own": F.sum, "n_answers": F.sum},
}
KEYS = {"threads": ["thread_id", "from_email"], "contacts": ["email", "thread_id"], "arrivals": ["sender", "date_parsed"], "initiated": ["sender"], "links": ["message_id"]}


def _links(mail: DataFrame) -> DataFrame:
    """Per message_id what is known of it: who it came from and when, how often and when in sum the owner replied to it, whether it is the owner's, how many answers it has."""
    us = F.unix_micros(m.instant(F.col("date_parsed")))
    none = {"sender": "string", "at": "long", "n_received": "long", "n_replies": "long", "replied": "decimal(38,0)", "own_sender": "string", "n_own": "long", "n_answers": "long"}

    def rows(found: DataFrame, key: str, **known: Column) -> DataFrame:
        empty = lambda c, kind: F.lit(0).cast(kind) if c.startswith("n_") or c == "replied" else F.lit(None).cast(kind)
        return found.select(F.col(key).alias("message_id"), *[(known[c].cast(kind) if c in known else empty(c, kind)).alias(c) for c, kind in none.items()])

    one = F.lit(1)
    return (
        rows(mail.filter("NOT is_sent"), "message_id", sender=F.lower("from_email"), at=us, n_received=one)
        .union(rows(mail.filter("is_sent"), "message_id", own_sender=F.lower("from_email"), n_own=one))
        .union(rows(mail.filter("is_sent AND in_reply_to IS NOT NULL"), "in_reply_to", n_replies=one, replied=us))
        .union(rows(mail.filter("NOT is_sent AND in_reply_to IS NOT NULL"), "in_reply_to", n_answers=one))
    )


def partials(mail: DataFrame) -> dict[str, DataFrame]:
    """The batch's partial sums by table."""
    got = mail.filter("NOT is_sent")
    links = _links(mail).filter("message_id IS NOT NULL")
    return {
        "threads": m.thread_parts(mail),
        "contacts": m.contact_parts(mail),
        "arrivals": got.groupBy(F.lower("from_email").alias("sender"), "date_parsed").agg(F.count(F.lit(1)).alias("n")),
        "initiated": mail.filter("is_sent").select(F.explode("to_emails").alias("to")).groupBy(F.lower("to").alias("sender")).agg(F.count(F.lit(1)).alias("n")),
        "links": links.groupBy("message_id").agg(*[f(c).alias(c) for c, f in TOTALS["links"].items()]),
    }


class Figures:
    """Stored partial sums below a folder, and the figures that follow from them. message_id must tell messages apart; keys aren't null."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 16):
        self.tables = {name: Table(spark, f"{path}/{name}", keys, buckets=buckets) for name, keys in KEYS.items()}

    def add(self, mail: DataFrame, number: int, writer: str = "mail") -> list[str]:
        """Take a batch in; the names of the tables that it changed. A batch of a number taken in before changes nothing, so a batch that failed halfway can be repeated."""
        return [name for name, part in partials(mail).items() if self.tables[name].merge(part.dropna(subset=KEYS[name]), TOTALS[name], writer=writer, number=number)]

    def thread_stats(self) -> DataFrame:
        return m.thread_totals(self.tables["threads"].read())

    def contact_profile(self) -> DataFrame:
        return m.contact_totals(self.tables["contacts"].read())

    def sender_stats(self) -> DataFrame:
        """m.sender_stats() of all messages so far."""
        arrivals = self.tables["arrivals"].read()
        sent = self.tables["threads"].read().agg(F.max("most").alias("as_of"))
        got = arrivals.crossJoin(F.broadcast(sent))
        since = lambda days: F.sum(F.when(F.col("date_parsed") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"), F.col("n")).otherwise(0))
        counts = got.groupBy("sender").agg(F.sum("n").alias("emails_all"), since(7).alias("emails_7d"), since(30).alias("emails_30d"), since(90).alias("emails_90d"), F.max("date_parsed").alias("last_received"))
        links = self.tables["links"].read()
        met = links.filter("n_received > 0 AND n_replies > 0").groupBy("sender")
        hours = F.sum(F.col("replied") - F.col("n_replies") * F.col("at")).cast("double") / F.sum("n_replies") / 3.6e9
        replied = met.agg(F.sum("n_received").alias("user_replied_count"), F.round(hours, 6).alias("avg_response_hours"))
        rate = links.filter("n_own > 0").groupBy(F.col("own_sender").alias("sender")).agg((F.sum(F.when(F.col("n_answers") > 0, F.col("n_own")).otherwise(0)) / F.sum("n_own")).alias("sender_reply_rate"))
        begun = self.tables["initiated"].read().select("sender", F.col("n").alias("user_initiated_count"))
        out = counts.join(replied, "sender", "left").join(begun, "sender", "left").join(rate, "sender", "left")
        return out.fillna(0, ["user_replied_count", "user_initiated_count"]).fillna(0.0, ["avg_response_hours", "sender_reply_rate"])


def keep_up(stream: DataFrame, figures: Figures, checkpoint: str, **trigger):
    """Take each micro-batch of a stream of messages into the figures; returns the running query (default trigger: what is there now)."""
    return stream.writeStream.foreachBatch(lambda batch, number: figures.add(batch, number) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
