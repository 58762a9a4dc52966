"""Bringing new messages in: backfill by phases, increments from a cursor, micro-batches, and who a notification is for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Phase:
    """Messages between `since` and `until` days old, in batches of `batch`."""

    name: str
    since: int
    until: int
    batch: int
    embed: bool = True
    ask_model: bool = True
    model_most: int | None = None


#: Newest first; the deep phase only stores and counts (fixed values).
PHASES = [Phase("quick", 0, 7, 100), Phase("recent", 7, 30, 200), Phase("deep", 30, 90, 500, embed=False, ask_model=False)]


def phases(quick_only: bool = False) -> list[Phase]:
    """What a run goes through: all phases, or the first with 50 questions to the model at most."""
    return [Phase("quick", 0, 7, 100, model_most=50)] if quick_only else list(PHASES)


def phase_batches(mail: DataFrame, phase: Phase) -> DataFrame:
    """The phase's messages with a batch number, newest first; days count back from the last date.

    Batches are numbered within days, so that no window spans all rows: `batch` is (days back, number within the day).
    """
    from pyspark.sql import Window

    as_of = mail.agg(F.max("date_parsed").alias("as_of"))
    rows = mail.crossJoin(F.broadcast(as_of))
    age = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("date_parsed").cast("timestamp"))) / F.lit(86_400_000_000)
    rows = rows.withColumn("_age", age).filter((F.col("_age") >= phase.since) & (F.col("_age") < phase.until)).withColumn("_day", F.floor("_age").cast("int"))
    nth = F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("date_parsed"), "id")) - 1
    return rows.withColumn("batch", F.struct(F.col("_day").alias("day"), F.floor(nth / phase.batch).cast("int").alias("n"))).drop("_age", "_day", "as_of")


def for_model(rows: DataFrame, phase: Phase) -> DataFrame:
    """The phase's rows that a model may be asked about: none where the phase doesn't ask, the newest `model_most` where it has a limit, else all."""
    if not phase.ask_model:
        return rows.limit(0)
    return rows.orderBy(F.desc("date_parsed"), "id").limit(phase.model_most) if phase.model_most is not None else rows


def run_phases(mail: DataFrame, todo: list[Phase], work: Callable[[DataFrame, Phase], None]) -> list[str]:
    """work() on each phase's messages, in order; the first that fails stops the run. Returns the names of those done."""
    done = []
    for phase in todo:
        try:
            work(phase_batches(mail, phase), phase)
        except Exception as error:  # noqa: BLE001
            raise RuntimeError(f"phase {phase.name} failed after {done}") from error
        done.append(phase.name)
    return done


def micro_batches(stream: DataFrame, steps: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Each micro-batch of a stream goes through all steps in order (store, features, rules, ...); returns the running query.

    The batch is kept while the steps read it. A batch that is repeated after a failure has the same number, by which steps can tell.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for step in steps:
                step(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental(history: DataFrame, known: DataFrame, cursor: str) -> tuple[DataFrame, DataFrame]:
    """New message ids after the cursor, and the next cursor in one row (next_cursor).

    history: (history_id, message_id). Ids compare as strings, as the provider's cursor does; without newer rows the cursor stays.
    """
    newer = history.filter(F.col("history_id") > cursor)
    ids = newer.select("message_id").distinct().join(known.select("message_id"), "message_id", "left_anti")
    return ids, newer.agg(F.coalesce(F.max("history_id"), F.lit(cursor)).alias("next_cursor"))


def initial_window(mail: DataFrame, days: int) -> DataFrame:
    """The messages of the last days before the last date."""
    as_of = mail.agg(F.max("date_parsed").alias("_as_of"))
    return mail.crossJoin(F.broadcast(as_of)).filter(F.col("date_parsed") >= F.col("_as_of") - F.make_dt_interval(F.lit(days))).drop("_as_of")


def notify_route(notifications: DataFrame, users: DataFrame) -> DataFrame:
    """Notifications (email, history_id) with the user they are for; those of nobody known go. Works on a stream, too: users is a table."""
    known = users.select(F.lower("email").alias("_email"), "user_id", "sync_enabled")
    return notifications.join(known, F.lower("email") == F.col("_email")).filter("sync_enabled").select("user_id", "email", "history_id")


def sync_status(users: DataFrame, states: DataFrame) -> DataFrame:
    """(user_id, status, last_sync_at, emails_synced) of every user; 'not_synced' where there is no state."""
    rows = users.select("user_id").join(states.select("user_id", "status", "last_sync_at", "emails_synced"), "user_id", "left")
    return rows.select("user_id", F.coalesce("status", F.lit("not_synced")).alias("status"), "last_sync_at", F.coalesce("emails_synced", F.lit(0)).cast("long").alias("emails_synced"))
