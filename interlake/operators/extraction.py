"""All entity extractions as one run: each step sees what the steps before it made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.operators import entities as e
from interlake.operators import model_inputs as mi


def _outcome(kind: str, rows: DataFrame, key: str, old: DataFrame | None, filtered: DataFrame | None = None) -> DataFrame:
    """One row: how many keys are new, how many rows meet a key that is there (or came twice), how many candidates were turned down."""
    had = rows.select(key).withColumn("_had", F.lit(False)) if old is None else rows.select(key).join(old.select(key).distinct().withColumn("_had", F.lit(True)), key, "left")
    made = F.count_distinct(F.when(~F.coalesce("_had", F.lit(False)), F.col(key)))
    out = had.agg(made.alias("created"), (F.count(F.lit(1)) - made).alias("updated")).select(F.lit(kind).alias("kind"), "created", "updated")
    if filtered is None:
        return out.withColumn("filtered", F.lit(0).cast("long"))
    return out.crossJoin(F.broadcast(filtered.agg(F.count(F.lit(1)).alias("filtered"))))  # one row


def extract_all(
    mail: DataFrame, contacts: DataFrame, people: DataFrame, answers: DataFrame, patterns: DataFrame, clusters: DataFrame, scores: DataFrame, thread_stats: DataFrame, own: str,
    *, tasks: DataFrame | None = None, projects: DataFrame | None = None, contexts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables tasks, thread_projects, cluster_projects, contexts, and counts (kind, created, updated, filtered) of the five steps in order.

    tasks (task_id, email_id), projects (owner_email, cluster_id; the other one null) and contexts (id): what earlier runs made. A
    message with a task, also one made by this run's answers, gets none by signals; a sender with a thread project, also an earlier
    one, covers a cluster. Turned down are candidates of no real person, and clusters that are covered or have few real ones.
    """
    real = people.select("id", "is_real_person")
    told = mi.tasks_from_answers(answers, mail, contacts, people)
    wanted = answers.filter(F.col("action_type").isin(*mi.TASK_TYPES)).select(F.col("email_id").alias("id"))
    taken = told.select("email_id") if tasks is None else told.select("email_id").union(tasks.select("email_id"))
    signed = e.tasks_from_signals(patterns, mail, contacts, people, taken.distinct())
    asked = patterns.filter("has_request OR has_deadline OR has_approval").select("id").join(taken.select(F.col("email_id").alias("id")), "id", "left_anti")
    down = lambda found: found.join(real, "id").filter("NOT is_real_person")
    by_thread = e.projects_from_threads(mail, contacts, own)
    owners = by_thread.select("owner_email")
    if projects is not None:
        owners = owners.union(projects.select("owner_email").filter("owner_email IS NOT NULL")).distinct()
    found = e.projects_from_clusters(mail, clusters, people, owners)
    by_cluster = found.filter("outcome = 'created'")
    around = e.priority_contexts(mail, scores, contacts, thread_stats, people)
    counts = [
        _outcome("tasks_from_answers", told, "task_id", tasks, down(wanted)),
        _outcome("tasks_from_signals", signed, "task_id", tasks, down(asked)),
        _outcome("projects_from_threads", by_thread, "owner_email", projects),
        _outcome("projects_from_clusters", by_cluster, "cluster_id", projects, found.filter("outcome <> 'created'")),
        _outcome("priority_contexts", around, "id", contexts),
    ]
    all_counts = counts[0]
    for one in counts[1:]:
        all_counts = all_counts.unionByName(one)
    return {"tasks": told.unionByName(signed, allowMissingColumns=True), "thread_projects": by_thread, "cluster_projects": by_cluster, "contexts": around, "counts": all_counts}
