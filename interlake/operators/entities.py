"""Tasks, projects and priority contexts drawn from messages of real people, and the inbox figures.

Contacts join by address and threads by their id, each one row a key; a hot sender's messages are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.operators.mail import instant, seconds_between


def _cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def _or(c: str, default: float) -> Column:
    """The value, or the default for null and zero."""
    return F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(default))


def is_you(email: Column, own: str) -> Column:
    """The own address, or one of the same domain that holds the own local part."""
    local, domain = own.lower().split("@")
    low = F.lower(email)
    return (low == own.lower()) | (low.endswith("@" + domain) & low.contains(local))


def with_contact(mail: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds sender_name, reply_rate, emails_from and is_important of the sender, null where unknown."""
    return mail.join(contacts.select(F.col("email").alias("from_email"), F.col("name").alias("sender_name"), "reply_rate", "emails_from", "is_important"), "from_email", "left")


def tasks_from_signals(patterns: DataFrame, mail: DataFrame, contacts: DataFrame, people: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """(task_id, email_id, description, task_type, urgency_score, status) of messages with a request, deadline or approval.

    patterns: (id, flags of detect_patterns); people: (id, is_real_person); messages with a row in tasks are passed over.
    """
    asked = patterns.filter("has_request OR has_deadline OR has_approval").select("id", "has_request", "has_deadline", "has_approval")
    if tasks is not None:
        asked = asked.join(tasks.select(F.col("email_id").alias("id")), "id", "left_anti")
    rows = asked.join(people.filter("is_real_person").select("id"), "id").join(with_contact(mail.select("id", "from_email", "subject"), contacts), "id")
    base = F.when(F.col("has_deadline"), 0.7).when(F.col("has_approval"), 0.6).otherwise(0.4)
    urgency = F.when(F.col("reply_rate") > 0.5, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    subject = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("Task detected from email"))
    named = (F.col("sender_name") != "") & (F.col("sender_name") != F.col("from_email"))
    return rows.select(
        F.concat(F.lit("ai_"), F.col("id").cast("string")).alias("task_id"),
        F.col("id").alias("email_id"),
        _cut(F.when(named, F.concat(F.lit("["), "sender_name", F.lit("] "), subject)).otherwise(subject), 1000).alias("description"),
        F.when(F.col("has_approval"), "decision").when(F.col("has_request"), "follow_up").otherwise("other").alias("task_type"),
        F.round(urgency, 6).alias("urgency_score"),
        F.lit("pending").alias("status"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    """One row: tasks in all, by status, and urgent ones (pending, above 0.7)."""
    of = lambda s: F.count_if(F.col("status") == s)
    urgent = F.count_if((F.col("status") == "pending") & (F.col("urgency_score") > 0.7))
    return tasks.agg(F.count(F.lit(1)).alias("total"), of("pending").alias("pending"), of("completed").alias("completed"), of("dismissed").alias("dismissed"), urgent.alias("urgent"))


def task_page(tasks: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Tasks, most urgent first: one page."""
    return tasks.orderBy(F.desc_nulls_last("urgency_score"), "email_id").offset(offset).limit(limit)


def projects_from_threads(mail: DataFrame, contacts: DataFrame, own: str) -> DataFrame:
    """One project per answered contact, oneself excepted, with two received messages or more.

    The topic is the least subject by code point, if it is longer than 5 characters and no reply or forward.
    """
    known = contacts.filter(F.col("reply_rate") > 0).filter(~is_you(F.col("email"), own))
    got = mail.filter(~F.col("is_sent")).select(F.col("from_email").alias("email"), "thread_id", "date_parsed", "subject")
    # counts before the join: one row a sender
    talks = got.groupBy("email").agg(
        F.count(F.lit(1)).alias("email_count"), F.count_distinct("thread_id").alias("thread_count"), F.max("date_parsed").alias("last_activity"), F.min(F.left("subject", F.lit(100))).alias("first_subject")
    )
    rows = known.join(talks.filter("email_count >= 2"), "email")
    base = F.concat(F.lit("Conversation: "), F.when((F.col("name") != "") & (F.col("name") != F.col("email")), F.col("name")).otherwise(F.split_part("email", F.lit("@"), F.lit(1))))
    topic = F.left("first_subject", F.lit(50))
    told = (F.length("first_subject") > 5) & ~topic.contains("Re:") & ~topic.contains("Fwd:")
    often = F.col("reply_rate") > 0.5
    return rows.select(
        F.col("email").alias("owner_email"),
        _cut(F.when(told, F.concat(base, F.lit(" - "), topic)).otherwise(base), 200).alias("name"),
        F.when(F.col("is_important"), "key_relationship").when(often, "active_conversation").otherwise("conversation").alias("project_type"),
        F.when(F.col("is_important"), 0.95).when(often, 0.9).otherwise(0.7).alias("confidence"),
        "email_count", "thread_count", "last_activity",
    )


def projects_from_clusters(mail: DataFrame, clusters: DataFrame, people: DataFrame, threads: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per content cluster of three messages or more with a real person in it, and its outcome.

    clusters: (id, cluster); threads: the projects above. 'few_real': under half real; 'covered': one of its senders has
    a thread project; 'created': a project with name and confidence. labels: (cluster, auto_label), if there are any.
    """
    rows = mail.select("id", "from_email", "subject").join(clusters.select("id", "cluster").filter("cluster IS NOT NULL"), "id").join(people, "id", "left")
    met = rows.join(threads.select(F.col("owner_email").alias("from_email")), "from_email", "left_semi").select("cluster").distinct().withColumn("covered", F.lit(True))
    found = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("email_count"), F.count_if("is_real_person").alias("real_person_count"), F.min(F.left("subject", F.lit(60))).alias("first_subject"))
    found = found.filter("email_count >= 3 AND real_person_count > 0").join(met, "cluster", "left")
    found = found.join(labels, "cluster", "left") if labels is not None else found.withColumn("auto_label", F.lit(None).cast("string"))
    ratio = F.col("real_person_count") / F.col("email_count")
    name = F.coalesce(F.nullif("auto_label", F.lit("")), F.nullif("first_subject", F.lit("")), F.concat(F.lit("Topic Cluster "), F.col("cluster").cast("string")))
    return found.select(
        F.col("cluster").cast("long").alias("cluster_id"),
        F.when(ratio < 0.5, "few_real").when(F.col("covered"), "covered").otherwise("created").alias("outcome"),
        _cut(name, 200).alias("name"),
        F.round(F.least(F.lit(0.9), 0.5 + ratio * 0.4), 6).alias("confidence"),
        "email_count", "real_person_count",
    )


def priority_contexts(mail: DataFrame, scores: DataFrame, contacts: DataFrame, threads: DataFrame, people: DataFrame) -> DataFrame:
    """What surrounds each scored message: sender, thread, age before the last date, three part scores and the adjusted priority."""
    as_of = mail.agg(F.max("date_parsed").alias("as_of"))
    rows = with_contact(mail.select("id", "from_email", "thread_id", "date_parsed"), contacts).join(scores.select("id", "priority_score", "sender_novelty"), "id").join(people, "id", "left")
    rows = rows.join(threads.select("thread_id", F.col("email_count").alias("thread_length")), "thread_id", "left").crossJoin(F.broadcast(as_of))
    age = seconds_between(instant(F.col("as_of")), instant(F.col("date_parsed"))) / 3600
    real, often = F.coalesce("is_real_person", F.lit(False)), F.col("reply_rate") > 0.5
    person = 0.5 + F.when(F.col("is_important"), 0.3).otherwise(0.0) + F.when(often, 0.2).otherwise(0.0)
    near = 0.5 + F.when(F.col("reply_rate") > 0, F.least(F.lit(0.5), F.col("reply_rate"))).otherwise(0.0)
    return rows.select(
        "id",
        F.col("from_email").alias("sender_email"),
        F.coalesce("emails_from", F.lit(0)).cast("double").alias("sender_frequency"),
        F.when(real, 1.0).otherwise(0.0).alias("sender_importance"),
        F.nullif(F.col("reply_rate"), F.lit(0.0)).alias("sender_reply_rate"),
        "thread_id", "thread_length",
        F.round(age, 6).alias("age_hours"),
        (F.hour("date_parsed").between(9, 17) & (F.weekday("date_parsed") < 5)).alias("is_business_hours"),
        F.round(F.when(real, person).otherwise(0.1), 6).alias("people_score"),
        F.when(age < 24, 0.8).when(age < 72, 0.5).when(age.isNotNull(), 0.2).otherwise(0.0).alias("temporal_score"),
        F.round(F.when(real, near).otherwise(1.0 - _or("sender_novelty", 0.5)), 12).alias("relationship_score"),
        F.round(F.when(real, F.least(F.lit(1.0), _or("priority_score", 0.5) * 1.5)).otherwise(_or("priority_score", 0.5) * 0.5), 12).alias("adjusted_priority"),
    )


def inbox_stats(mail: DataFrame, tasks: DataFrame, scores: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row: received messages, pending tasks, urgent messages, messages of real people, mean priority; the unread count is always 0."""
    received = mail.agg(F.count_if(~F.col("is_sent")).alias("total_emails"))
    pending = tasks.agg(F.count_if(F.col("status") == "pending").alias("pending_tasks"))
    urgent = scores.agg(F.count_if(F.col("priority_score") > 0.7).alias("urgent_emails"), F.round(F.avg("priority_score"), 6).alias("avg_priority_score"))
    people = contexts.agg(F.count_if(F.col("sender_importance") > 0).alias("from_real_people"))
    return received.crossJoin(pending).crossJoin(urgent).crossJoin(people).withColumn("unread_count", F.lit(0))
