"""What the inbox and its lists show: pages with their counts, in the order that a reader sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in this order; `order` ends in a key, so that pages neither overlap nor leave gaps."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def envelope(rows: DataFrame, shown: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One row (total, limit, offset, has_more) for a page `shown` of rows."""
    counts = rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(shown.agg(F.count(F.lit(1)).alias("shown")))
    return counts.select("total", F.lit(limit).cast("long").alias("limit"), F.lit(offset).cast("long").alias("offset"), (F.lit(offset) + F.col("shown") < F.col("total")).alias("has_more"))


def task_counts_by_mail(tasks: DataFrame, status: str = "pending") -> DataFrame:
    """(id, task_count) of messages with tasks of this status."""
    return tasks.filter(F.col("status") == status).groupBy(F.col("email_id").alias("id")).agg(F.count(F.lit(1)).alias("task_count"))


def project_names(links: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, project_name): of several projects of a message the least name. links: (email_id, project_id)."""
    return links.join(projects.select("project_id", "name"), "project_id").groupBy(F.col("email_id").alias("id")).agg(F.min("name").alias("project_name"))


def priority_inbox(mail: DataFrame, ranks: DataFrame, contexts: DataFrame, tasks: DataFrame, links: DataFrame, projects: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of received messages by rank, unranked ones last, then newest first, with context, pending tasks, project, total and has_more.

    ranks: (id, priority_rank, priority_score); contexts: as priority_contexts() gives them. The page is cut before what
    decorates it is joined: only the ranks meet all messages.
    """
    got = mail.filter(~F.col("is_sent"))
    order = [F.asc_nulls_last("priority_rank"), F.desc_nulls_first("date_parsed"), F.asc("id")]
    shown = page(got.join(ranks.select("id", "priority_rank", "priority_score"), "id", "left"), order, limit, offset)
    context = contexts.select("id", "sender_email", "sender_importance", "sender_reply_rate", "thread_length", "is_business_hours", "age_hours", "people_score", "temporal_score", "relationship_score", F.col("adjusted_priority").alias("overall_priority"))
    rows = shown.join(context, "id", "left").join(task_counts_by_mail(tasks), "id", "left").join(project_names(links, projects), "id", "left")
    total = got.agg(F.count(F.lit(1)).alias("total"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return rows.crossJoin(F.broadcast(total)).select(
        "id", "message_id", "thread_id", "subject", "from_email", "from_name", "date_parsed", zero("has_attachments", False), zero("priority_rank", 0), zero("priority_score", 0.0),
        *[c for c in context.columns if c != "id"], zero("task_count", 0), "project_name", "total", (F.lit(offset) + F.least(F.lit(limit), F.greatest(F.lit(0), F.col("total") - offset)) < F.col("total")).alias("has_more"),
    )


def task_detail(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Tasks with the name of their project, null without one."""
    return tasks.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")


def project_page(projects: DataFrame, active: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Projects, the latest activity first, those without any last; newer ones before older, then by id."""
    rows = projects if active is None else projects.filter(F.col("is_active") == active)
    return page(rows, [F.desc_nulls_last("last_activity"), F.desc("created_at"), F.asc("project_id")], limit, offset)


def newest_page(rows: DataFrame, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Organisations or members, newest first."""
    return page(rows, [F.desc("created_at"), F.asc(key)], limit, offset)


def oldest_unanswered(mail: DataFrame) -> DataFrame:
    """One row: the earliest date of received messages without a reply."""
    replies = mail.filter(F.col("in_reply_to").isNotNull()).select(F.col("in_reply_to").alias("message_id"))
    return mail.filter(~F.col("is_sent")).join(replies, "message_id", "left_anti").agg(F.min("date_parsed").alias("oldest_unanswered"))


def tenant_scope(rows: DataFrame, user_id: str | None, column: str = "user_id", strict: bool = False) -> DataFrame:
    """The rows of one user; without one all rows, or (strict, as point lookups have it) those of no user."""
    if user_id is not None:
        return rows.filter(F.col(column) == user_id)
    return rows.filter(F.col(column).isNull()) if strict else rows


def optional_filters(rows: DataFrame, **equal) -> DataFrame:
    """Rows that equal every value given; None means no condition."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def point_lookup(rows: DataFrame, **keys) -> DataFrame:
    """The row of a key, of several columns if need be; None looks for a null."""
    for column, value in keys.items():
        rows = rows.filter(F.col(column).isNull() if value is None else F.col(column) == value)
    return rows


def project_clusters(meta: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Content clusters that are projects, the latest activity first."""
    rows = optional_filters(meta.filter("dimension = 'content' AND is_project"), project_status=status)
    return page(rows, [F.desc_nulls_last("last_activity"), F.asc("cluster_id")], limit, offset)


def unlabeled_topk(meta: DataFrame, dimension: str, limit: int = 50) -> DataFrame:
    """The largest clusters without a label."""
    return page(meta.filter((F.col("dimension") == dimension) & F.col("auto_label").isNull()), [F.desc("size"), F.asc("cluster_id")], limit)


def active_watches(watches: DataFrame) -> DataFrame:
    return watches.filter("status = 'active'")


def expiring_soon(watches: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Active subscriptions that end within so many hours."""
    return active_watches(watches).filter(F.col("expiration") <= as_of + F.make_interval(hours=F.lit(hours)))
