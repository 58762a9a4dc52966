"""What clusters of messages look like: size, replies, activity over time, and which of them are projects.

Every figure is one aggregate by cluster with map-side sums; nothing runs once per cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.operators.mail import floor_days, instant


def cluster_meta(clusters: DataFrame, actions: DataFrame, features: DataFrame) -> DataFrame:
    """(dimension, cluster_id, size, ...) of every cluster of every dimension.

    clusters: (id, dimension, cluster_id) in long form; actions: (id, action, response_seconds); features:
    (id, relationship_strength). A missing time or strength counts as 0; the representative is the smallest id.
    """
    rows = clusters.filter("cluster_id IS NOT NULL").join(actions.select("id", "action", "response_seconds"), "id").join(features.select("id", "relationship_strength"), "id", "left")
    mean = lambda c, digits: F.round(F.avg(F.coalesce(c, F.lit(0.0))), digits)
    return rows.groupBy("dimension", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("id").alias("representative_email_id"),
        F.round(F.count_if(F.col("action") == "REPLIED") * 100.0 / F.count(F.lit(1)), 1).alias("pct_replied"),
        mean(F.col("response_seconds") / 3600.0, 1).alias("avg_response_time_hours"),
        mean(F.col("relationship_strength"), 3).alias("avg_relationship_strength"),
    )


def dim_stats(meta: DataFrame) -> DataFrame:
    """Clusters and messages per dimension, with the mean, largest and smallest size."""
    return meta.groupBy("dimension").agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("messages"), F.round(F.avg("size"), 6).alias("mean_size"), F.max("size").alias("largest"), F.min("size").alias("smallest"))


def cluster_topk(meta: DataFrame, dimension: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """The largest clusters of a dimension: one page."""
    return meta.filter(F.col("dimension") == dimension).orderBy(F.desc("size"), "cluster_id").offset(offset).limit(limit)


def cluster_activity(mail: DataFrame, clusters: DataFrame) -> DataFrame:
    """First and last date, messages in all and lately, senders of every content cluster, with velocity, trend and temporal strength.

    clusters: (id, cluster). Days count back from the last date of all messages.
    """
    as_of = mail.agg(F.max("date_parsed").alias("as_of"))
    rows = mail.select("id", "date_parsed", "from_email").join(clusters.select("id", "cluster").filter("cluster IS NOT NULL"), "id").crossJoin(F.broadcast(as_of))
    after = lambda days: F.col("date_parsed") > F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")
    found = rows.groupBy(F.col("cluster").cast("long").alias("cluster_id"), "as_of").agg(
        F.min("date_parsed").alias("first_activity"),
        F.max("date_parsed").alias("last_activity"),
        F.count(F.lit(1)).alias("email_count"),
        F.count_distinct("from_email").alias("participant_count"),
        F.count_if(after(7)).alias("emails_7d"),
        F.count_if(after(30)).alias("emails_30d"),
        F.count_if(after(14) & ~after(7)).alias("emails_prev_7d"),
    )
    now, before = F.col("emails_7d"), F.col("emails_prev_7d")
    velocity = F.least(now / 7.0, F.lit(5.0)) / 5.0
    trend = F.when(before > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (now - before) / F.nullif(before, F.lit(0))))).when(now > 0, 1.0).otherwise(0.0)
    days = floor_days(instant(F.col("as_of")), instant(F.col("last_activity")))
    found = found.withColumns({"days_since": days, "velocity": velocity, "trend": trend})
    recency = F.coalesce(F.exp(-F.col("days_since") * (math.log(2) / 7.0)), F.lit(0.0))
    strength = recency * 0.35 + F.col("velocity") * 0.35 + (F.col("trend") + 1) / 2 * 0.30
    return found.select("*", F.round(strength, 6).alias("temporal_strength")).withColumns({"velocity": F.round("velocity", 6), "trend": F.round("trend", 6)}).drop("as_of")


def project_status(days: Column) -> Column:
    return F.when(days > 30, "completed").when(days > 14, "stale").when(days.isNotNull(), "active").otherwise("stale")


def detect_projects(meta: DataFrame, activity: DataFrame, min_score: float = 0.4, limit: int = 100) -> DataFrame:
    """(cluster_id, is_project, status, confidence, reason) of the `limit` largest content clusters.

    Each part counts from its least value on: size 5, a fifth answered, two senders, active in 14 days, coherence 0.5 if known.
    """
    rows = cluster_topk(meta, "content", limit).join(activity.select("cluster_id", "participant_count", "days_since"), "cluster_id", "left")
    if "coherence_score" not in rows.columns:
        rows = rows.withColumn("coherence_score", F.lit(None).cast("double"))
    answered, c = F.coalesce(F.col("pct_replied"), F.lit(0.0)) / 100.0, F.col
    parts = [
        (c("size") >= 5, F.least(c("size") / 50, F.lit(1.0)) * 0.25, F.concat(F.lit("size="), c("size").cast("string"))),
        (answered >= 0.2, F.least(answered / 0.5, F.lit(1.0)) * 0.3, F.format_string("engagement=%.1f%%", answered * 100)),
        (c("participant_count") >= 2, F.least(c("participant_count") / 10, F.lit(1.0)) * 0.2, F.concat(F.lit("participants="), c("participant_count").cast("string"))),
        (c("days_since") < 14, F.greatest(F.lit(0.0), 1 - c("days_since") / 14) * 0.25, F.concat(F.lit("days_since="), c("days_since").cast("string"))),
        (c("coherence_score") >= 0.5, c("coherence_score") * 0.1, F.format_string("coherence=%.2f", "coherence_score")),
    ]
    score = sum((F.when(holds, value).otherwise(0.0) for holds, value, _ in parts), F.lit(0.0))
    reason = F.concat_ws(", ", *[F.when(holds, said) for holds, _, said in parts])
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.select("cluster_id", (c("score") >= min_score).alias("is_project"), F.when(c("score") >= min_score, project_status(c("days_since"))).alias("status"), c("score").alias("confidence"), reason.alias("reason"))
