"""The 31 features of received messages, the matrices that the clusterings take, and the clusterings themselves.

Everything about a message is one projection over its row and its sender's row; matrices are selections of those columns.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.functions import text as t
from interlake.operators import mail as m
from interlake.operators import rules as r
from interlake.storage import checkpointed

#: Fits of one clustering that run side by side.
STARTS_AT_ONCE = 5
#: Clusters at most by dimension (fixed values).
MOST_CLUSTERS = {"people": 15, "behavior": 8, "service": 8, "temporal": 6, "content": 100}
#: Columns of each matrix, in order.
MATRICES = {
    "people": ["relationship_strength", "reply_rate", "avg_response_hours", "emails_from_sender", "sender_reply_rate", "is_service"],
    "behavior": ["action_code", "response_hours", "timing_code"],
    "service": ["is_service", "service_importance", "has_unsub", "common_domain", "service_type_code"],
    "temporal": ["hour_of_day", "day_of_week", "is_business", "is_weekend"],
}


def _code(c: Column, names: list[str], other: int) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[1], kv[0]).otherwise(out), reversed(list(enumerate(names, 1))), F.lit(other))


def email_features(mail: DataFrame, reciprocity: str = "as_written", of: DataFrame | None = None) -> DataFrame:
    """31 features of every received message; mail has body_text, or r.body_facts() with body_words and body_shows_unsubscribe, those two of the text without markup.

    Days count whole days of 24 hours before the last date of all messages. The sender's statistics come by one join.
    of: the messages whose features are wanted, if not all; statistics and the last date are those of mail, which needs no body then.
    """
    as_of = mail.agg(F.max("date_parsed").alias("as_of"))
    got = mail if of is None else of
    rows = r.with_service(got.filter(~F.col("is_sent"))).withColumn("sender", F.lower("from_email"))
    rows = rows.join(m.sender_stats(mail, reciprocity), "sender", "left").crossJoin(F.broadcast(as_of))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = m.with_strength(rows)
    hour, day = zero(F.hour("date_parsed")).cast("long"), zero(F.weekday("date_parsed")).cast("long")
    since = zero(m.floor_days(m.instant(F.col("as_of")), m.instant(F.col("date_parsed"))))
    told = "body_words" in got.columns
    plain = F.lit(None).cast("string") if told else t.html_to_text(F.coalesce("body_text", F.lit("")))
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    attached = F.array_contains(labels, "Has attachment") | F.exists(labels, lambda x: F.lower(x).contains("has:attachment"))
    rows = rows.withColumns({"plain": plain, "hour_of_day": hour, "day_of_week": day, "days_since_received": since, "attached": attached})
    busy = m.business_hours(F.col("hour_of_day"), F.col("day_of_week"))
    return rows.select(
        F.col("id").alias("email_id"),
        zero(F.col("emails_7d")).alias("emails_from_sender_7d"), zero(F.col("emails_30d")).alias("emails_from_sender_30d"),
        zero(F.col("emails_90d")).alias("emails_from_sender_90d"), zero(F.col("emails_all")).alias("emails_from_sender_all"),
        zero(F.col("user_replied_count")).alias("user_replied_to_sender_count"),
        F.round("user_replied_rate", 6).alias("user_replied_to_sender_rate"),
        F.coalesce("avg_response_hours", F.lit(0.0)).alias("avg_response_time_hours"),
        F.round("user_initiated_ratio", 6).alias("user_initiated_ratio"),
        F.col("days_since_last").alias("days_since_last_interaction"),
        F.coalesce("sender_reply_rate", F.lit(0.0)).alias("sender_replies_to_you_rate"),
        F.round("strength", 6).alias("relationship_strength"),
        F.col("is_service").alias("is_service_email"), "service_confidence", "service_type", "service_importance",
        (F.col("body_shows_unsubscribe") if told else F.lower("plain").contains("unsubscribe")).alias("has_unsubscribe_link"),
        F.lit(False).alias("has_list_unsubscribe_header"),
        r.holds_any(F.lower(F.coalesce("from_email", F.lit(""))), r.SERVICE_SENDERS).alias("from_common_service_domain"),
        "hour_of_day", "day_of_week", (F.col("day_of_week") >= 5).alias("is_weekend"), busy.alias("is_business_hours"),
        "days_since_received", (F.col("days_since_received") < 7).alias("is_recent"), m.time_bucket(F.col("hour_of_day")).alias("time_bucket"),
        F.round(m.urgency(F.col("strength"), F.col("days_since_received"), busy, F.col("attached")), 6).alias("urgency_score"),
        t.word_count(F.col("subject")).alias("subject_word_count"), (F.col("body_words") if told else t.word_count(F.col("plain"))).alias("body_word_count"),
        F.col("attached").alias("has_attachments"), F.col("attached").cast("int").alias("attachment_count"),
        (F.greatest(F.lit(0), zero(F.size("to_emails"))) + F.greatest(F.lit(0), zero(F.size("cc_emails")))).alias("recipient_count"),
    )


def people_matrix(features: DataFrame) -> DataFrame:
    """(id, 6 columns): the sender's relationship to the owner; what is missing counts 0, 0, 168 hours, 1, 0."""
    or_ = lambda c, v: F.coalesce(c, F.lit(v)).cast("double")
    return features.select(
        F.col("email_id").alias("id"), or_("relationship_strength", 0).alias("relationship_strength"), or_("user_replied_to_sender_rate", 0).alias("reply_rate"), or_("avg_response_time_hours", 168).alias("avg_response_hours"),
        or_("emails_from_sender_all", 1).alias("emails_from_sender"), or_("sender_replies_to_you_rate", 0).alias("sender_reply_rate"), F.coalesce("is_service_email", F.lit(False)).cast("double").alias("is_service"),
    )


def behavior_matrix(actions: DataFrame, timings: tuple[str, ...] = ("immediate", "same_day", "next_day", "delayed")) -> DataFrame:
    """(id, action code, hours, timing code) of received messages. actions: (id, action, timing, response_seconds).

    The default timings are lower-case names, which stored timings never equal, so the code is always 5, as in the original; pass the
    stored names (IMMEDIATE, SAME_DAY, NEXT_DAY, LATER) to have it tell them apart.
    """
    rows = actions.filter("action <> 'COMPOSED'")
    return rows.select(
        "id", _code(F.col("action"), ["REPLIED", "ARCHIVED", "IGNORED", "PENDING"], 5).cast("double").alias("action_code"),
        F.coalesce(F.col("response_seconds") / 3600.0, F.lit(168.0)).alias("response_hours"), _code(F.coalesce("timing", F.lit("")), list(timings), 5).cast("double").alias("timing_code"),
    )


def service_matrix(features: DataFrame) -> DataFrame:
    """(id, 5 columns) that tell service messages apart."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    kinds = ["transactional", "notification", "newsletter", "marketing", "social"]
    return features.select(
        F.col("email_id").alias("id"), flag("is_service_email").alias("is_service"), F.coalesce("service_importance", F.lit(0.5)).alias("service_importance"), flag("has_unsubscribe_link").alias("has_unsub"),
        flag("from_common_service_domain").alias("common_domain"), _code(F.coalesce("service_type", F.lit("")), kinds, 0).cast("double").alias("service_type_code"),
    )


def temporal_matrix(features: DataFrame) -> DataFrame:
    """(id, hour, weekday, business hours, weekend)."""
    return features.select(
        F.col("email_id").alias("id"), F.col("hour_of_day").cast("double").alias("hour_of_day"), F.col("day_of_week").cast("double").alias("day_of_week"),
        F.col("is_business_hours").cast("double").alias("is_business"), F.col("is_weekend").cast("double").alias("is_weekend"),
    )


def standard_scale(matrix: DataFrame, *columns: str) -> DataFrame:
    """The columns less their mean, over their population deviation; a deviation of 0 counts as 1. One aggregate, one broadcast row."""
    figures = matrix.agg(*[f(c).alias(f"_{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("width", F.stddev_pop))])
    out = matrix.crossJoin(F.broadcast(figures))
    scaled = {c: (F.col(c) - F.col(f"_mean_{c}")) / F.when(F.col(f"_width_{c}") > 1e-12, F.col(f"_width_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*figures.columns)


def kmeans_clusters(matrix: DataFrame, columns: list[str], most: int, seeds: tuple[int, ...] = tuple(range(42, 52)), times: str | None = None) -> DataFrame:
    """(id, cluster, prob): KMeans with `most` clusters, or as many as there are different rows; of ten starts the one with the least cost wins.

    Equal rows are one row with a weight in the fits, so few kinds of rows cost little however many rows there are. prob is 1 - distance /
    largest distance, 1 if all distances are 0. Columns are expected to be scaled. No rows give no rows. times: a column that says for how
    many equal rows each one stands. Starts don't wait for one another, so that a short job of one leaves no core idle.
    """
    values = F.array(*columns) if len(columns) > 1 else F.col(columns[0])
    rows = checkpointed(matrix.select("id", values.alias("v"), (F.col(times) if times else F.lit(1)).cast("double").alias("w")))  # read by the count of kinds and by what places the rows
    different = checkpointed(rows.groupBy("v").agg(F.sum("w").alias("w")))
    if different.count() <= most:  # each different row is a cluster
        kinds = [tuple(r["v"]) for r in different.select("v").collect()]
        if not kinds:
            return matrix.sparkSession.createDataFrame([], "id long, cluster int, prob double")
        number = reduce(lambda out, kv: F.when(F.col("v") == F.array(*map(F.lit, kv[1])), kv[0]).otherwise(out), enumerate(sorted(kinds)), F.lit(None).cast("int"))
        return rows.select("id", number.alias("cluster"), F.lit(1.0).alias("prob"))
    points = different.select(array_to_vector("v").alias("x"), "w").persist()  # gone through some hundred times; what is lost is read from the checkpoint again
    points.count()
    fit = lambda s: KMeans(k=most, seed=s, featuresCol="x", weightCol="w", predictionCol="cluster").fit(points)
    with ThreadPool(STARTS_AT_ONCE) as pool:
        models = pool.map(inheritable_thread_target(matrix.sparkSession)(fit), seeds)
    best = min(models, key=lambda model: model.summary.trainingCost)
    centers = [c.tolist() for c in best.clusterCenters()]
    points.unpersist()
    rows = rows.select("id", array_to_vector("v").alias("x"))
    centre = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centers]), F.col("cluster") + 1)
    square = F.aggregate(F.zip_with(vector_to_array("x"), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    placed = best.transform(rows).select("id", "cluster", F.sqrt(square).alias("d"))
    far = placed.agg(F.max("d").alias("far"))
    return placed.crossJoin(F.broadcast(far)).select("id", "cluster", F.when(F.col("far") > 0, 1 - F.col("d") / F.col("far")).otherwise(1.0).alias("prob"))


def cluster_dimension(matrix: DataFrame, dimension: str) -> DataFrame:
    """(id, cluster, prob) of one dimension's matrix, scaled."""
    columns = MATRICES[dimension]
    return kmeans_clusters(standard_scale(matrix, *columns), columns, MOST_CLUSTERS[dimension])


def cluster_content(vectors: DataFrame, most: int = MOST_CLUSTERS["content"], noise: float = 0.0, times: str | None = None) -> DataFrame:
    """(id, cluster, prob) of embeddings, without scaling. times: for how many equal rows each one stands; a share of noise is one of vectors then.

    noise: this share of the rows, those farthest from their centres, gets cluster -1 and prob 0; none by default, and never rows that lie on their centre.
    """
    found = kmeans_clusters(vectors.select("id", F.col("embedding").cast("array<double>").alias("x"), *([times] if times else [])), ["x"], most, times=times)
    if not noise:
        return found
    edge = found.agg(F.percentile_approx("prob", noise, 10_000).alias("edge"))
    far = (F.col("prob") <= F.col("edge")) & (F.col("prob") < 1)
    return found.crossJoin(F.broadcast(edge)).select("id", F.when(far, -1).otherwise(F.col("cluster")).alias("cluster"), F.when(far, 0.0).otherwise(F.col("prob")).alias("prob"))


def merge_clusters(people: DataFrame, content: DataFrame, behavior: DataFrame, service: DataFrame, temporal: DataFrame) -> DataFrame:
    """One row per id of people: five cluster ids, and the probabilities of people and content; null where a dimension lacks it."""
    one = lambda df, name, *more: df.select("id", F.col("cluster").cast("long").alias(f"{name}_cluster_id"), *[F.col("prob").alias(x) for x in more])
    out = one(people, "people", "people_cluster_prob")
    for part in (one(content, "content", "content_cluster_prob"), one(behavior, "behavior"), one(service, "service"), one(temporal, "temporal")):
        out = out.join(part, "id", "left")
    return out


def clusters_long(merged: DataFrame) -> DataFrame:
    """(id, dimension, cluster_id) of a merged table."""
    wide = merged.select("id", *[F.col(f"{d}_cluster_id").alias(d) for d in MOST_CLUSTERS])
    return wide.unpivot(["id"], list(MOST_CLUSTERS), "dimension", "cluster_id")


def contact_avg_response(actions: DataFrame, mail: DataFrame) -> DataFrame:
    """(email, avg_response_time_seconds): mean positive answer time to each sender's messages, as a whole number (halves to even, as casts of the original do)."""
    rows = mail.filter(F.col("from_email").isNotNull()).select("id", F.lower(F.trim("from_email")).alias("email")).join(actions.filter("response_seconds > 0").select("id", "response_seconds"), "id")
    return rows.groupBy("email").agg(F.bround(F.avg("response_seconds")).cast("long").alias("avg_response_time_seconds"))


def contact_profile(mail: DataFrame, actions: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """m.contact_profile() with avg_response_time_seconds, null for contacts that were never answered."""
    return m.contact_profile(mail, own).join(contact_avg_response(actions, mail), "email", "left")
