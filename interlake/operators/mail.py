"""Threads, behaviour labels, contacts and sender statistics of messages, as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Senders and subjects of automatic replies (fixed values; substrings).
AUTO_SENDERS = ["mailer-daemon", "postmaster", "noreply", "no-reply", "donotreply", "autoreply", "auto-reply"]
AUTO_SUBJECTS = ["delivery status notification", "out of office", "automatic reply"]


def seconds_between(late: Column, early: Column) -> Column:
    """Seconds with their fraction."""
    return (F.unix_micros(late) - F.unix_micros(early)) / 1e6


def floor_days(late: Column, early: Column) -> Column:
    """Whole days of 24 hours that have passed."""
    return F.floor((F.unix_micros(late) - F.unix_micros(early)) / F.lit(86_400_000_000)).cast("long")


def instant(c: Column) -> Column:
    """A timestamp with the session's zone, from one without."""
    return c.cast("timestamp")


def response_bucket(seconds: Column) -> Column:
    return F.when(seconds < 3600, "IMMEDIATE").when(seconds < 86_400, "SAME_DAY").when(seconds < 172_800, "NEXT_DAY").otherwise("LATER")


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def thread_stats(mail: DataFrame) -> DataFrame:
    """One row per thread: counts, span, and the mean gap between messages in a row.

    Gaps between neighbours in time add up to last less first, so their mean is that over their number and needs no sort; senders are
    made distinct before they are listed. Both passes sum up before they shuffle, so a hot thread is a row a task.
    """
    return thread_totals(thread_parts(mail))


def thread_parts(mail: DataFrame) -> DataFrame:
    """What thread_stats() needs, by thread and sender; parts of several batches can be summed up."""
    return mail.groupBy("thread_id", "from_email").agg(
        F.min("subject").alias("subject"),
        F.count(F.lit(1)).alias("n"),
        F.count("date_parsed").alias("dated"),
        F.count_if(F.col("is_sent")).alias("sent"),
        F.count_if(F.col("is_sent") & F.col("in_reply_to").isNotNull()).alias("replies"),
        F.min("date_parsed").alias("least"),
        F.max("date_parsed").alias("most"),
        F.bool_or("has_attachments").alias("has_attachments"),
        F.sum("attachment_count").alias("attached"),
    )


def thread_totals(rows: DataFrame) -> DataFrame:
    """thread_stats() of its parts."""
    span = seconds_between(instant(F.max("most")), instant(F.min("least")))
    return rows.groupBy("thread_id").agg(
        F.min("subject").alias("subject"),
        F.array_join(F.sort_array(F.collect_set("from_email")), ",").alias("participants"),
        F.sum("n").alias("email_count"),
        F.sum("sent").alias("your_email_count"),
        F.sum("replies").alias("your_reply_count"),
        F.min("least").alias("started_at"),
        F.max("most").alias("last_activity"),
        F.round(span, 6).alias("thread_duration_seconds"),
        F.round(F.when(F.sum("dated") > 1, span / (F.sum("dated") - 1)), 6).alias("avg_response_time_seconds"),
        F.bool_or("has_attachments").alias("has_attachments"),
        F.coalesce(F.sum("attached"), F.lit(0)).cast("long").alias("total_attachment_count"),
    )


def first_own_reply(mail: DataFrame) -> DataFrame:
    """(message_id, reply_at) of received messages: the first own reply that is later."""
    got = mail.filter(~F.col("is_sent")).select("message_id", F.col("date_parsed").alias("at"))
    own = mail.filter(F.col("is_sent") & F.col("in_reply_to").isNotNull()).select(F.col("in_reply_to").alias("message_id"), F.col("date_parsed").alias("reply_at"))
    return got.join(own, "message_id").filter("reply_at > at").groupBy("message_id").agg(F.min("reply_at").alias("reply_at"))


def action_label(mail: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """(id, action, timing, response_seconds): the first rule that holds, of replied, starred, archived, ignored, pending; own messages are COMPOSED.

    contacts: (email, emails_from) if they are known already; without them no sender counts as frequent.
    """
    cutoff = mail.agg(F.max("date_parsed").alias("as_of"))
    base = mail.join(first_own_reply(mail), "message_id", "left").crossJoin(F.broadcast(cutoff))
    frequent = F.lit(False)
    if contacts is not None:
        often = contacts.filter("emails_from > 20").select(F.lower("email").alias("_often")).distinct()
        base = base.join(often, F.lower("from_email") == F.col("_often"), "left")
        frequent = F.col("_often").isNotNull()
    has = lambda label: F.coalesce(F.array_contains("labels", label), F.lit(False))
    lacks = lambda label: F.coalesce(~F.array_contains("labels", label), F.lit(False))
    old = F.col("date_parsed") < F.col("as_of") - F.expr("INTERVAL 7 DAYS")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    archived = old & (has("Archived") | (lacks("Unread") & lacks("Inbox")) | (n("cc_emails") >= 1) | (n("to_emails") > 1) | frequent)
    ignored = old & has("Unread") & (n("cc_emails") == 0) & (n("to_emails") <= 1) & ~frequent
    action = F.when(F.col("is_sent"), "COMPOSED").when(F.col("reply_at").isNotNull(), "REPLIED").when(has("Starred"), "STARRED").when(archived, "ARCHIVED").when(ignored, "IGNORED").otherwise("PENDING")
    seconds = F.when(~F.col("is_sent"), seconds_between(instant(F.col("reply_at")), instant(F.col("date_parsed"))))
    out = base.withColumn("action", action).withColumn("response_seconds", seconds)
    timing = F.when(F.col("action") == "REPLIED", response_bucket(F.col("response_seconds"))).when(F.col("action").isin("ARCHIVED", "IGNORED"), "NEVER")
    return out.select("id", "action", timing.alias("timing"), F.round("response_seconds", 6).alias("response_seconds"))


def reverse_tracking(mail: DataFrame) -> DataFrame:
    """(id, response_seconds, timing) of own messages that people, not automatons, have answered."""
    sender, subject = F.lower("from_email"), F.lower("subject")
    human = F.lit(True)
    for word in AUTO_SENDERS:
        human = human & ~sender.contains(word)
    for word in AUTO_SUBJECTS:
        human = human & ~subject.contains(word)
    answers = mail.filter(~F.col("is_sent") & F.col("in_reply_to").isNotNull()).filter(human).select(F.col("in_reply_to").alias("message_id"), F.col("date_parsed").alias("answer_at"))
    own = mail.filter("is_sent").select("id", "message_id", "date_parsed")
    first = own.join(answers, "message_id").filter("answer_at > date_parsed").groupBy("id", "date_parsed").agg(F.min("answer_at").alias("answer_at"))
    first = first.select("id", seconds_between(instant(F.col("answer_at")), instant(F.col("date_parsed"))).alias("s"))
    return first.select("id", F.round("s", 6).alias("response_seconds"), response_bucket(F.col("s")).alias("timing"))


def roles(mail: DataFrame) -> DataFrame:
    """One row per address and role (from, to, cc) of each message, in one pass."""
    people = F.concat(
        F.array(F.struct(F.col("from_email").alias("email"), F.lit("from").alias("role"))),
        F.transform(F.coalesce("to_emails", F.array()), lambda e: F.struct(e.alias("email"), F.lit("to").alias("role"))),
        F.transform(F.coalesce("cc_emails", F.array()), lambda e: F.struct(e.alias("email"), F.lit("cc").alias("role"))),
    )
    rows = mail.select("id", "thread_id", "date_parsed", "from_name", "in_reply_to", F.explode(people).alias("p"))
    return rows.select("*", F.lower(F.trim("p.email")).alias("email"), F.col("p.role").alias("role")).drop("p").filter(F.col("email").contains("@"))


def contact_profile(mail: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """One row per address: messages from and to, threads, replies, first and last contact, importance (never of `own` addresses).

    One exploded pass, summed up by address and thread first: the own address is in nearly every row, but only once in a thread.
    """
    return contact_totals(contact_parts(mail), own)


def contact_parts(mail: DataFrame) -> DataFrame:
    """What contact_profile() needs, by address and thread; parts of several batches can be summed up."""
    sender = F.col("role") == "from"
    return roles(mail).groupBy("email", "thread_id").agg(
        F.max(F.when(sender, F.col("from_name"))).alias("name"),
        F.count_if(sender).alias("emails_from"),
        F.count_if(~sender).alias("emails_to"),
        F.count_if(sender & F.col("in_reply_to").isNotNull()).alias("reply_count"),
        F.min("date_parsed").alias("first_contact"),
        F.max("date_parsed").alias("last_contact"),
    )


def contact_totals(by_thread: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """contact_profile() of its parts."""
    out = by_thread.groupBy("email").agg(
        F.max("name").alias("name"), F.sum("emails_from").alias("emails_from"), F.sum("emails_to").alias("emails_to"), F.count("thread_id").alias("threads_with"),
        F.sum("reply_count").alias("reply_count"), F.min("first_contact").alias("first_contact"), F.max("last_contact").alias("last_contact"),
    )
    rate = F.when(F.col("emails_to") > 0, F.least(F.lit(1.0), F.col("reply_count") / F.col("emails_to"))).when(F.col("emails_from") > 0, 0.0)
    out = out.withColumn("reply_rate", F.round(rate, 6))
    important = (F.col("emails_from") > 0) & (((F.col("reply_rate") >= 0.5) & (F.col("emails_to") >= 2)) | ((F.col("emails_from") >= 3) & (F.col("emails_to") >= 3)) | (F.col("reply_rate") >= 0.8))
    return out.withColumn("is_important", F.coalesce(important, F.lit(False)) & ~F.col("email").isin(*[x.lower() for x in own]))


def sender_counts(mail: DataFrame) -> DataFrame:
    """Received messages per sender: in all and in the last 7, 30 and 90 days before the last date."""
    as_of = mail.agg(F.max("date_parsed").alias("as_of"))
    got = mail.filter(~F.col("is_sent")).crossJoin(F.broadcast(as_of))
    since = lambda days: F.count_if(F.col("date_parsed") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"))
    return got.groupBy(F.lower("from_email").alias("sender")).agg(F.count(F.lit(1)).alias("emails_all"), since(7).alias("emails_7d"), since(30).alias("emails_30d"), since(90).alias("emails_90d"), F.max("date_parsed").alias("last_received"))


def user_replies(mail: DataFrame) -> DataFrame:
    """Per sender the number of messages answered and the mean hours that took (earlier answers count, too)."""
    got = mail.filter(~F.col("is_sent")).select("id", "message_id", F.lower("from_email").alias("sender"), F.col("date_parsed").alias("at"))
    own = mail.filter(F.col("is_sent") & F.col("in_reply_to").isNotNull()).select(F.col("in_reply_to").alias("message_id"), F.col("date_parsed").alias("reply_at"))
    hours = seconds_between(instant(F.col("reply_at")), instant(F.col("at"))) / 3600
    return got.join(own, "message_id").groupBy("sender").agg(F.count_distinct("id").alias("user_replied_count"), F.round(F.avg(hours), 6).alias("avg_response_hours"))


def user_initiated(mail: DataFrame) -> DataFrame:
    """Own messages per recipient."""
    return mail.filter("is_sent").select(F.explode("to_emails").alias("to")).groupBy(F.lower("to").alias("sender")).agg(F.count(F.lit(1)).alias("user_initiated_count"))


def sender_reply_rate(mail: DataFrame, reciprocity: str = "as_written") -> DataFrame:
    """(sender, sender_reply_rate): the share of own messages that somebody has answered.

    As written it is by the own address (and so nearly always 0 once joined with those who write to it); "counterpart" has it by recipient.
    """
    answered = mail.filter(~F.col("is_sent") & F.col("in_reply_to").isNotNull()).select(F.col("in_reply_to").alias("message_id")).distinct().withColumn("_answered", F.lit(1.0))
    own = mail.filter("is_sent").join(answered, "message_id", "left").withColumn("_answered", F.coalesce("_answered", F.lit(0.0)))
    who = F.lower("from_email") if reciprocity == "as_written" else F.lower(F.explode("to_emails"))
    return own.select(who.alias("sender"), "_answered").groupBy("sender").agg(F.avg("_answered").alias("sender_reply_rate"))


def sender_stats(mail: DataFrame, reciprocity: str = "as_written") -> DataFrame:
    """The statistics above side by side for every sender of received mail; missing ones are 0."""
    out = sender_counts(mail).join(user_replies(mail), "sender", "left").join(user_initiated(mail), "sender", "left").join(sender_reply_rate(mail, reciprocity), "sender", "left")
    return out.fillna(0, ["user_replied_count", "user_initiated_count"]).fillna(0.0, ["avg_response_hours", "sender_reply_rate"])


def time_bucket(hour: Column) -> Column:
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon").when(hour.between(17, 20), "evening").otherwise("night")


def business_hours(hour: Column, day: Column) -> Column:
    """Monday to Friday from 9 to before 17."""
    return (day <= 4) & (hour >= 9) & (hour < 17)


def with_strength(rows: DataFrame) -> DataFrame:
    """Adds user_replied_rate, user_initiated_ratio, days_since_last and strength to messages with their sender's statistics and as_of."""
    n = lambda c: F.coalesce(c, F.lit(0))
    every, begun = n("emails_all"), n("user_initiated_count")
    rows = rows.withColumns({
        "user_replied_rate": F.when(every > 0, n("user_replied_count") / every).otherwise(0.0),
        "user_initiated_ratio": F.when(every + begun > 0, begun / (every + begun)).otherwise(0.0),
        "days_since_last": n(floor_days(instant(F.col("as_of")), instant(F.col("last_received")))),
    })
    recency = 1 - F.least(F.col("days_since_last") / 90.0, F.lit(1.0))
    total = 0.35 * F.least(n("emails_30d") / 10.0, F.lit(1.0)) + 0.45 * F.col("user_replied_rate") + 0.10 * F.coalesce("sender_reply_rate", F.lit(0.0)) + 0.05 * recency + 0.05 * F.col("user_initiated_ratio")
    return rows.withColumn("strength", clamp(total))


def urgency(strength: Column, days: Column, busy: Column, attached: Column) -> Column:
    """0 to 1 from relationship, age in days, business hours and an attachment."""
    recent = F.greatest(F.lit(0.0), 1 - days / 7.0)
    return clamp(0.4 * strength + 0.3 * recent + 0.2 * F.when(busy, 1.0).otherwise(0.5) + 0.1 * F.when(attached, 1.0).otherwise(0.0))


def time_features(mail: DataFrame) -> DataFrame:
    """Hour, weekday (Monday 0), time of day, weekend and business hours of received messages."""
    hour, day = F.coalesce(F.hour("date_parsed"), F.lit(0)).cast("long"), F.coalesce(F.weekday("date_parsed"), F.lit(0)).cast("long")
    return mail.filter(~F.col("is_sent")).select("id", hour.alias("hour"), day.alias("day_of_week"), time_bucket(hour).alias("time_bucket"), (day >= 5).alias("is_weekend"), business_hours(hour, day).alias("is_business_hours"))


def relationship_features(mail: DataFrame, reciprocity: str = "as_written") -> DataFrame:
    """(id, relationship_strength, urgency_score) of received messages; the only join is that with the sender's statistics."""
    as_of = mail.agg(F.max("date_parsed").alias("as_of"))
    got = mail.filter(~F.col("is_sent")).withColumn("sender", F.lower("from_email"))
    base = with_strength(got.join(sender_stats(mail, reciprocity), "sender", "left").crossJoin(F.broadcast(as_of)))
    hour, day = F.coalesce(F.hour("date_parsed"), F.lit(0)), F.coalesce(F.weekday("date_parsed"), F.lit(0))
    days = floor_days(instant(F.col("as_of")), instant(F.col("date_parsed")))
    score = urgency(F.col("strength"), days, business_hours(hour, day), F.array_contains("labels", "Has attachment"))
    return base.select("id", F.round("strength", 6).alias("relationship_strength"), F.round(score, 6).alias("urgency_score"))


def label_histogram(mail: DataFrame, top: int = 50) -> DataFrame:
    """The `top` most frequent labels."""
    return mail.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)


def inbox_page(mail: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Received messages, newest first: one page."""
    return mail.filter(~F.col("is_sent")).orderBy(F.desc_nulls_last("date_parsed"), "id").offset(offset).limit(limit).select("id", "thread_id", "from_email", "subject", "date_parsed")


def unanswered(mail: DataFrame) -> DataFrame:
    """Received messages that nobody has replied to."""
    replies = mail.filter(F.col("in_reply_to").isNotNull()).select(F.col("in_reply_to").alias("message_id"))
    return mail.filter(~F.col("is_sent")).join(replies, "message_id", "left_anti").select("id", "thread_id", "from_email")
