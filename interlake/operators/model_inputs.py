"""What goes to an external model and what is made of its answers; the model itself isn't part of this library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.functions import text as t

#: Urgency of each word, tasks by action (fixed values).
URGENCY = {"immediate": 1.0, "today": 0.8, "this_week": 0.5, "whenever": 0.2, "none": 0.1}
TASK_TYPES = {"task": "other", "reply": "send", "decision": "decision"}
MOST_TOKENS = 8000
UNRANKED = 9999
PREVIEW = 800


def _mapped(c: Column, values: dict, other) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), values.items(), F.lit(other))


def wanted_by_model(mail: DataFrame, classified: DataFrame, least: int = 50) -> DataFrame:
    """Received messages that no rule settles, with more than `least` characters of text. mail has body_text or body_length."""
    open_ = classified.filter("handleability = 'needs_llm'").select("id", "llm_priority")
    length = F.col("body_length") if "body_length" in mail.columns else F.length("body_text")
    return mail.filter(~F.col("is_sent") & (length > least)).join(open_, "id")


def backlog(mail: DataFrame, classified: DataFrame, answers: DataFrame) -> DataFrame:
    """One row (total, processed, remaining)."""
    total = wanted_by_model(mail, classified).agg(F.count(F.lit(1)).alias("total"))
    done = answers.agg(F.count(F.lit(1)).alias("processed"))
    return total.crossJoin(done).withColumn("remaining", F.col("total") - F.col("processed"))


def with_model_context(wanted: DataFrame, features: DataFrame, actions: DataFrame, contacts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds the sender's relationship, the action taken, importance and rank. features: as email_features() gives them.

    body_preview is the first PREVIEW characters of body_text; where wanted has none, the caller joins it last, so that texts don't go through these joins.
    """
    shown = [F.left("body_text", F.lit(PREVIEW)).alias("body_preview")] if "body_text" in wanted.columns else []
    rows = wanted.select("id", "from_email", "subject", "date_parsed", *shown, "thread_id", "llm_priority")
    rows = rows.join(features.select(F.col("email_id").alias("id"), "relationship_strength", "user_replied_to_sender_rate", "is_service_email"), "id")
    rows = rows.join(actions.select("id", F.col("action").alias("actual_action")), "id", "left")
    rows = rows.join(contacts.select(F.lower("email").alias("_who"), F.col("is_important").alias("_important")), F.lower("from_email") == F.col("_who"), "left").drop("_who")
    rows = rows.join(ranks.select("id", F.col("priority_score").alias("_score"), F.col("priority_rank").alias("_rank")), "id", "left")
    rows = rows.withColumns({"is_important_sender": F.coalesce("_important", F.lit(False)), "priority_score": F.coalesce("_score", F.lit(0.0)), "priority_rank": F.coalesce("_rank", F.lit(UNRANKED))})
    return rows.drop("_important", "_score", "_rank")


def llm_batch(context: DataFrame, answers: DataFrame, limit: int = 50, seed: int = 42) -> DataFrame:
    """The next messages for the model: those without an answer, by priority, in a drawn order that a seed repeats."""
    todo = context.join(answers.select(F.col("email_id").alias("id")), "id", "left_anti")
    return todo.orderBy(*in_line(seed)).limit(limit)


def in_line(seed: int = 42) -> list[str | Column]:
    """The order of llm_batch(), which needs id and llm_priority only."""
    return ["llm_priority", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id"]


def prompt_fields(context: DataFrame) -> DataFrame:
    """(id, field columns) as strings, in the words that a prompt shows."""
    near, rank = F.col("relationship_strength"), F.col("priority_rank")
    shown = F.coalesce("body_preview", F.lit(""))
    marked = F.lower(shown).contains("<html") | F.lower(shown).contains("<head")
    bare = t.strip(F.regexp_replace(F.regexp_replace(shown, "<[^>]+>", " "), t.WS + "+", " "))
    body = F.left(F.when(marked, bare).otherwise(shown), F.lit(500))
    return context.select(
        "id", "from_email", "subject",
        F.coalesce(F.date_format("date_parsed", "yyyy-MM-dd"), F.lit("unknown")).alias("date"),
        F.when(body != "", body).otherwise("(empty body)").alias("body_preview"),
        F.when(near > 0.6, "STRONG").when(near > 0.3, "MODERATE").when(near > 0.1, "WEAK").otherwise("MINIMAL").alias("relationship_level"),
        F.round(F.coalesce("user_replied_to_sender_rate", F.lit(0.0)) * 100, 1).alias("reply_rate"),
        F.when(F.col("is_important_sender"), "Yes (high engagement history)").otherwise("No").alias("is_important"),
        F.when(F.col("is_service_email"), "Yes").otherwise("No").alias("is_service"),
        F.round("priority_score", 2).alias("priority_score"),
        F.when(rank < UNRANKED, rank.cast("string")).otherwise("N/A").alias("priority_rank"),
        F.col("llm_priority").cast("string").alias("llm_priority"),
    )


def filled_prompt(template: str, fields: DataFrame) -> DataFrame:
    """(id, prompt): {name} in the template stands for the column of that name; all in one expression, no Python."""
    parts, rest, names = [], template, set(fields.columns)
    while rest:
        before, brace, rest = rest.partition("{")
        parts.append(F.lit(before))
        if brace:
            name, close, rest = rest.partition("}")
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")) if close and name in names else F.lit("{" + name + close))
    return fields.select("id", F.concat(*parts).alias("prompt"))


def parse_reply(reply: Column) -> Column:
    """The JSON object of a model's answer as map<string,string>, out of a fenced block if there is one; null if it doesn't parse."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(F.trim(reply)), "map<string,string>", {"mode": "PERMISSIVE"})


def answers_from_replies(replies: DataFrame) -> DataFrame:
    """(email_id, action_type, urgency, next_step, one_liner, parse_error) of answers (email_id, reply)."""
    parsed = replies.select("email_id", parse_reply(F.col("reply")).alias("j"))
    named = [F.col("j")[c].alias(c) for c in ("action_type", "urgency", "next_step", "one_liner")]
    return parsed.select("email_id", *named, F.col("j").isNull().alias("parse_error"))


def tasks_from_answers(answers: DataFrame, mail: DataFrame, contacts: DataFrame, people: DataFrame) -> DataFrame:
    """Tasks of answers that ask for a task, reply or decision and come from a real person.

    answers: (email_id, action_type, urgency, one_liner); people: (id, is_real_person). One row per answer; repeated answers to a message of one type share a task_id.
    """
    rows = answers.filter(F.col("action_type").isin(*TASK_TYPES)).join(mail.select(F.col("id").alias("email_id"), "subject", "from_email"), "email_id")
    rows = rows.join(people.filter("is_real_person").select(F.col("id").alias("email_id")), "email_id")
    rows = rows.join(contacts.select(F.col("email").alias("from_email"), F.col("name").alias("sender_name"), "reply_rate"), "from_email", "left")
    base = _mapped(F.coalesce("urgency", F.lit("none")), URGENCY, 0.1)
    said = F.coalesce(F.nullif("one_liner", F.lit("")), F.nullif("subject", F.lit("")), F.lit("Task from email"))
    told = F.when((F.col("sender_name") != "") & (F.col("sender_name") != F.col("from_email")), F.concat(F.lit("["), "sender_name", F.lit("] "), said)).otherwise(said)
    return rows.select(
        F.concat(F.lit("llm_"), F.col("email_id").cast("string"), F.lit("_"), "action_type").alias("task_id"), "email_id",
        F.when(F.length(told) > 1000, F.concat(F.left(told, F.lit(997)), F.lit("..."))).otherwise(told).alias("description"),
        _mapped(F.col("action_type"), TASK_TYPES, "other").alias("task_type"),
        F.round(F.when(F.col("reply_rate") > 0.5, F.least(F.lit(1.0), base + 0.1)).otherwise(base), 6).alias("urgency_score"),
        F.lit("llm_real_person").alias("extraction_method"), F.lit("pending").alias("status"), F.col("from_email").alias("assigned_by"),
    )


def embedding_tier(is_service: Column, importance: Column, strength: Column) -> Column:
    """HIGH, MEDIUM or LOW."""
    service = F.when(importance >= 0.7, "HIGH").when(importance >= 0.4, "MEDIUM").otherwise("LOW")
    person = F.when(strength > 0.5, "HIGH").when(strength > 0.2, "MEDIUM").otherwise("LOW")
    return F.when(is_service, service).otherwise(person)


def embedding_text(subject: Column, clean_body: Column, is_service: Column, importance: Column, strength: Column) -> Column:
    """The text to embed: type and priority, subject, and as much of the cleaned body as the token budget leaves."""
    kind = F.when(is_service, "SERVICE").otherwise("PERSON")
    head = F.concat(F.lit("[TYPE: "), kind, F.lit("] [PRIORITY: "), embedding_tier(is_service, importance, strength), F.lit("]"))
    line = F.when(subject != "", F.concat(F.lit("[SUBJECT] "), t.strip(subject)))
    budget = MOST_TOKENS - t.token_count(F.concat_ws("\n", head, line)) - 20
    body = F.when((clean_body != "") & (budget > 100), F.concat(F.lit("[BODY] "), _cut_to(clean_body, budget)))
    return F.concat_ws("\n", head, line, body)


def _cut_to(c: Column, tokens: Column) -> Column:
    return F.when(F.length(c) > 2 * tokens, F.concat(F.substr(c, F.lit(1), (2 * tokens).cast("int")), F.lit("..."))).otherwise(c)


def embed_batch(mail: DataFrame, features: DataFrame, embedded: DataFrame, limit: int | None = 1000) -> DataFrame:
    """The next received messages without an embedding, by id, or all of them (None) in no order; missing features count as no service, 0.5 and 0.5. embedded: (id).

    body_text goes along if mail has it.
    """
    todo = mail.filter(~F.col("is_sent")).join(embedded.select("id"), "id", "left_anti")
    rows = todo.join(features.select(F.col("email_id").alias("id"), "is_service_email", "service_importance", "relationship_strength"), "id", "left")
    one = lambda c, v: F.coalesce(c, F.lit(v))
    rows = rows.select("id", "subject", *[c for c in mail.columns if c == "body_text"], one("is_service_email", False).alias("is_service"), one("service_importance", 0.5).alias("service_importance"), one("relationship_strength", 0.5).alias("relationship_strength"))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def embedding_counts(mail: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row (eligible, embedded)."""
    return mail.agg(F.count_if(~F.col("is_sent")).alias("eligible")).crossJoin(embedded.agg(F.count(F.lit(1)).alias("embedded")))


def long_enough(rows: DataFrame, column: str, least: int = 10) -> DataFrame:
    """Rows whose text isn't blank and has at least `least` characters."""
    return rows.filter((t.strip(F.col(column)) != "") & (F.length(column) >= least))
