"""Registered queries of raw messages, table changes and backfill phases, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from interlake.functions import text as t
from interlake.operators import changes as c
from interlake.plans.mailbox import MAIL_SQL, messages
from interlake.sources.mailbox_files import parse_messages, parse_push


def parse_message(spark, sf_dir, whole=False):
    """The mailbox as raw texts, parsed again; the body is the opening phrase, or with whole=True the whole text."""
    listed = lambda name: F.coalesce(F.array_join(name, ", "), F.lit(""))
    lines = [("Message-ID", F.col("message_id")), ("In-Reply-To", F.coalesce("in_reply_to", F.lit(""))), ("From", F.concat(F.coalesce("from_name", F.lit("")), F.lit(" <"), "from_email", F.lit(">")))]
    lines += [("To", listed("to_emails")), ("Cc", listed("cc_emails")), ("Subject", F.col("subject")), ("X-Gmail-Labels", F.array_join("labels", ","))]
    raw = F.concat(*[part for name, value in lines for part in (F.lit(name + ": "), value, F.lit("\n"))], F.lit("\n"), "body_text" if whole else "phrase")
    parsed = parse_messages(messages(spark, sf_dir, body=whole, whole=whole).select("id", raw.alias("raw"))).select("id", "record.*")
    sender = t.parse_address(F.col("from"))
    joined = lambda found: F.array_join(found, ",")
    return parsed.select(
        "id", "message_id", F.nullif("in_reply_to", F.lit("")).alias("in_reply_to"), sender["email"].alias("from_email"), sender["name"].alias("from_name"), joined(t.extract_addresses(F.col("to"))).alias("to_emails"),
        joined(t.extract_addresses(F.col("cc"))).alias("cc_emails"), "subject", joined(t.parse_labels(F.col("labels"))).alias("labels"), F.col("body"), "has_attachments",
    )


def _halves(spark, sf_dir):
    mail = messages(spark, sf_dir).select("id", "message_id", "subject", "from_email")
    return mail.filter("id % 3 = 0"), mail.filter("id % 2 = 0").withColumn("subject", F.concat(F.lit("new "), "subject"))


def push_source(spark, sf_dir):
    data = F.base64(F.to_json(F.struct(F.col("from_email").alias("emailAddress"), F.col("id").cast("string").alias("historyId"))).cast("binary"))
    pushed = messages(spark, sf_dir).select("id", parse_push(data).alias("n"))
    return pushed.select("id", F.col("n.emailAddress").alias("email"), F.col("n.historyId").cast("long").alias("history_id"))


QUERIES = {
    "parse_message": parse_message,
    "push_source": push_source,
    "insert_if_absent": lambda spark, sf_dir: c.insert_if_absent(*_halves(spark, sf_dir), "message_id", "id"),
    "upsert": lambda spark, sf_dir: c.upsert(*_halves(spark, sf_dir), "message_id"),
    "update_from": lambda spark, sf_dir: c.update_from(*_halves(spark, sf_dir), "message_id", "subject"),
    "delete_by_predicate": lambda spark, sf_dir: c.delete_where(_halves(spark, sf_dir)[1], "from_email LIKE '%@svc.test'"),
    "progressive_phases": lambda spark, sf_dir: c.progressive_phase(messages(spark, sf_dir)),
}

HALVES_SQL = MAIL_SQL + """, target AS (SELECT id, message_id, subject, from_email FROM mail WHERE id % 3 = 0), batch AS (SELECT id, message_id, 'new ' || subject AS subject, from_email FROM mail WHERE id % 2 = 0)
"""
ORACLES = {
    "parse_message": MAIL_SQL + """SELECT id, message_id, in_reply_to, from_email, from_name, array_to_string(to_emails, ',') AS to_emails, coalesce(array_to_string(cc_emails, ','), '') AS cc_emails, subject,
  array_to_string(labels, ',') AS labels, phrase AS body, false AS has_attachments FROM mail""",
    "push_source": MAIL_SQL + "SELECT id, from_email AS email, id AS history_id FROM mail",
    "insert_if_absent": HALVES_SQL + "SELECT * FROM batch WHERE message_id NOT IN (SELECT message_id FROM target)",
    "upsert": HALVES_SQL + "SELECT * FROM batch UNION ALL SELECT * FROM target WHERE message_id NOT IN (SELECT message_id FROM batch)",
    "update_from": HALVES_SQL + "SELECT target.id, target.message_id, coalesce(batch.subject, target.subject) AS subject, target.from_email FROM target LEFT JOIN batch USING (message_id)",
    "delete_by_predicate": HALVES_SQL + "SELECT * FROM batch WHERE from_email NOT LIKE '%@svc.test'",
    "progressive_phases": MAIL_SQL + """, aged AS (SELECT id, date_parsed, (SELECT max(date_parsed) FROM mail) AS a FROM mail)
SELECT id, CASE WHEN date_parsed > a - INTERVAL 7 DAY THEN 'quick' WHEN date_parsed > a - INTERVAL 30 DAY THEN 'recent' ELSE 'deep' END AS phase FROM aged WHERE date_parsed > a - INTERVAL 90 DAY""",
}
