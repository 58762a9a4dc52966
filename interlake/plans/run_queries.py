"""Registered queries of whole runs: import report, header fields, entity extraction, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from interlake.functions import text as t
from interlake.operators import mail as m
from interlake.operators import rules as r
from interlake.operators.extraction import extract_all
from interlake.plans import feature_queries, scoring
from interlake.plans.entity_queries import CONTENT_SQL
from interlake.plans.entity_queries import ORACLES as ENTITY_ORACLES
from interlake.plans.mailbox import MAIL_SQL, ME, VECTORS_SQL, WHOLE_BODY_SQL, messages, vectors
from interlake.sources import mailbox_files as mf


def mailbox_report(spark, sf_dir):
    """Figures of the whole mailbox with whole bodies; the label list as one text."""
    found = mf.mailbox_report(messages(spark, sf_dir, body=True, whole=True), body="body_text")
    listed = F.array_join(F.transform("label_counts", lambda x: F.concat(x["label"], F.lit("="), x["count"].cast("string"))), "; ")
    return found.withColumn("label_counts", listed)


def header_fields(spark, sf_dir):
    """Labels, references, addresses and the date of every message, written as header values and parsed again."""
    quoted = F.array_join(F.transform("labels", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",\r\n ")
    own_id = F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("@mail.test"))
    references = F.concat(F.coalesce("in_reply_to", F.lit("")), F.lit("  junk\t"), own_id)
    sender = F.concat(F.lit('"'), F.coalesce("from_name", F.lit("")), F.lit('" <'), F.upper("from_email"), F.lit("> "))
    dated = F.date_format("date_parsed", "d MMM yyyy HH:mm:ss")
    rows = messages(spark, sf_dir).select("id", quoted.alias("q"), references.alias("r"), sender.alias("s"), F.array_join("to_emails", " ; ").alias("to"), F.concat(F.lit("Mon, "), dated, F.lit(" +0230 (there)")).alias("d"))
    labels, one = t.parse_labels(F.col("q")), t.parse_address(F.col("s"))
    return rows.select(
        "id", F.array_join(labels, "/").alias("labels"), t.is_sent_label(labels).alias("sent_label"), F.array_join(t.parse_references(F.col("r")), " ").alias("refs"), one["email"].alias("email"), one["name"].alias("name"),
        F.array_join(t.extract_addresses(F.col("to")), " ").alias("to_emails"), F.unix_seconds(t.parse_date(F.col("d"))).alias("seconds"),
    )


def _run(spark, sf_dir, whole=False, **earlier):
    mail = messages(spark, sf_dir)
    contacts = m.contact_profile(mail)
    content = vectors(spark, sf_dir).select("id", "cluster").join(mail.filter("NOT is_sent").select("id"), "id")
    answers = feature_queries._answers(spark, sf_dir).filter("NOT parse_error")
    scores = scoring.QUERIES["priority_score"](spark, sf_dir, whole)
    return extract_all(mail, contacts, r.real_person(mail, contacts), answers, scoring.QUERIES["detect_patterns"](spark, sf_dir, whole), content, scores, m.thread_stats(mail), ME, **earlier)


def extract_again(spark, sf_dir, whole=False):
    """The counts of a second run over what the first one made."""
    first = _run(spark, sf_dir, whole)
    projects = first["thread_projects"].select("owner_email").unionByName(first["cluster_projects"].select("cluster_id"), allowMissingColumns=True)
    return _run(spark, sf_dir, whole, tasks=first["tasks"], projects=projects, contexts=first["contexts"])["counts"]


QUERIES = {
    "mailbox_report": mailbox_report,
    "header_fields": header_fields,
    "label_counts": lambda spark, sf_dir: mf.label_counts(messages(spark, sf_dir)),
    "extract_all": lambda spark, sf_dir, whole=False: _run(spark, sf_dir, whole)["counts"],
    "extract_again": extract_again,
}

COUNTED = "(SELECT unnest(labels) AS label FROM mail)"
_EXTRACTED = MAIL_SQL + VECTORS_SQL + CONTENT_SQL + feature_queries.ANSWERS + "".join(
    f", {name} AS ({sql})\n" for name, sql in (
        ("told", feature_queries.ORACLES["tasks_from_llm"]), ("signed", ENTITY_ORACLES["tasks_from_signals"]), ("by_thread", ENTITY_ORACLES["projects_from_threads"]),
        ("by_cluster", ENTITY_ORACLES["projects_from_clusters"]), ("around", ENTITY_ORACLES["priority_contexts"]), ("people", scoring.ORACLES["real_person"]), ("patterns", scoring.ORACLES["detect_patterns"]),
    )
) + """, asked AS (SELECT id FROM patterns WHERE (has_request OR has_deadline OR has_approval) AND id NOT IN (SELECT email_id FROM told)),
nobody AS (SELECT id FROM people WHERE NOT is_real_person),
wanted AS (SELECT email_id AS id FROM answers WHERE action_type IN ('task', 'reply', 'decision'))
"""  # fmt: skip
DOWN = "(SELECT count(*) FROM {0} WHERE id IN (SELECT id FROM nobody))"
ORACLES = {
    "mailbox_report": MAIL_SQL + WHOLE_BODY_SQL + f""", counted AS (SELECT label, count(*) AS n FROM {COUNTED} GROUP BY 1)
SELECT count(*) AS total_emails, count(*) FILTER (WHERE body_text <> '') AS emails_with_body, count(*) FILTER (WHERE has_attachments) AS emails_with_attachments, 0::BIGINT AS errors,
  (SELECT count(*) FROM counted) AS n_labels, (SELECT string_agg(label || '=' || n, '; ' ORDER BY n DESC, label) FROM counted) AS label_counts FROM bodies""",
    "header_fields": MAIL_SQL + """SELECT id, array_to_string(labels, '/') AS labels, list_contains(labels, 'Sent') AS sent_label, CASE WHEN in_reply_to IS NULL THEN '' ELSE in_reply_to || ' ' END || '<m' || id || '@mail.test>' AS refs,
  from_email AS email, from_name AS name, array_to_string(to_emails, ' ') AS to_emails, CAST(floor(epoch_us(date_parsed) / 1000000) AS BIGINT) - 9000 AS seconds FROM mail""",
    "label_counts": MAIL_SQL + f"SELECT label, count(*) AS count FROM {COUNTED} GROUP BY 1",
    "extract_all": _EXTRACTED + f"""SELECT 'tasks_from_answers' AS kind, (SELECT count(*) FROM told) AS created, 0::BIGINT AS updated, {DOWN.format("wanted")} AS filtered
UNION ALL SELECT 'tasks_from_signals', (SELECT count(*) FROM signed WHERE email_id NOT IN (SELECT email_id FROM told)), 0, {DOWN.format("asked")}
UNION ALL SELECT 'projects_from_threads', (SELECT count(*) FROM by_thread), 0, 0
UNION ALL SELECT 'projects_from_clusters', (SELECT count(*) FROM by_cluster WHERE outcome = 'created'), 0, (SELECT count(*) FROM by_cluster WHERE outcome <> 'created')
UNION ALL SELECT 'priority_contexts', (SELECT count(*) FROM around), 0, 0""",
    "extract_again": _EXTRACTED + f"""SELECT 'tasks_from_answers' AS kind, 0::BIGINT AS created, (SELECT count(*) FROM told) AS updated, {DOWN.format("wanted")} AS filtered
UNION ALL SELECT 'tasks_from_signals', 0, 0, (SELECT count(*) FROM asked WHERE id IN (SELECT id FROM nobody) AND id NOT IN (SELECT email_id FROM signed))
UNION ALL SELECT 'projects_from_threads', 0, (SELECT count(*) FROM by_thread), 0
UNION ALL SELECT 'projects_from_clusters', 0, (SELECT count(*) FROM by_cluster WHERE outcome = 'created'), (SELECT count(*) FROM by_cluster WHERE outcome <> 'created')
UNION ALL SELECT 'priority_contexts', 0, (SELECT count(*) FROM around), 0""",
}
