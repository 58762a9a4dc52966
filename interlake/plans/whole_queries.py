"""The mailbox queries on whole texts and whole tables: no 400-character bodies and no modulo halves.

The queries of the same names without _whole, and their SQL, keep the inputs that FIXTURES.md lays down.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from interlake.operators import changes as c
from interlake.plans import change_queries, entity_queries, scoring
from interlake.plans.mailbox import BODY_SQL, MAIL_SQL, WHOLE_BODY_SQL, messages

#: Queries that read body_text, themselves or through what they build on.
BODY_QUERIES = [
    "detect_service", "detect_patterns", "handleability", "category_counts", "priority_score", "priority_rank",
    "tasks_from_signals", "task_counts", "task_page", "priority_contexts", "inbox_stats",
]
SHIFT = 500  # the batch's keys: all but so many are the target's, too


def _tables(spark, sf_dir):
    """The whole mailbox, and a changed copy of all of it under keys further on."""
    mail = messages(spark, sf_dir).select("id", "message_id", "subject", "from_email")
    later = F.col("id") + SHIFT
    return mail, mail.select(later.alias("id"), F.format_string("<m%d@mail.test>", later).alias("message_id"), F.concat(F.lit("new "), "subject").alias("subject"), "from_email")


_FOUND = scoring.QUERIES | entity_queries.QUERIES
QUERIES = {f"{n}_whole": partial(_FOUND[n], whole=True) for n in BODY_QUERIES} | {
    "parse_message_whole": partial(change_queries.parse_message, whole=True),
    "insert_if_absent_whole": lambda spark, sf_dir: c.insert_if_absent(*_tables(spark, sf_dir), "message_id", "id"),
    "upsert_whole": lambda spark, sf_dir: c.upsert(*_tables(spark, sf_dir), "message_id"),
    "update_from_whole": lambda spark, sf_dir: c.update_from(*_tables(spark, sf_dir), "message_id", "subject"),
    "delete_by_predicate_whole": lambda spark, sf_dir: c.delete_where(_tables(spark, sf_dir)[0], "from_email LIKE '%@svc.test'"),
}

TABLES_SQL = MAIL_SQL + f""", target AS (SELECT id, message_id, subject, from_email FROM mail), batch AS (SELECT id + {SHIFT} AS id, '<m' || (id + {SHIFT}) || '@mail.test>' AS message_id, 'new ' || subject AS subject, from_email FROM mail)
"""
_SAID = scoring.ORACLES | entity_queries.ORACLES
ORACLES = {f"{n}_whole": _SAID[n].replace(BODY_SQL, WHOLE_BODY_SQL) for n in BODY_QUERIES} | {
    "parse_message_whole": change_queries.ORACLES["parse_message"].replace("phrase AS body", "body_text AS body").replace("FROM mail", "FROM bodies").replace(MAIL_SQL, MAIL_SQL + WHOLE_BODY_SQL),
    "insert_if_absent_whole": TABLES_SQL + "SELECT * FROM batch WHERE message_id NOT IN (SELECT message_id FROM target)",
    "upsert_whole": TABLES_SQL + "SELECT * FROM batch UNION ALL SELECT * FROM target WHERE message_id NOT IN (SELECT message_id FROM batch)",
    "update_from_whole": TABLES_SQL + "SELECT target.id, target.message_id, coalesce(batch.subject, target.subject) AS subject, target.from_email FROM target LEFT JOIN batch USING (message_id)",
    "delete_by_predicate_whole": TABLES_SQL + "SELECT * FROM target WHERE from_email NOT LIKE '%@svc.test'",
}
