"""Registered queries of the message operators, with their DuckDB oracles."""

from __future__ import annotations

from interlake.operators import mail as m
from interlake.plans.mailbox import MAIL_SQL, messages

TIMING = "CASE WHEN {0} < 3600 THEN 'IMMEDIATE' WHEN {0} < 86400 THEN 'SAME_DAY' WHEN {0} < 172800 THEN 'NEXT_DAY' ELSE 'LATER' END"
SECONDS = "(epoch_us({0}) - epoch_us({1})) / 1e6"

ROLES_SQL = """, roles AS (SELECT id, thread_id, date_parsed, from_name, in_reply_to, from_email AS email, 'from' AS role FROM mail
  UNION ALL SELECT id, thread_id, date_parsed, from_name, in_reply_to, unnest(to_emails), 'to' FROM mail
  UNION ALL SELECT id, thread_id, date_parsed, from_name, in_reply_to, unnest(cc_emails), 'cc' FROM mail WHERE cc_emails IS NOT NULL)
"""
STATS_SQL = f""", counts AS (SELECT from_email AS sender, count(*) AS emails_all, count(*) FILTER (WHERE date_parsed >= a - INTERVAL 7 DAY) AS emails_7d,
  count(*) FILTER (WHERE date_parsed >= a - INTERVAL 30 DAY) AS emails_30d, count(*) FILTER (WHERE date_parsed >= a - INTERVAL 90 DAY) AS emails_90d, max(date_parsed) AS last_received
  FROM mail, (SELECT max(date_parsed) AS a FROM mail) WHERE NOT is_sent GROUP BY 1),
replies AS (SELECT r.from_email AS sender, count(DISTINCT r.id) AS user_replied_count, round(avg({SECONDS.format("s.date_parsed", "r.date_parsed")} / 3600), 6) AS avg_response_hours
  FROM mail r JOIN mail s ON s.in_reply_to = r.message_id WHERE s.is_sent AND NOT r.is_sent GROUP BY 1),
rates AS (SELECT lower(from_email) AS sender, avg(CASE WHEN EXISTS (SELECT 1 FROM mail r WHERE r.in_reply_to = s.message_id AND NOT r.is_sent) THEN 1.0::DOUBLE ELSE 0 END) AS sender_reply_rate FROM mail s WHERE is_sent GROUP BY 1),
begun AS (SELECT lower(t) AS sender, count(*) AS user_initiated_count FROM (SELECT unnest(to_emails) AS t FROM mail WHERE is_sent) GROUP BY 1),
stats AS (SELECT counts.*, coalesce(user_replied_count, 0) AS user_replied_count, coalesce(avg_response_hours, 0) AS avg_response_hours, coalesce(user_initiated_count, 0) AS user_initiated_count, coalesce(sender_reply_rate, 0) AS sender_reply_rate
  FROM counts LEFT JOIN replies USING (sender) LEFT JOIN begun USING (sender) LEFT JOIN rates USING (sender))
"""
TIME_SQL = """, hours AS (SELECT id, hour(date_parsed) AS h, isodow(date_parsed) - 1 AS d FROM mail WHERE NOT is_sent),
times AS (SELECT id, h AS hour, d AS day_of_week, CASE WHEN h BETWEEN 5 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_bucket,
  d >= 5 AS is_weekend, d <= 4 AND h >= 9 AND h < 17 AS is_business_hours FROM hours)
"""


def _actions_sql(frequent: str) -> str:
    return f""", answered AS (SELECT r.message_id, min(s.date_parsed) AS reply_at FROM mail r JOIN mail s ON s.in_reply_to = r.message_id WHERE s.is_sent AND NOT r.is_sent AND s.date_parsed > r.date_parsed GROUP BY 1),
often AS ({frequent}),
base AS (SELECT mail.*, reply_at, often.email IS NOT NULL AS frequent, date_parsed < (SELECT max(date_parsed) FROM mail) - INTERVAL 7 DAY AS old
  FROM mail LEFT JOIN answered USING (message_id) LEFT JOIN often ON often.email = lower(mail.from_email)),
acted AS (SELECT id, CASE WHEN is_sent THEN 'COMPOSED' WHEN reply_at IS NOT NULL THEN 'REPLIED' WHEN list_contains(labels, 'Starred') THEN 'STARRED'
    WHEN old AND (list_contains(labels, 'Archived') OR (NOT list_contains(labels, 'Unread') AND NOT list_contains(labels, 'Inbox')) OR coalesce(len(cc_emails), 0) >= 1 OR len(to_emails) > 1 OR frequent) THEN 'ARCHIVED'
    WHEN old AND list_contains(labels, 'Unread') AND coalesce(len(cc_emails), 0) = 0 AND len(to_emails) <= 1 AND NOT frequent THEN 'IGNORED' ELSE 'PENDING' END AS action,
  CASE WHEN NOT is_sent THEN {SECONDS.format("reply_at", "date_parsed")} END AS s FROM base)
SELECT id, action, CASE WHEN action = 'REPLIED' THEN {TIMING.format("s")} WHEN action IN ('ARCHIVED', 'IGNORED') THEN 'NEVER' END AS timing, round(s, 6) AS response_seconds FROM acted
"""


def _on_mail(operator):
    return lambda spark, sf_dir: operator(messages(spark, sf_dir))


QUERIES = {
    "mailbox": lambda spark, sf_dir: messages(spark, sf_dir).select("id", "message_id", "in_reply_to", "thread_id", "date_parsed", "is_sent", "from_email", "from_name", "subject", "phrase", "has_attachments"),
    "thread_stats": _on_mail(m.thread_stats),
    "action_label": _on_mail(m.action_label),
    "action_label_contacts": _on_mail(lambda mail: m.action_label(mail, m.contact_profile(mail))),
    "reverse_tracking": _on_mail(m.reverse_tracking),
    "contact_profile": _on_mail(m.contact_profile),
    "sender_stats": _on_mail(m.sender_stats),
    "time_features": _on_mail(m.time_features),
    "relationship_features": _on_mail(m.relationship_features),
    "label_histogram": _on_mail(m.label_histogram),
    "inbox_page": _on_mail(m.inbox_page),
    "anti_unanswered": _on_mail(m.unanswered),
}

CONTACT_SQL = """, c AS (SELECT email, max(CASE WHEN role = 'from' THEN from_name END) AS name, count(*) FILTER (WHERE role = 'from') AS emails_from, count(*) FILTER (WHERE role <> 'from') AS emails_to,
  count(DISTINCT thread_id) AS threads_with, count(*) FILTER (WHERE role = 'from' AND in_reply_to IS NOT NULL) AS reply_count, min(date_parsed) AS first_contact, max(date_parsed) AS last_contact FROM roles GROUP BY email),
rated AS (SELECT *, round(CASE WHEN emails_to > 0 THEN least(1.0::DOUBLE, reply_count / emails_to) WHEN emails_from > 0 THEN 0.0::DOUBLE END, 6) AS reply_rate FROM c)
SELECT *, emails_from > 0 AND ((reply_rate >= 0.5 AND emails_to >= 2) OR (emails_from >= 3 AND emails_to >= 3) OR reply_rate >= 0.8) AS is_important FROM rated
"""

_NOT_LIKE = " AND ".join([f"lower(r.from_email) NOT LIKE '%{w}%'" for w in m.AUTO_SENDERS] + [f"lower(r.subject) NOT LIKE '%{w}%'" for w in m.AUTO_SUBJECTS])

ORACLES = {
    "mailbox": MAIL_SQL + "SELECT id, message_id, in_reply_to, thread_id, date_parsed, is_sent, from_email, from_name, subject, phrase, has_attachments FROM mail",
    "thread_stats": MAIL_SQL + f""", gaps AS (SELECT *, {SECONDS.format("date_parsed", "lag(date_parsed) OVER (PARTITION BY thread_id ORDER BY date_parsed, id)")} AS gap FROM mail)
SELECT thread_id, min(subject) AS subject, string_agg(DISTINCT from_email, ',' ORDER BY from_email) AS participants, count(*) AS email_count, count(*) FILTER (WHERE is_sent) AS your_email_count,
  count(*) FILTER (WHERE is_sent AND in_reply_to IS NOT NULL) AS your_reply_count, min(date_parsed) AS started_at, max(date_parsed) AS last_activity,
  round({SECONDS.format("max(date_parsed)", "min(date_parsed)")}, 6) AS thread_duration_seconds, round(avg(gap) FILTER (WHERE gap >= 0), 6) AS avg_response_time_seconds,
  bool_or(has_attachments) AS has_attachments, CAST(coalesce(sum(attachment_count), 0) AS BIGINT) AS total_attachment_count FROM gaps GROUP BY thread_id""",
    "action_label": MAIL_SQL + _actions_sql("SELECT NULL::VARCHAR AS email WHERE false"),
    "action_label_contacts": MAIL_SQL + ROLES_SQL + _actions_sql("SELECT email FROM roles WHERE role = 'from' GROUP BY email HAVING count(*) > 20"),
    "reverse_tracking": MAIL_SQL + f""", first AS (SELECT s.id, {SECONDS.format("min(r.date_parsed)", "any_value(s.date_parsed)")} AS s FROM mail s JOIN mail r ON r.in_reply_to = s.message_id
  WHERE s.is_sent AND NOT r.is_sent AND r.date_parsed > s.date_parsed AND {_NOT_LIKE} GROUP BY s.id) SELECT id, round(s, 6) AS response_seconds, {TIMING.format("s")} AS timing FROM first""",
    "contact_profile": MAIL_SQL + ROLES_SQL + CONTACT_SQL,
    "sender_stats": MAIL_SQL + STATS_SQL + "SELECT * FROM stats",
    "time_features": MAIL_SQL + TIME_SQL + "SELECT * FROM times",
    "relationship_features": MAIL_SQL + STATS_SQL + TIME_SQL + """, joined AS (SELECT mail.*, stats.*, times.is_business_hours AS busy, (SELECT max(date_parsed) FROM mail) AS as_of FROM mail JOIN stats ON stats.sender = lower(mail.from_email) JOIN times ON times.id = mail.id WHERE NOT is_sent),
strong AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE * least(emails_30d / 10.0::DOUBLE, 1.0) + 0.45::DOUBLE * (user_replied_count / emails_all) + 0.10::DOUBLE * sender_reply_rate
    + 0.05::DOUBLE * (1 - least(floor((epoch_us(as_of) - epoch_us(last_received)) / 86400000000) / 90.0::DOUBLE, 1.0)) + 0.05::DOUBLE * (user_initiated_count / (emails_all + user_initiated_count)))) AS strength FROM joined)
SELECT id, round(strength, 6) AS relationship_strength, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * strength + 0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - floor((epoch_us(as_of) - epoch_us(date_parsed)) / 86400000000) / 7.0::DOUBLE)
  + 0.2::DOUBLE * (CASE WHEN busy THEN 1.0 ELSE 0.5 END) + 0.1::DOUBLE * (CASE WHEN list_contains(labels, 'Has attachment') THEN 1.0 ELSE 0.0 END))), 6) AS urgency_score FROM strong""",
    "label_histogram": MAIL_SQL + "SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM mail) GROUP BY label ORDER BY n DESC, label LIMIT 50",
    "inbox_page": MAIL_SQL + "SELECT id, thread_id, from_email, subject, date_parsed FROM mail WHERE NOT is_sent ORDER BY date_parsed DESC NULLS LAST, id LIMIT 50",
    "anti_unanswered": MAIL_SQL + "SELECT id, thread_id, from_email FROM mail m WHERE NOT is_sent AND NOT EXISTS (SELECT 1 FROM mail r WHERE r.in_reply_to = m.message_id)",
}
