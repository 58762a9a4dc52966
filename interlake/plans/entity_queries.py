"""Registered queries of tasks, projects, contexts and clusters, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from interlake.operators import clusters as c
from interlake.operators import entities as e
from interlake.operators import mail as m
from interlake.operators import rules as r
from interlake.plans import queries, scoring
from interlake.plans.mailbox import MAIL_SQL, ME, VECTORS_SQL, messages, vectors


def _contacts(spark, sf_dir):
    return m.contact_profile(messages(spark, sf_dir))


def _people(spark, sf_dir):
    return r.real_person(messages(spark, sf_dir), _contacts(spark, sf_dir))


def _content(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", "cluster").join(messages(spark, sf_dir).filter("NOT is_sent").select("id"), "id")


def tasks_from_signals(spark, sf_dir, whole=False):
    return e.tasks_from_signals(scoring.QUERIES["detect_patterns"](spark, sf_dir, whole), messages(spark, sf_dir), _contacts(spark, sf_dir), _people(spark, sf_dir))


def projects_from_threads(spark, sf_dir):
    return e.projects_from_threads(messages(spark, sf_dir), _contacts(spark, sf_dir), ME)


def projects_from_clusters(spark, sf_dir):
    return e.projects_from_clusters(messages(spark, sf_dir), _content(spark, sf_dir), _people(spark, sf_dir), projects_from_threads(spark, sf_dir))


def priority_contexts(spark, sf_dir, whole=False, scores=None):
    mail = messages(spark, sf_dir)
    scores = scoring.QUERIES["priority_score"](spark, sf_dir, whole) if scores is None else scores
    return e.priority_contexts(mail, scores, _contacts(spark, sf_dir), m.thread_stats(mail), _people(spark, sf_dir))


def inbox_stats(spark, sf_dir, whole=False):
    scores = scoring.QUERIES["priority_score"](spark, sf_dir, whole)
    contexts = _people(spark, sf_dir).select(F.col("is_real_person").cast("double").alias("sender_importance"))
    return e.inbox_stats(messages(spark, sf_dir), tasks_from_signals(spark, sf_dir, whole), scores, contexts)


def cluster_meta(spark, sf_dir):
    """Content clusters beside the weekday as the temporal dimension's clusters."""
    mail = messages(spark, sf_dir)
    content = _content(spark, sf_dir).select("id", F.lit("content").alias("dimension"), F.col("cluster").cast("long").alias("cluster_id"))
    temporal = m.time_features(mail).select("id", F.lit("temporal").alias("dimension"), F.col("day_of_week").alias("cluster_id"))
    return c.cluster_meta(content.unionByName(temporal), m.action_label(mail), m.relationship_features(mail))


def cluster_activity(spark, sf_dir):
    return c.cluster_activity(messages(spark, sf_dir), _content(spark, sf_dir))


def detect_projects(spark, sf_dir):
    return c.detect_projects(cluster_meta(spark, sf_dir), cluster_activity(spark, sf_dir), min_score=0.3)


QUERIES = {
    "tasks_from_signals": tasks_from_signals,
    "task_counts": lambda spark, sf_dir, whole=False: e.task_counts(tasks_from_signals(spark, sf_dir, whole)),
    "task_page": lambda spark, sf_dir, whole=False: e.task_page(tasks_from_signals(spark, sf_dir, whole)),
    "projects_from_threads": projects_from_threads,
    "projects_from_clusters": projects_from_clusters,
    "priority_contexts": priority_contexts,
    "inbox_stats": inbox_stats,
    "cluster_meta": cluster_meta,
    "dim_stats": lambda spark, sf_dir: c.dim_stats(cluster_meta(spark, sf_dir)),
    "cluster_topk": lambda spark, sf_dir: c.cluster_topk(cluster_meta(spark, sf_dir), "content"),
    "cluster_activity": cluster_activity,
    "detect_projects": detect_projects,
}


def _cte(name: str) -> str:
    return f", {name} AS ({(queries.ORACLES | scoring.ORACLES | ORACLES)[name]})\n"


def _cut(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN left({text}, {most - 3}) || '...' ELSE {text} END"


ORACLES: dict[str, str] = {}
CONTENT_SQL = ", content AS (SELECT vectors.id, cluster FROM vectors JOIN mail USING (id) WHERE NOT is_sent)\n"
TITLE = "CASE WHEN name <> '' AND name <> from_email THEN '[' || name || '] ' ELSE '' END || coalesce(nullif(subject, ''), 'Task detected from email')"
ORACLES["tasks_from_signals"] = MAIL_SQL + _cte("detect_patterns") + _cte("contact_profile") + _cte("real_person") + f"""SELECT 'ai_' || id AS task_id, id AS email_id, {_cut(TITLE, 1000)} AS description,
  CASE WHEN has_approval THEN 'decision' WHEN has_request THEN 'follow_up' ELSE 'other' END AS task_type,
  round(CASE WHEN has_deadline THEN 0.7::DOUBLE WHEN has_approval THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN reply_rate > 0.5 THEN 0.1::DOUBLE ELSE 0 END, 6) AS urgency_score, 'pending' AS status
  FROM detect_patterns JOIN mail USING (id) JOIN real_person USING (id) LEFT JOIN contact_profile p ON p.email = from_email WHERE is_real_person AND (has_request OR has_deadline OR has_approval)"""
_TASKS = "WITH" + _cte("tasks_from_signals")[1:]
ORACLES["task_counts"] = _TASKS + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'dismissed') AS dismissed, count(*) FILTER (WHERE status = 'pending' AND urgency_score > 0.7) AS urgent FROM tasks_from_signals"""
ORACLES["task_page"] = _TASKS + "SELECT * FROM tasks_from_signals ORDER BY urgency_score DESC NULLS LAST, email_id LIMIT 50"
PROJECT = "'Conversation: ' || CASE WHEN name <> '' AND name <> email THEN name ELSE split_part(email, '@', 1) END || CASE WHEN length(s) > 5 AND NOT contains(left(s, 50), 'Re:') AND NOT contains(left(s, 50), 'Fwd:') THEN ' - ' || left(s, 50) ELSE '' END"
ORACLES["projects_from_threads"] = MAIL_SQL + _cte("contact_profile") + f""", talks AS (SELECT from_email AS email, count(DISTINCT id) AS email_count, count(DISTINCT thread_id) AS thread_count, max(date_parsed) AS last_activity, min(left(subject, 100)) AS s
  FROM mail WHERE NOT is_sent GROUP BY 1 HAVING count(DISTINCT id) >= 2)
SELECT email AS owner_email, {_cut(PROJECT, 200)} AS name, CASE WHEN is_important THEN 'key_relationship' WHEN reply_rate > 0.5 THEN 'active_conversation' ELSE 'conversation' END AS project_type,
  CASE WHEN is_important THEN 0.95::DOUBLE WHEN reply_rate > 0.5 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence, email_count, thread_count, last_activity
FROM contact_profile JOIN talks USING (email) WHERE reply_rate > 0 AND NOT (email LIKE '%@corp.test' AND contains(email, 'me'))"""
ORACLES["projects_from_clusters"] = MAIL_SQL + VECTORS_SQL + CONTENT_SQL + _cte("real_person") + _cte("projects_from_threads") + f""", found AS (SELECT cluster, count(*) AS email_count, count(*) FILTER (WHERE is_real_person) AS real_person_count, min(left(subject, 60)) AS s,
    bool_or(from_email IN (SELECT owner_email FROM projects_from_threads)) AS covered FROM mail JOIN content USING (id) LEFT JOIN real_person USING (id) GROUP BY 1)
SELECT CAST(cluster AS BIGINT) AS cluster_id, CASE WHEN real_person_count / email_count < 0.5 THEN 'few_real' WHEN covered THEN 'covered' ELSE 'created' END AS outcome,
  coalesce(nullif(s, ''), 'Topic Cluster ' || cluster) AS name, round(least(0.9::DOUBLE, 0.5::DOUBLE + real_person_count / email_count * 0.4::DOUBLE), 6) AS confidence, email_count, real_person_count FROM found WHERE email_count >= 3 AND real_person_count > 0"""
ORACLES["priority_contexts"] = MAIL_SQL + _cte("priority_score") + _cte("contact_profile") + _cte("thread_stats") + _cte("real_person") + f""", known AS (SELECT mail.id, mail.from_email, mail.thread_id, date_parsed, priority_score, sender_novelty, reply_rate, emails_from, is_important,
    t.email_count, coalesce(is_real_person, false) AS really, {queries.SECONDS.format("(SELECT max(date_parsed) FROM mail)", "date_parsed")} / 3600 AS age
  FROM mail JOIN priority_score USING (id) LEFT JOIN contact_profile p ON p.email = from_email LEFT JOIN thread_stats t ON t.thread_id = mail.thread_id LEFT JOIN real_person ON real_person.id = mail.id)
SELECT id, from_email AS sender_email, CAST(coalesce(emails_from, 0) AS DOUBLE) AS sender_frequency, CASE WHEN really THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sender_importance, nullif(reply_rate, 0) AS sender_reply_rate,
  thread_id, email_count AS thread_length, round(age, 6) AS age_hours, hour(date_parsed) BETWEEN 9 AND 17 AND isodow(date_parsed) < 6 AS is_business_hours,
  round(CASE WHEN really THEN 0.5::DOUBLE + CASE WHEN is_important THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN reply_rate > 0.5 THEN 0.2::DOUBLE ELSE 0 END ELSE 0.1::DOUBLE END, 6) AS people_score,
  CASE WHEN age < 24 THEN 0.8::DOUBLE WHEN age < 72 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS temporal_score,
  round(CASE WHEN really THEN 0.5::DOUBLE + CASE WHEN reply_rate > 0 THEN least(0.5::DOUBLE, reply_rate) ELSE 0 END ELSE 1 - coalesce(nullif(sender_novelty, 0), 0.5::DOUBLE) END, 12) AS relationship_score,
  round(CASE WHEN really THEN least(1.0::DOUBLE, coalesce(nullif(priority_score, 0), 0.5::DOUBLE) * 1.5::DOUBLE) ELSE coalesce(nullif(priority_score, 0), 0.5::DOUBLE) * 0.5::DOUBLE END, 12) AS adjusted_priority FROM known"""
ORACLES["inbox_stats"] = MAIL_SQL + _cte("priority_score") + _cte("tasks_from_signals") + _cte("real_person") + """SELECT (SELECT count(*) FROM mail WHERE NOT is_sent) AS total_emails, (SELECT count(*) FROM tasks_from_signals) AS pending_tasks,
  (SELECT count(*) FROM priority_score WHERE priority_score > 0.7) AS urgent_emails, (SELECT round(avg(priority_score), 6) FROM priority_score) AS avg_priority_score, (SELECT count(*) FROM real_person WHERE is_real_person) AS from_real_people, 0 AS unread_count"""
ORACLES["cluster_meta"] = MAIL_SQL + VECTORS_SQL + CONTENT_SQL + _cte("time_features") + _cte("action_label") + _cte("relationship_features") + """, long AS (SELECT id, 'content' AS dimension, CAST(cluster AS BIGINT) AS cluster_id FROM content UNION ALL SELECT id, 'temporal', day_of_week FROM time_features)
SELECT dimension, cluster_id, count(*) AS size, min(id) AS representative_email_id, round(count(*) FILTER (WHERE action = 'REPLIED') * 100.0::DOUBLE / count(*), 1) AS pct_replied,
  round(avg(coalesce(response_seconds / 3600, 0)), 1) AS avg_response_time_hours, round(avg(coalesce(relationship_strength, 0)), 3) AS avg_relationship_strength
FROM long JOIN action_label USING (id) LEFT JOIN relationship_features USING (id) GROUP BY 1, 2"""
_META = "WITH" + _cte("cluster_meta")[1:]
ORACLES["dim_stats"] = _META + "SELECT dimension, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS messages, round(avg(size), 6) AS mean_size, max(size) AS largest, min(size) AS smallest FROM cluster_meta GROUP BY 1"
ORACLES["cluster_topk"] = _META + "SELECT * FROM cluster_meta WHERE dimension = 'content' ORDER BY size DESC, cluster_id LIMIT 100"
ORACLES["cluster_activity"] = MAIL_SQL + VECTORS_SQL + CONTENT_SQL + """, n AS (SELECT max(date_parsed) AS a FROM mail),
found AS (SELECT CAST(cluster AS BIGINT) AS cluster_id, min(date_parsed) AS first_activity, max(date_parsed) AS last_activity, count(*) AS email_count, count(DISTINCT from_email) AS participant_count,
    count(*) FILTER (WHERE date_parsed > a - INTERVAL 7 DAY) AS emails_7d, count(*) FILTER (WHERE date_parsed > a - INTERVAL 30 DAY) AS emails_30d,
    count(*) FILTER (WHERE date_parsed > a - INTERVAL 14 DAY AND date_parsed <= a - INTERVAL 7 DAY) AS emails_prev_7d, CAST(floor((epoch_us(any_value(a)) - epoch_us(max(date_parsed))) / 86400000000) AS BIGINT) AS days_since
  FROM mail JOIN content USING (id), n GROUP BY 1),
moving AS (SELECT *, least(emails_7d / 7.0::DOUBLE, 5.0) / 5 AS v, CASE WHEN emails_prev_7d > 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (emails_7d - emails_prev_7d) / emails_prev_7d)) WHEN emails_7d > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM found)
SELECT * EXCLUDE (v, t), round(v, 6) AS velocity, round(t, 6) AS trend, round(exp(-days_since * ln(2) / 7) * 0.35::DOUBLE + v * 0.35::DOUBLE + (t + 1) / 2 * 0.30::DOUBLE, 6) AS temporal_strength FROM moving"""
ORACLES["detect_projects"] = _META + _cte("cluster_activity") + """, top AS (SELECT *, pct_replied / 100 AS share FROM (SELECT * FROM cluster_meta WHERE dimension = 'content' ORDER BY size DESC, cluster_id LIMIT 100) LEFT JOIN cluster_activity USING (cluster_id)),
scored AS (SELECT *, round(CASE WHEN size >= 5 THEN least(size / 50, 1.0::DOUBLE) * 0.25::DOUBLE ELSE 0 END + CASE WHEN share >= 0.2::DOUBLE THEN least(share / 0.5::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE ELSE 0 END
    + CASE WHEN participant_count >= 2 THEN least(participant_count / 10, 1.0::DOUBLE) * 0.2::DOUBLE ELSE 0 END + CASE WHEN days_since < 14 THEN (1 - days_since / 14) * 0.25::DOUBLE ELSE 0 END, 6) AS score FROM top)
SELECT cluster_id, score >= 0.3::DOUBLE AS is_project, CASE WHEN score >= 0.3::DOUBLE THEN CASE WHEN days_since > 30 THEN 'completed' WHEN days_since > 14 THEN 'stale' ELSE 'active' END END AS status, score AS confidence,
  concat_ws(', ', CASE WHEN size >= 5 THEN 'size=' || size END, CASE WHEN share >= 0.2::DOUBLE THEN printf('engagement=%.1f%%', share * 100) END, CASE WHEN participant_count >= 2 THEN 'participants=' || participant_count END,
    CASE WHEN days_since < 14 THEN 'days_since=' || days_since END) AS reason FROM scored"""
