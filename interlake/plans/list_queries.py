"""Registered queries of pages, keyed updates, cluster and project figures, API payloads and syncing, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from interlake.operators import changes, inbox, keyed, status
from interlake.operators import clusters as c
from interlake.operators import entities as e
from interlake.operators import mail as m
from interlake.plans import entity_queries, queries, scoring
from interlake.plans.mailbox import MAIL_SQL, ME, messages, vectors
from interlake.storage import stored
from interlake.sources import api_messages
from interlake.streaming import sync


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _projects(spark, sf_dir):
    """Thread projects with an id and a creation date, and the messages that belong to them."""
    found = entity_queries.projects_from_threads(spark, sf_dir).withColumnRenamed("owner_email", "project_id")
    links = messages(spark, sf_dir).filter("NOT is_sent").select(F.col("id").alias("email_id"), F.col("from_email").alias("project_id")).join(found.select("project_id"), "project_id", "left_semi")
    return found.withColumns({"created_at": F.col("last_activity"), "is_active": F.col("email_count") > 5}), links


def _tasks(spark, sf_dir, whole=False):
    """Tasks from signals, every third completed, with project and creation date."""
    mail = messages(spark, sf_dir).select(F.col("id").alias("email_id"), F.col("from_email").alias("project_id"), F.col("date_parsed").alias("created_at"))
    tasks = entity_queries.tasks_from_signals(spark, sf_dir, whole).join(mail, "email_id")
    return tasks.withColumns({"status": F.when(F.col("email_id") % 3 == 0, "completed").otherwise("pending"), "completed_at": F.lit(None).cast("timestamp_ntz")})


def inbox_priority_page(spark, sf_dir, limit=100, offset=20, whole=False):
    scores = stored(scoring.QUERIES["priority_score"](spark, sf_dir, whole))  # ranked, and told with each message of the page
    ranks = scoring.QUERIES["priority_rank"](spark, sf_dir, whole, scores).filter("id % 10 <> 0")
    projects, links = _projects(spark, sf_dir)
    return inbox.priority_inbox(messages(spark, sf_dir), ranks, entity_queries.priority_contexts(spark, sf_dir, whole, scores), _tasks(spark, sf_dir, whole), links, projects, limit, offset)


def _meta(spark, sf_dir):
    """Cluster rows with labels on two thirds of them, projects by their size, and the last message's date."""
    meta = entity_queries.cluster_meta(spark, sf_dir)
    activity = c.cluster_activity(messages(spark, sf_dir), vectors(spark, sf_dir).select("id", "cluster")).select(F.lit("content").alias("dimension"), "cluster_id", "last_activity")
    meta = meta.join(activity, ["dimension", "cluster_id"], "left")
    project = (F.col("dimension") == "content") & (F.col("cluster_id") % 2 == 0)
    return meta.withColumns({
        "auto_label": F.when(F.col("cluster_id") % 3 != 0, F.concat(F.lit("Label "), F.col("cluster_id").cast("string"))), "is_project": project,
        "project_status": F.when(project, F.when(F.col("cluster_id") % 4 == 0, "active").otherwise("stale")), "participant_count": F.lit(0).cast("long"),
    })


def _activity(spark, sf_dir):
    return c.cluster_activity(messages(spark, sf_dir), vectors(spark, sf_dir).select("id", "cluster")).filter("cluster_id <> 4")


def _found(spark, n):
    return spark.range(n).select((F.col("id") * 3).alias("cluster_id"), F.concat(F.lit("found "), F.col("id").cast("string")).alias("auto_label"), F.when(F.col("id") % 2 == 0, "active").otherwise("completed").alias("status"))


def _watches(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("watch_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("ended").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("expiration"))


def upsert_cluster_meta(spark, sf_dir):
    target = _meta(spark, sf_dir).select("dimension", "cluster_id", F.when(F.col("cluster_id") % 2 == 0, "u1").alias("user_id"), "size", "auto_label")
    batch = target.filter("cluster_id < 5").select("dimension", F.col("cluster_id") + 2, F.when((F.col("cluster_id") + 2) % 2 == 0, "u1").alias("user_id"), F.lit(1).cast("long").alias("size")).toDF("dimension", "cluster_id", "user_id", "size")
    return keyed.upsert_cluster_meta(target, batch)


def task_transition(spark, sf_dir, whole=False):
    tasks = _tasks(spark, sf_dir, whole)
    new = tasks.filter("email_id % 5 < 2").select("task_id", F.when(F.col("email_id") % 5 == 0, "completed").otherwise("dismissed").alias("status"), F.col("created_at").alias("at"))
    return keyed.task_transition(tasks, new).select("task_id", "status", "completed_at")


def upsert_repeated(spark, sf_dir):
    """A batch with two rows for some keys: the first by its date counts."""
    mail = messages(spark, sf_dir).select("id", "subject", "date_parsed")
    batch = mail.select(F.floor(F.col("id") / 2).cast("long").alias("id"), F.concat(F.lit("new "), "subject").alias("subject"), "date_parsed")
    return keyed.upsert_first(mail, batch, ["id"], "date_parsed", "subject")


def tasks_beside_known(spark, sf_dir, whole=False):
    """Tasks from signals where some messages have one already."""
    known = messages(spark, sf_dir).filter("id % 2 = 0").select(F.col("id").alias("email_id"))
    contacts = m.contact_profile(messages(spark, sf_dir))
    from interlake.operators import rules as r

    return e.tasks_from_signals(scoring.QUERIES["detect_patterns"](spark, sf_dir, whole), messages(spark, sf_dir), contacts, r.real_person(messages(spark, sf_dir), contacts), known)


def row_validation(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("odd").alias("status"), (F.col("o_totalprice") / 300000).alias("urgency_score"), F.repeat(F.lit("x"), (F.col("o_custkey") % 1100).cast("int")).alias("description"))
    return keyed.checked(rows, keyed.task_rules()).select("task_id", F.array_join("errors", ",").alias("errors"))


def _payloads(spark, sf_dir):
    """Every message as an API payload: text within parts within parts, an attachment on some."""
    mail = messages(spark, sf_dir)
    encoded = F.rtrim(F.translate(F.base64(F.encode(F.concat("phrase", F.lit("tëxt? "), F.col("id").cast("string")), "UTF-8")), "+/", "-_"), F.lit("="))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.array_compact(F.array(header("Message-ID", F.col("message_id")), header("SUBJECT", F.col("subject")), header("From", F.concat(F.coalesce(F.concat(F.lit('"'), "from_name", F.lit('" <')), F.lit("<")), F.upper("from_email"), F.lit(">"))), header("To", F.array_join("to_emails", ", ")), F.when(F.col("in_reply_to").isNotNull(), header("In-Reply-To", F.col("in_reply_to")))))
    leaf = F.struct(F.lit("text/plain; charset=utf-8").alias("mimeType"), F.lit("").alias("filename"), F.struct(encoded.alias("data")).alias("body"))
    inner = F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(leaf).alias("parts"))
    file = F.struct(F.lit("application/pdf").alias("mimeType"), F.when(F.col("has_attachments"), "a.pdf").otherwise("").alias("filename"))
    text = F.concat(F.lit('{"id":"g'), F.col("id").cast("string"), F.lit('","threadId":"'), "thread_id", F.lit('","historyId":"'), F.format_string("%09d", "id"), F.lit('","labelIds":'), F.when(F.col("is_sent"), F.lit('["SENT"]')).otherwise(F.lit('["INBOX","UNREAD"]')), F.lit(',"sizeEstimate":12,"payload":{"mimeType":"multipart/mixed","headers":'), F.to_json(headers), F.lit(',"parts":['), F.to_json(inner), F.lit(","), F.to_json(file), F.lit("]}}"))
    return mail.select(F.when(F.col("id") % 50 == 7, "{broken").otherwise(text).alias("value"))


def api_payload_parse(spark, sf_dir):
    got = api_messages.parse_payloads(_payloads(spark, sf_dir)).filter("NOT parse_error")
    return got.select("api_id", "thread_id", "history_id", "message_id", "subject", F.array_join("to_addresses", ",").alias("to_addresses"), "in_reply_to", "body_plain", "body_html", "has_attachments", "is_sent", "is_inbox", "is_unread", "is_starred", "size_bytes")


def api_to_record(spark, sf_dir):
    return api_messages.to_records(api_messages.parse_payloads(_payloads(spark, sf_dir))).select("api_id", "from_email", "from_name", F.array_join("to_emails", ",").alias("to_emails"), "body_text", F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("header_names"), F.col("headers")["in-reply-to"].alias("reply_header"), F.array_join("labels", ",").alias("labels"))


def _history(spark, sf_dir):
    return messages(spark, sf_dir).select(F.format_string("%09d", "id").alias("history_id"), F.when(F.col("id") % 3 == 0, F.lit("<m3@mail.test>")).otherwise(F.col("message_id")).alias("message_id"))


def incremental_ids(spark, sf_dir):
    known = messages(spark, sf_dir).filter("id % 4 = 0").select("message_id")
    return sync.incremental(_history(spark, sf_dir), known, "000004000")[0]


def phase_batches(spark, sf_dir):
    out = [sync.phase_batches(messages(spark, sf_dir), p).select("id", F.lit(p.name).alias("phase"), F.col("batch.day").alias("day"), F.col("batch.n").alias("n")) for p in sync.phases()]
    return out[0].union(out[1]).union(out[2])


def _users(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("USER"), F.col("c_custkey").cast("string"), F.lit("@corp.test")).alias("email"), (F.col("c_custkey") % 3 > 0).alias("sync_enabled"))


def _states(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.lit("idle").alias("status"), F.max("o_orderdate").alias("last_sync_at"), F.count(F.lit(1)).alias("emails_synced"))


def pipeline_status(spark, sf_dir, whole=False):
    tables = {"emails": messages(spark, sf_dir), "threads": m.thread_stats(messages(spark, sf_dir)), "embeddings": vectors(spark, sf_dir), "ai_classification": scoring.QUERIES["handleability"](spark, sf_dir, whole), "users": m.contact_profile(messages(spark, sf_dir)), "llm_classification": messages(spark, sf_dir).filter("id % 9 = 0"), "clusters": None}
    return status.pipeline_status(tables)


def _envelope(spark, sf_dir):
    rows = messages(spark, sf_dir).filter("NOT is_sent")
    return inbox.envelope(rows, inbox.page(rows, [F.asc("id")], 50, 8520), 50, 8520)


QUERIES = {
    "inbox_priority_page": inbox_priority_page,
    "page_envelope": _envelope,
    "task_page_created": lambda spark, sf_dir, whole=False: inbox.page(_tasks(spark, sf_dir, whole), [F.desc_nulls_last("urgency_score"), F.desc("created_at"), F.asc("task_id")]).select("task_id", "urgency_score", "created_at"),
    "task_detail": lambda spark, sf_dir, whole=False: inbox.task_detail(_tasks(spark, sf_dir, whole), _projects(spark, sf_dir)[0]).select("task_id", "project_name"),
    "project_page": lambda spark, sf_dir: inbox.project_page(_projects(spark, sf_dir)[0], active=True).select("project_id", "name", "last_activity"),
    "org_page": lambda spark, sf_dir: inbox.newest_page(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("org_id"), F.col("o_orderdate").alias("created_at")), "org_id", 20, 40),
    "project_count": lambda spark, sf_dir: status.project_count(_projects(spark, sf_dir)[0], active=True),
    "oldest_unanswered": lambda spark, sf_dir: inbox.oldest_unanswered(messages(spark, sf_dir)),
    "tenant_scope": lambda spark, sf_dir: inbox.tenant_scope(_watches(spark, sf_dir), 7),
    "optional_filters": lambda spark, sf_dir: inbox.optional_filters(_watches(spark, sf_dir), status="active", user_id=None),
    "point_lookup": lambda spark, sf_dir: inbox.point_lookup(_watches(spark, sf_dir), watch_id=33, status="ended"),
    "watch_active": lambda spark, sf_dir: inbox.active_watches(_watches(spark, sf_dir)),
    "expiring_soon": lambda spark, sf_dir: inbox.expiring_soon(_watches(spark, sf_dir), F.lit("1996-01-01").cast("timestamp_ntz"), 48),
    "project_clusters": lambda spark, sf_dir: inbox.project_clusters(_meta(spark, sf_dir), "active").select("cluster_id", "last_activity"),
    "unlabeled_topk": lambda spark, sf_dir: inbox.unlabeled_topk(_meta(spark, sf_dir), "content", 3).select("cluster_id", "size"),
    "labeling_stats": lambda spark, sf_dir: status.labeling_stats(_meta(spark, sf_dir)),
    "dimension_stats": lambda spark, sf_dir: status.dimension_stats(_meta(spark, sf_dir)),
    "project_summary": lambda spark, sf_dir: status.project_summary(_meta(spark, sf_dir)).withColumn("top_active_projects", F.array_join("top_active_projects", ";")),
    "refresh_project_status": lambda spark, sf_dir: status.refresh_project_status(_meta(spark, sf_dir), _activity(spark, sf_dir)),
    "status_changes": lambda spark, sf_dir: status.status_changes(status.refresh_project_status(_meta(spark, sf_dir), _activity(spark, sf_dir))),
    "enrich_clusters": lambda spark, sf_dir: status.enrich_clusters(_meta(spark, sf_dir), _activity(spark, sf_dir)).select("dimension", "cluster_id", "participant_count", "last_activity"),
    "temporal_enrich": lambda spark, sf_dir: status.temporal_enrich(_meta(spark, sf_dir), _activity(spark, sf_dir)).select("dimension", "cluster_id", "size", *status.TEMPORAL),
    "set_label": lambda spark, sf_dir: keyed.set_label(_meta(spark, sf_dir), _found(spark, 3).withColumn("dimension", F.lit("content"))).select("dimension", "cluster_id", "auto_label"),
    "mark_project": lambda spark, sf_dir: keyed.mark_project(_meta(spark, sf_dir), _found(spark, 3)).select("dimension", "cluster_id", "is_project", "project_status"),
    "bulk_status_update": lambda spark, sf_dir: keyed.bulk_status_update(_meta(spark, sf_dir).filter("is_project"), _found(spark, 2), "archived").select("cluster_id", "project_status"),
    "upsert_cluster_meta": upsert_cluster_meta,
    "upsert_repeated": upsert_repeated,
    "insert_ignore_bulk": lambda spark, sf_dir: changes.insert_if_absent(messages(spark, sf_dir).filter("id % 2 = 0").select("id", "subject"), messages(spark, sf_dir).select(F.floor(F.col("id") / 3).cast("long").alias("id"), "subject"), "id", "subject"),
    "child_rows": lambda spark, sf_dir: keyed.child_rows(messages(spark, sf_dir).filter("id % 3 = 0").select("id"), messages(spark, sf_dir).select("id", F.explode("to_emails").alias("to_email")), "id"),
    "task_transition": task_transition,
    "tasks_beside_known": tasks_beside_known,
    "mark_sent": lambda spark, sf_dir: keyed.mark_sent(messages(spark, sf_dir), ["USER1x1@corp.test", ME]).select("id", "is_sent"),
    "row_validation": row_validation,
    "api_payload_parse": api_payload_parse,
    "api_to_record": api_to_record,
    "label_flags": lambda spark, sf_dir: messages(spark, sf_dir).select("id", *[x.alias(n) for n, x in api_messages.label_flags(F.transform("labels", F.upper)).items()]),
    "src_api_history": lambda spark, sf_dir: sync.incremental(_history(spark, sf_dir), _history(spark, sf_dir).limit(0), "000004000")[1],
    "incremental_sync": incremental_ids,
    "id_set_union": lambda spark, sf_dir: api_messages.union_of_ids(_history(spark, sf_dir), messages(spark, sf_dir)),
    "initial_sync": lambda spark, sf_dir: sync.initial_window(messages(spark, sf_dir), 30).select("id"),
    "phase_batches": phase_batches,
    "notify_route": lambda spark, sf_dir: sync.notify_route(_history(spark, sf_dir).select(F.concat(F.lit("user"), (F.col("history_id").cast("long") % 200).cast("string"), F.lit("@corp.test")).alias("email"), "history_id"), _users(spark, sf_dir)),
    "sync_status": lambda spark, sf_dir: sync.sync_status(_users(spark, sf_dir), _states(spark, sf_dir)),
    "pipeline_status": pipeline_status,
}

TASKS = MAIL_SQL + ", raw AS (" + entity_queries.ORACLES["tasks_from_signals"] + """), tasks AS (SELECT raw.* EXCLUDE (status), CASE WHEN email_id % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, mail.from_email AS project_id, date_parsed AS created_at FROM raw JOIN mail ON mail.id = email_id)
"""
PROJECTS = ", projects AS (SELECT owner_email AS project_id, *, last_activity AS created_at, email_count > 5 AS is_active FROM (" + entity_queries.ORACLES["projects_from_threads"] + "))\n"
META = MAIL_SQL + ", base AS (" + entity_queries.ORACLES["cluster_meta"] + "), activity AS (" + entity_queries.ORACLES["cluster_activity"].replace(entity_queries.CONTENT_SQL, ", content AS (SELECT vectors.id, cluster FROM vectors)\n") + """),
meta AS (SELECT base.*, last_activity, CASE WHEN cluster_id % 3 <> 0 THEN 'Label ' || cluster_id END AS auto_label, dimension = 'content' AND cluster_id % 2 = 0 AS is_project,
  CASE WHEN dimension = 'content' AND cluster_id % 2 = 0 THEN CASE WHEN cluster_id % 4 = 0 THEN 'active' ELSE 'stale' END END AS project_status FROM base LEFT JOIN (SELECT 'content' AS dimension, cluster_id, last_activity FROM activity) USING (dimension, cluster_id)),
known AS (SELECT * FROM activity WHERE cluster_id <> 4), found AS (SELECT i * 3 AS cluster_id, 'found ' || i AS auto_label, CASE WHEN i % 2 = 0 THEN 'active' ELSE 'completed' END AS status, i FROM range(3) AS t(i)),
fresh AS (SELECT meta.cluster_id, project_status AS before, CASE WHEN days_since > 30 THEN 'completed' WHEN days_since > 14 THEN 'stale' WHEN days_since IS NOT NULL THEN 'active' ELSE 'stale' END AS after
  FROM meta LEFT JOIN known USING (cluster_id) WHERE dimension = 'content' AND is_project)
"""
WATCHES = "WITH watches AS (SELECT o_orderkey AS watch_id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'ended' END AS status, CAST(o_orderdate AS TIMESTAMP) AS expiration FROM orders)\n"
HISTORY = MAIL_SQL + ", history AS (SELECT printf('%09d', id) AS history_id, CASE WHEN id % 3 = 0 THEN '<m3@mail.test>' ELSE message_id END AS message_id FROM mail)\n"
USERS = "users AS (SELECT c_custkey AS user_id, 'USER' || c_custkey || '@corp.test' AS email, c_custkey % 3 > 0 AS sync_enabled FROM customer)\n"
AGE = "(epoch_us((SELECT max(date_parsed) FROM mail)) - epoch_us(date_parsed)) / 86400000000"

ORACLES = {
    "inbox_priority_page": TASKS + PROJECTS + entity_queries._cte("priority_rank") + ", contexts AS (" + entity_queries.ORACLES["priority_contexts"] + """), got AS (SELECT mail.*, priority_rank, priority_score FROM mail LEFT JOIN (SELECT * FROM priority_rank WHERE id % 10 <> 0) USING (id) WHERE NOT is_sent),
shown AS (SELECT * FROM got ORDER BY priority_rank ASC NULLS LAST, date_parsed DESC, id LIMIT 100 OFFSET 20)
SELECT s.id, s.message_id, s.thread_id, s.subject, s.from_email, s.from_name, s.date_parsed, s.has_attachments, coalesce(s.priority_rank, 0) AS priority_rank, coalesce(s.priority_score, 0) AS priority_score, sender_email, sender_importance, sender_reply_rate, thread_length, is_business_hours, age_hours,
  people_score, temporal_score, relationship_score, adjusted_priority AS overall_priority, (SELECT count(*) FROM tasks t WHERE t.email_id = s.id AND t.status = 'pending') AS task_count, (SELECT min(p.name) FROM projects p WHERE p.project_id = s.from_email) AS project_name,
  (SELECT count(*) FROM got) AS total, 120 < (SELECT count(*) FROM got) AS has_more FROM shown s LEFT JOIN contexts x ON x.id = s.id""",
    "page_envelope": MAIL_SQL + "SELECT count(*) AS total, 50::BIGINT AS \"limit\", 8520::BIGINT AS \"offset\", 8520 + greatest(0, least(50, count(*) - 8520)) < count(*) AS has_more FROM mail WHERE NOT is_sent",
    "task_page_created": TASKS + "SELECT task_id, urgency_score, created_at FROM tasks ORDER BY urgency_score DESC NULLS LAST, created_at DESC, task_id LIMIT 50",
    "task_detail": TASKS + PROJECTS + "SELECT task_id, p.name AS project_name FROM tasks LEFT JOIN projects p USING (project_id)",
    "project_page": MAIL_SQL + PROJECTS + "SELECT project_id, name, last_activity FROM projects WHERE is_active ORDER BY last_activity DESC NULLS LAST, created_at DESC, project_id LIMIT 50",
    "org_page": "SELECT o_orderkey AS org_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "project_count": MAIL_SQL + PROJECTS + "SELECT count(*) AS n FROM projects WHERE is_active",
    "oldest_unanswered": MAIL_SQL + "SELECT min(date_parsed) AS oldest_unanswered FROM mail m WHERE NOT is_sent AND NOT EXISTS (SELECT 1 FROM mail r WHERE r.in_reply_to = m.message_id)",
    "tenant_scope": WATCHES + "SELECT * FROM watches WHERE user_id = 7",
    "optional_filters": WATCHES + "SELECT * FROM watches WHERE status = 'active'",
    "point_lookup": WATCHES + "SELECT * FROM watches WHERE watch_id = 33 AND status = 'ended'",
    "watch_active": WATCHES + "SELECT * FROM watches WHERE status = 'active'",
    "expiring_soon": WATCHES + "SELECT * FROM watches WHERE status = 'active' AND expiration <= TIMESTAMP '1996-01-01' + INTERVAL 48 HOUR",
    "project_clusters": META + "SELECT cluster_id, last_activity FROM meta WHERE dimension = 'content' AND is_project AND project_status = 'active' ORDER BY last_activity DESC NULLS LAST, cluster_id LIMIT 50",
    "unlabeled_topk": META + "SELECT cluster_id, size FROM meta WHERE dimension = 'content' AND auto_label IS NULL ORDER BY size DESC, cluster_id LIMIT 3",
    "labeling_stats": META + "SELECT dimension, count(*) AS total, count(auto_label) AS labeled, count(*) - count(auto_label) AS unlabeled FROM meta GROUP BY 1",
    "dimension_stats": META + """SELECT dimension, count(*) AS total_clusters, CAST(sum(size) AS BIGINT) AS total_emails, round(avg(size), 6) AS avg_cluster_size, max(size) AS largest_cluster_size, min(size) AS smallest_cluster_size, count(auto_label) AS labeled_clusters,
  count(*) FILTER (WHERE is_project) AS project_clusters, count(*) FILTER (WHERE is_project AND project_status = 'active') AS active_projects FROM meta GROUP BY 1""",
    "project_summary": META + """, top AS (SELECT * FROM meta WHERE dimension = 'content' AND is_project AND project_status = 'active' ORDER BY last_activity DESC NULLS LAST, cluster_id LIMIT 10)
SELECT count(*) FILTER (WHERE is_project) AS total_projects, count(*) FILTER (WHERE is_project AND project_status = 'active') AS active_projects, count(*) AS total_content_clusters,
  (SELECT string_agg(cluster_id || '|' || coalesce(auto_label, '-') || '|' || size, ';' ORDER BY last_activity DESC NULLS LAST, cluster_id) FROM top) AS top_active_projects FROM meta WHERE dimension = 'content'""",
    "refresh_project_status": META + "SELECT * FROM fresh",
    "status_changes": META + "SELECT " + ", ".join(f"count(*) FILTER (WHERE before IS DISTINCT FROM after AND after = '{s}') AS to_{s}" for s in ("active", "stale", "completed")) + ", count(*) FILTER (WHERE before IS NOT DISTINCT FROM after) AS unchanged FROM fresh",
    "enrich_clusters": META + "SELECT dimension, meta.cluster_id, coalesce(known.participant_count, 0) AS participant_count, coalesce(known.last_activity, meta.last_activity) AS last_activity FROM meta LEFT JOIN known ON dimension = 'content' AND known.cluster_id = meta.cluster_id",
    "temporal_enrich": META + "SELECT dimension, meta.cluster_id, size, " + ", ".join(f"known.{x}" for x in status.TEMPORAL) + " FROM meta LEFT JOIN known ON dimension = 'content' AND known.cluster_id = meta.cluster_id",
    "set_label": META + "SELECT dimension, meta.cluster_id, coalesce(found.auto_label, meta.auto_label) AS auto_label FROM meta LEFT JOIN found ON dimension = 'content' AND found.cluster_id = meta.cluster_id",
    "mark_project": META + "SELECT dimension, meta.cluster_id, is_project OR found.i IS NOT NULL AS is_project, coalesce(found.status, project_status) AS project_status FROM meta LEFT JOIN found ON dimension = 'content' AND found.cluster_id = meta.cluster_id",
    "bulk_status_update": META + "SELECT cluster_id, CASE WHEN cluster_id IN (0, 3) THEN 'archived' ELSE project_status END AS project_status FROM meta WHERE is_project",
    "upsert_cluster_meta": META + """, target AS (SELECT dimension, cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'u1' END AS user_id, size, auto_label FROM meta), batch AS (SELECT dimension, cluster_id + 2 AS cluster_id, CASE WHEN (cluster_id + 2) % 2 = 0 THEN 'u1' END AS user_id, 1::BIGINT AS size FROM target WHERE cluster_id < 5)
SELECT coalesce(t.dimension, b.dimension) AS dimension, coalesce(t.cluster_id, b.cluster_id) AS cluster_id, CASE WHEN b.dimension IS NULL THEN t.user_id ELSE b.user_id END AS user_id, coalesce(b.size, t.size) AS size, t.auto_label
FROM target t FULL JOIN batch b ON t.dimension = b.dimension AND t.cluster_id = b.cluster_id AND t.user_id IS NOT DISTINCT FROM b.user_id""",
    "upsert_repeated": MAIL_SQL + """, batch AS (SELECT id // 2 AS id, 'new ' || subject AS subject, date_parsed FROM mail), one AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY date_parsed, subject) = 1)
SELECT id, subject, date_parsed FROM one UNION ALL SELECT id, subject, date_parsed FROM mail WHERE id NOT IN (SELECT id FROM one)""",
    "insert_ignore_bulk": MAIL_SQL + "SELECT id, min(subject) AS subject FROM (SELECT id // 3 AS id, subject FROM mail) WHERE id % 2 <> 0 OR id NOT IN (SELECT id FROM mail WHERE id % 2 = 0) GROUP BY 1",
    "child_rows": MAIL_SQL + "SELECT id, unnest(to_emails) AS to_email FROM mail WHERE id % 3 = 0",
    "task_transition": TASKS + "SELECT task_id, CASE email_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'dismissed' ELSE status END AS status, CASE WHEN email_id % 5 = 0 THEN created_at END AS completed_at FROM tasks",
    "tasks_beside_known": "WITH all_tasks AS (" + entity_queries.ORACLES["tasks_from_signals"] + ") SELECT * FROM all_tasks WHERE email_id % 2 <> 0",
    "mark_sent": MAIL_SQL + f"SELECT id, is_sent OR lower(from_email) IN ('user1x1@corp.test', '{ME}') AS is_sent FROM mail",
    "row_validation": "SELECT o_orderkey AS task_id, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN o_totalprice / 300000 > 1 OR o_totalprice < 0 THEN 'urgency_score' END, CASE WHEN o_custkey % 1100 = 0 OR o_custkey % 1100 > 1000 THEN 'description' END) AS errors FROM orders",
    "api_payload_parse": MAIL_SQL + """SELECT 'g' || id AS api_id, thread_id, printf('%09d', id) AS history_id, message_id, subject, lower(array_to_string(to_emails, ',')) AS to_addresses, in_reply_to, phrase || 'tëxt? ' || id AS body_plain, CAST(NULL AS VARCHAR) AS body_html, has_attachments,
  is_sent, NOT is_sent AS is_inbox, NOT is_sent AS is_unread, false AS is_starred, 12::BIGINT AS size_bytes FROM mail WHERE id % 50 <> 7""",
    "api_to_record": MAIL_SQL + """SELECT 'g' || id AS api_id, lower(from_email) AS from_email, from_name, lower(array_to_string(to_emails, ',')) AS to_emails, phrase || 'tëxt? ' || id AS body_text, 'from' || CASE WHEN in_reply_to IS NOT NULL THEN ',in-reply-to' ELSE '' END || ',message-id,subject,to' AS header_names,
  in_reply_to AS reply_header, CASE WHEN is_sent THEN 'SENT' ELSE 'INBOX,UNREAD' END AS labels FROM mail WHERE id % 50 <> 7""",
    "label_flags": MAIL_SQL + "SELECT id, " + ", ".join(f"list_contains(list_transform(labels, lambda x: upper(x)), '{k}') AS {v}" for k, v in api_messages.FLAGS.items()) + " FROM mail",
    "src_api_history": HISTORY + "SELECT coalesce(max(history_id), '000004000') AS next_cursor FROM history WHERE history_id > '000004000'",
    "incremental_sync": HISTORY + "SELECT DISTINCT message_id FROM history WHERE history_id > '000004000' AND message_id NOT IN (SELECT message_id FROM mail WHERE id % 4 = 0)",
    "id_set_union": HISTORY + "SELECT message_id FROM history UNION SELECT message_id FROM mail",
    "initial_sync": MAIL_SQL + "SELECT id FROM mail WHERE date_parsed >= (SELECT max(date_parsed) FROM mail) - INTERVAL 30 DAY",
    "phase_batches": MAIL_SQL + f""", aged AS (SELECT id, date_parsed, {AGE} AS age FROM mail), phased AS (SELECT *, CASE WHEN age < 7 THEN 'quick' WHEN age < 30 THEN 'recent' ELSE 'deep' END AS phase, CAST(floor(age) AS INTEGER) AS day FROM aged WHERE age < 90)
SELECT id, phase, day, CAST((row_number() OVER (PARTITION BY phase, day ORDER BY date_parsed DESC, id) - 1) // CASE phase WHEN 'quick' THEN 100 WHEN 'recent' THEN 200 ELSE 500 END AS INTEGER) AS n FROM phased""",
    "notify_route": HISTORY + ", " + USERS + ", notes AS (SELECT 'user' || (CAST(history_id AS BIGINT) % 200) || '@corp.test' AS email, history_id FROM history) SELECT user_id, notes.email, history_id FROM notes JOIN users ON lower(users.email) = notes.email WHERE sync_enabled",
    "sync_status": "WITH " + USERS + ", states AS (SELECT o_custkey AS user_id, max(o_orderdate) AS last_sync_at, count(*) AS n FROM orders GROUP BY 1) SELECT user_id, CASE WHEN n IS NULL THEN 'not_synced' ELSE 'idle' END AS status, last_sync_at, coalesce(n, 0) AS emails_synced FROM users LEFT JOIN states USING (user_id)",
    "pipeline_status": MAIL_SQL + entity_queries._cte("handleability") + ", contacts AS (" + queries.ORACLES["contact_profile"] + """), n AS (SELECT (SELECT count(*) FROM mail) AS emails, (SELECT count(*) FROM mail WHERE is_sent) AS sent_emails, (SELECT count(DISTINCT thread_id) FROM mail) AS threads, (SELECT count(*) FROM mail) AS embeddings,
  (SELECT count(*) FROM handleability) AS ai_classification, (SELECT count(*) FROM handleability WHERE handleability = 'needs_llm') AS needs_llm, (SELECT count(*) FROM contacts) AS users, (SELECT count(*) FROM mail WHERE id % 9 = 0) AS llm_classification, 0::BIGINT AS clusters)
SELECT *, emails - sent_emails AS received_emails, greatest(0, needs_llm - llm_classification) AS llm_remaining FROM n""",
}
