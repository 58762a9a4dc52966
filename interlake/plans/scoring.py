"""Registered queries of rule classification and priority, with their DuckDB oracles."""

from __future__ import annotations

from interlake.operators import mail as m
from interlake.operators import priority as p
from interlake.operators import rules as r
from interlake.plans.mailbox import BODY_SQL, MAIL_SQL, VECTORS_SQL, messages, shared_vectors
from interlake.plans.queries import CONTACT_SQL, ORACLES as MAIL_ORACLES, ROLES_SQL


def _services(spark, sf_dir, whole=False, mail=None):
    mail = messages(spark, sf_dir, whole=whole, facts=True) if mail is None else mail
    return r.with_service(mail.filter("NOT is_sent")).select("id", "is_service", "service_confidence", "service_type", "service_importance")


def _patterns(spark, sf_dir, whole=False):
    return r.with_patterns(messages(spark, sf_dir, whole=whole, facts=True).filter("NOT is_sent")).select("id", *r.PATTERNS)


def _handled(spark, sf_dir, whole=False):
    return r.handleability(messages(spark, sf_dir, whole=whole, facts=True), m.relationship_features(messages(spark, sf_dir)))


def _priorities(spark, sf_dir, whole=False, told=None, near=None, actions=None):
    """told: messages with facts, of whole texts if whole; near: relationship_features(); actions: action_label(). What the caller has stored isn't made again."""
    mail = messages(spark, sf_dir)
    near = m.relationship_features(mail) if near is None else near
    actions = m.action_label(mail) if actions is None else actions
    uses, table = shared_vectors(spark, sf_dir)
    return p.priority_scores(mail, near.join(_services(spark, sf_dir, whole, told), "id"), actions, table, uses)


def _ranks(spark, sf_dir, whole=False, scores=None):
    scores = _priorities(spark, sf_dir, whole) if scores is None else scores
    return p.ranked(scores.select("id", "priority_score"))  # the rest of a score needn't be kept for ranking


QUERIES = {
    "detect_service": _services,
    "detect_patterns": _patterns,
    "handleability": _handled,
    "category_counts": lambda spark, sf_dir, whole=False: r.category_counts(_handled(spark, sf_dir, whole)),
    "real_person": lambda spark, sf_dir: r.real_person(messages(spark, sf_dir), m.contact_profile(messages(spark, sf_dir))),
    "priority_score": _priorities,
    "priority_rank": _ranks,
}


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _count(text: str, words: list[str]) -> str:
    return "(" + " + ".join("CAST(contains({}, '{}') AS INTEGER)".format(text, w.replace("'", "''")) for w in words) + ")"


GOT = MAIL_SQL + BODY_SQL + ", got AS (SELECT id, from_email, lower(from_email) AS f, lower(subject) AS s, lower(body_text) AS b FROM bodies WHERE NOT is_sent)\n"
KIND = "CASE " + " ".join(f"WHEN {_any('s', words)} OR {_any('f', words)} THEN '{name}'" for name, words in r.SERVICE_TYPES.items()) + " END"
SERVICE_SQL = f""", typed AS (SELECT *, {KIND} AS service_type, {_count("s", r.IMPORTANT_SUBJECTS)} AS hi, {_count("s", r.LOW_SUBJECTS)} AS lo, {_count("f", r.IMPORTANT_SENDERS)} AS fr FROM got),
sure AS (SELECT *, round((CASE WHEN {_any("f", r.SERVICE_SENDERS)} THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN contains(b, 'unsubscribe') THEN 0.3::DOUBLE ELSE 0 END)
  + (CASE WHEN service_type IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END), 6) AS service_confidence FROM typed),
services AS (SELECT id, service_confidence >= 0.3::DOUBLE AS is_service, service_confidence, service_type, round(CASE WHEN service_confidence >= 0.3::DOUBLE THEN
    0.5::DOUBLE * (CASE WHEN hi > 0 AND lo = 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + hi * 0.2::DOUBLE) WHEN lo > 0 AND hi = 0 THEN greatest(0.0::DOUBLE, 0.3::DOUBLE - lo * 0.1::DOUBLE) WHEN hi > lo THEN 0.6::DOUBLE WHEN lo > hi THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END)
    + 0.5::DOUBLE * (CASE WHEN fr > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + fr * 0.25::DOUBLE) ELSE 0.3::DOUBLE END) ELSE 0.0::DOUBLE END, 6) AS service_importance FROM sure)
"""
PATTERN_SQL = ", patterns AS (SELECT id, b, contains(b, '?') OR contains(s, '?') AS has_question, " + ", ".join([f"{_any('b', w)} AS {n}" for n, w in r.BODY_PATTERNS.items()] + [f"{_any('s', w)} AS {n}" for n, w in r.SUBJECT_PATTERNS.items()]) + " FROM got)\n"


def _cte(name: str) -> str:
    """A registered mail oracle as one CTE, with its own mailbox nested in it."""
    return f", {name} AS ({MAIL_ORACLES[name]})\n"


FACTS_SQL = SERVICE_SQL + PATTERN_SQL + _cte("relationship_features") + """, facts AS (SELECT patterns.*, coalesce(relationship_strength, 0) AS near, is_service, NOT is_service AS person, coalesce(service_type, '') AS kind
  FROM patterns JOIN services USING (id) LEFT JOIN relationship_features USING (id))
"""
CASES = [
    ("is_service AND kind = 'marketing'", "ai_full", "service_marketing", "FILE_TO_FOLDER", "Promotions"),
    ("is_service AND kind IN ('newsletter', 'notification')", "ai_full", "service_%", "FILE_TO_FOLDER", "Updates"),
    ("is_calendar_response", "ai_full", "calendar_response", "FILE_TO_FOLDER", "Calendar"),
    ("is_auto_reply", "ai_full", "auto_reply", "FILE_TO_FOLDER", "Auto-replies"),
    ("is_newsletter AND near < 0.2", "ai_full", "newsletter_pattern", "FILE_TO_FOLDER", "Newsletters"),
    ("is_service AND kind = 'transactional' AND " + _any("b", r.ORDER_WORDS), "ai_full", "transactional", "FILE_TO_FOLDER", "Orders"),
    ("has_approval", "human_required", "approval_request", "PREPARE_DECISION_CONTEXT", None),
    ("near > 0.6 AND person", "human_required", "important_relationship", "PREPARE_DECISION_CONTEXT", None),
    ("person AND has_confirm AND near > 0.2", "human_required", "explicit_reply_request", "DRAFT_REPLY", None),
    ("has_deadline AND has_request AND person", "human_required", "deadline_request", "PREPARE_DECISION_CONTEXT", None),
    ("has_scheduling AND person AND near < 0.5", "ai_partial", "scheduling_request", "SCHEDULE_MEETING", None),
    ("is_fyi AND near > 0.1 AND person", "ai_partial", "fyi_from_contact", "DRAFT_REPLY", None),
    ("has_confirm AND near < 0.3", "ai_partial", "confirm_request", "DRAFT_REPLY", None),
    ("has_attachment_ref", "ai_partial", "has_attachment", "SUMMARIZE_ATTACHMENT", None),
]


def _said(i: int, default: str) -> str:
    value = lambda v: "NULL" if v is None else f"'{v}'" if "%" not in v else "'service_' || kind"
    return "CASE " + " ".join(f"WHEN {case[0]} THEN {value(case[i])}" for case in CASES) + f" ELSE {default} END"


HANDLED_SQL = GOT + FACTS_SQL + f""", handled AS (SELECT id, {_said(1, "'needs_llm'")} AS handleability, {_said(2, "'ambiguous'")} AS reason, {_said(3, "NULL")} AS action, {_said(4, "NULL")} AS folder,
  CASE WHEN near > 0.4 THEN 1 WHEN has_request THEN 2 WHEN is_service THEN 4 WHEN near < 0.1 THEN 5 ELSE 3 END AS tier FROM facts)
"""


def _mean(source: str, key: str) -> str:
    """Mean vector per key, one dimension at a time."""
    return f"SELECT k, list(x ORDER BY i) AS centroid FROM (SELECT {key} AS k, i, avg(embedding[i]) AS x FROM {source}, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY 1, 2) GROUP BY k"


DISTANCE = "1 - list_cosine_similarity(embedding, {0})"
SCALED = "({0} - min({0}) OVER ()) / CASE WHEN max({0}) OVER () = min({0}) OVER () THEN 1 ELSE max({0}) OVER () - min({0}) OVER () END"
PRIORITY_SQL = GOT + SERVICE_SQL + VECTORS_SQL + _cte("relationship_features") + _cte("action_label") + f""", base AS (SELECT got.id, from_email, relationship_strength AS rel, urgency_score AS urg, is_service, service_importance AS imp, action, embedding, cluster
  FROM got JOIN relationship_features USING (id) JOIN services USING (id) LEFT JOIN action_label USING (id) LEFT JOIN vectors USING (id)),
answered AS ({_mean("(SELECT * FROM base WHERE action = 'REPLIED')", "0")}), clustered AS ({_mean("(SELECT * FROM base WHERE cluster <> -1)", "cluster")}),
regular AS ({_mean("(SELECT * FROM base WHERE from_email IN (SELECT from_email FROM base GROUP BY 1 HAVING count(*) >= 3))", "from_email")}),
raw AS (SELECT id, action, cluster, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN is_service THEN imp * 0.5::DOUBLE + urg * 0.5::DOUBLE ELSE rel * 0.6::DOUBLE + urg * 0.4::DOUBLE END)) AS f,
    1 - ({DISTANCE.format("answered.centroid")}) AS a, CASE WHEN cluster = -1 THEN 1.0::DOUBLE WHEN clustered.centroid IS NULL THEN 0.5::DOUBLE ELSE {DISTANCE.format("clustered.centroid")} END AS c,
    CASE WHEN regular.centroid IS NULL THEN 0.5::DOUBLE ELSE {DISTANCE.format("regular.centroid")} END AS n
  FROM base LEFT JOIN answered ON true LEFT JOIN clustered ON clustered.k = cluster LEFT JOIN regular ON regular.k = from_email),
parts AS (SELECT id, action, cluster, f AS feature_score, coalesce({SCALED.format("a")}, 0.5::DOUBLE) AS replied_similarity, coalesce({SCALED.format("c")}, 0.5::DOUBLE) AS cluster_novelty, coalesce({SCALED.format("n")}, 0.5::DOUBLE) AS sender_novelty FROM raw),
scored AS (SELECT *, round(feature_score * 0.35::DOUBLE + replied_similarity * 0.30::DOUBLE + cluster_novelty * 0.20::DOUBLE + sender_novelty * 0.15::DOUBLE, 9) AS priority_score FROM parts)
"""

ORACLES = {
    "detect_service": GOT + SERVICE_SQL + "SELECT * FROM services",
    "detect_patterns": GOT + PATTERN_SQL + "SELECT * EXCLUDE (b) FROM patterns",
    "handleability": HANDLED_SQL + "SELECT * EXCLUDE (tier), CASE WHEN handleability = 'needs_llm' THEN CAST(tier AS BIGINT) END AS llm_priority FROM handled",
    "category_counts": HANDLED_SQL + "SELECT handleability, count(*) AS n FROM handled GROUP BY 1",
    "real_person": MAIL_SQL + ROLES_SQL + f""", profile AS (WITH here AS (SELECT 1){CONTACT_SQL})
SELECT id, coalesce(NOT ({" OR ".join(f"from_email LIKE '{x}'" for x in r.MARKETING_LIKE)}) AND (coalesce(reply_rate > 0, false) OR coalesce(is_important, false) OR coalesce(emails_from BETWEEN 1 AND 3, false)), false) AS is_real_person
FROM mail LEFT JOIN profile ON profile.email = lower(from_email) WHERE NOT is_sent""",
    "priority_score": PRIORITY_SQL + """SELECT id, round(feature_score, 8) AS feature_score, round(replied_similarity, 8) AS replied_similarity, round(cluster_novelty, 8) AS cluster_novelty, round(sender_novelty, 8) AS sender_novelty, priority_score, CASE WHEN priority_score >= 0.7 THEN 'high_priority' WHEN action = 'REPLIED' THEN 'replied_training'
  WHEN priority_score >= 0.5 AND action = 'IGNORED' THEN 'high_priority_ignored' WHEN cluster = -1 AND priority_score >= 0.4 THEN 'novel_content' END AS llm_reason FROM scored""",
    "priority_rank": PRIORITY_SQL + "SELECT id, priority_score, row_number() OVER (ORDER BY priority_score DESC, id) AS priority_rank FROM scored",
}
