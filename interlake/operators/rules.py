"""Service senders, content patterns and the rule cascade that says who can handle a message, as column expressions.

Keywords are substring tests ("call" is found in "recall"). Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keyword lists decide results and stand in the order in which they are tried.
SERVICE_SENDERS = [
    "noreply", "no-reply", "donotreply", "do-not-reply", "notifications", "notification", "alerts", "alert", "mailer", "mail", "newsletter",
    "updates", "info", "support", "service", "system", "automated", "auto", "bounce", "postmaster", "mailer-daemon",
]
SERVICE_TYPES = {
    "newsletter": ["newsletter", "digest", "weekly", "daily", "monthly", "subscribe"],
    "transactional": ["order", "receipt", "invoice", "payment", "shipping", "delivery", "confirmation"],
    "notification": ["notification", "alert", "reminder", "update"],
    "marketing": ["offer", "discount", "sale", "promo", "deal", "exclusive"],
    "social": ["linkedin", "facebook", "twitter", "instagram", "social"],
}
IMPORTANT_SUBJECTS = [
    "order", "shipped", "delivered", "delivery", "payment", "transaction", "confirm", "confirmed", "confirmation", "receipt", "invoice", "alert",
    "security", "verification", "verify", "password", "login", "suspicious", "fraud", "unauthorized", "expired", "expiring", "renewal", "bill",
    "due", "overdue", "failed", "declined", "refund", "return",
]
LOW_SUBJECTS = [
    "offer", "sale", "deal", "save", "discount", "promo", "promotional", "newsletter", "digest", "weekly", "daily", "tips", "recommendation",
    "suggested", "trending", "popular", "new arrivals", "just for you", "exclusive", "limited time", "don't miss", "check out",
]
IMPORTANT_SENDERS = [
    "order", "shipping", "shipment", "tracking", "confirm", "alert", "security", "verify", "transaction", "payment", "billing", "receipt",
    "return", "refund", "delivery", "support",
]
BODY_PATTERNS = {
    "has_request": ["please", "could you", "can you", "would you", "need you"],
    "has_scheduling": ["meeting", "calendar", "schedule", "call", "zoom", "teams"],
    "has_deadline": ["deadline", "by friday", "by monday", "by eod", "end of day", "urgent", "asap", "by tomorrow"],
    "has_approval": ["approve", "approval", "sign off", "authorize", "permission"],
    "has_confirm": ["confirm", "acknowledge", "let me know", "please reply"],
    "is_newsletter": ["unsubscribe", "view in browser", "email preferences", "opt out"],
    "is_fyi": ["fyi", "for your information", "just wanted to let you know"],
    "has_attachment_ref": ["attached", "attachment", "see attached", "please find"],
}
SUBJECT_PATTERNS = {
    "is_calendar_response": ["accepted:", "declined:", "tentative:"],
    "is_auto_reply": ["out of office", "automatic reply", "auto-reply"],
}
ORDER_WORDS = ["order", "receipt", "confirmation", "shipped", "delivered", "tracking"]
MARKETING_LIKE = [
    "%noreply%", "%no-reply%", "%no_reply%", "%donotreply%", "%@email.%", "%@mail.%", "%@offers.%", "%@mailer.%", "%@marketing.%", "%@news.%",
    "%@info.%", "%newsletter%", "%marketing%", "%alerts@%", "%notification%", "%billing@%", "%digest%", "%@google.com", "%@github.com",
    "%@linkedin.com", "%@medium.com", "%@substack.%", "%@mailchimp.%", "%@sendgrid.%", "%update@%", "%support@%", "%team@%", "%hello@%", "%contact@%",
]

PATTERNS = ["has_question", *BODY_PATTERNS, *SUBJECT_PATTERNS]

#: All that the rules ask of a body, as words of which it may hold one.
BODY_WORDS = {"has_question": ["?"], **BODY_PATTERNS, "unsubscribe": ["unsubscribe"], "orders": ORDER_WORDS, "tracked": ["shipped", "tracking"]}
#: So many characters from its beginning tell whether a word begins before a text and ends in it.
HEAD = max(len(w) for words in BODY_WORDS.values() for w in words) - 1


def holds_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_held(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def lowered(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def text_facts(text: Column) -> dict[str, Column]:
    """What the rules ask of a text that stands at the end of many bodies, and its beginning: by name, for body_facts()."""
    low = F.lower(text)
    return {f"_text_{name}": holds_any(low, words) for name, words in BODY_WORDS.items()} | {"_text_length": F.length(text), "_text_head": F.left(text, F.lit(HEAD))}


def body_facts(opening: Column) -> dict[str, Column]:
    """body_<name> for all of BODY_WORDS, and body_length, of bodies that are an opening and a text whose text_facts() stand beside it; null facts are no text.

    A word of the body stands in its text or begins in the opening, so the opening and the text's beginning tell the rest.
    """
    begins = F.lower(F.concat(opening, F.coalesce("_text_head", F.lit(""))))
    found = {f"body_{name}": F.coalesce(f"_text_{name}", F.lit(False)) | holds_any(begins, words) for name, words in BODY_WORDS.items()}
    return found | {"body_length": F.length(opening) + F.coalesce("_text_length", F.lit(0))}


def body_holds(mail: DataFrame, name: str) -> Column:
    """Whether a body holds one of the words of this name: the fact where mail has it, else from body_text."""
    return F.col(f"body_{name}") if f"body_{name}" in mail.columns else holds_any(lowered("body_text"), BODY_WORDS[name])


def with_service(mail: DataFrame) -> DataFrame:
    """Adds is_service, service_confidence, service_type and service_importance. mail has body_text or body_facts().

    A type may be known though the confidence is too low for a service.
    """
    sender, subject = lowered("from_email"), lowered("subject")
    kind = F.lit(None).cast("string")
    for name, words in reversed(SERVICE_TYPES.items()):
        kind = F.when(holds_any(subject, words) | holds_any(sender, words), name).otherwise(kind)
    out = mail.withColumn("service_type", kind)
    sure = F.when(holds_any(sender, SERVICE_SENDERS), 0.3).otherwise(0.0) + F.when(body_holds(mail, "unsubscribe"), 0.3).otherwise(0.0) + F.when(F.col("service_type").isNotNull(), 0.2).otherwise(0.0)
    out = out.withColumn("service_confidence", F.round(sure, 6)).withColumn("is_service", F.col("service_confidence") >= 0.3)
    out = out.withColumns({"_high": count_held(subject, IMPORTANT_SUBJECTS), "_low": count_held(subject, LOW_SUBJECTS), "_from": count_held(sender, IMPORTANT_SENDERS)})
    high, low = F.col("_high"), F.col("_low")
    by_subject = (
        F.when((high > 0) & (low == 0), F.least(F.lit(1.0), 0.5 + high * 0.2)).when((low > 0) & (high == 0), F.greatest(F.lit(0.0), 0.3 - low * 0.1))
        .when(high > low, 0.6).when(low > high, 0.2).otherwise(0.4)
    )
    by_sender = F.when(F.col("_from") > 0, F.least(F.lit(1.0), 0.5 + F.col("_from") * 0.25)).otherwise(0.3)
    return out.withColumn("service_importance", F.round(F.when(F.col("is_service"), 0.5 * by_subject + 0.5 * by_sender).otherwise(0.0), 6)).drop("_high", "_low", "_from")


def with_patterns(mail: DataFrame) -> DataFrame:
    """Adds one boolean per content pattern of PATTERNS. mail has body_text or body_facts()."""
    subject = lowered("subject")
    found = {"has_question": body_holds(mail, "has_question") | subject.contains("?")}
    found |= {name: body_holds(mail, name) for name in BODY_PATTERNS}
    found |= {name: holds_any(subject, words) for name, words in SUBJECT_PATTERNS.items()}
    return mail.withColumns(found)


def _ruled(mail: DataFrame, strengths: DataFrame) -> DataFrame:
    """Received messages with their patterns, `near` (relationship), and `rule`, the struct of the first rule that holds, or `tier` where none does."""
    got = with_patterns(with_service(mail.filter(~F.col("is_sent")).join(strengths.select("id", "relationship_strength"), "id", "left")))
    near, service, kind = F.coalesce("relationship_strength", F.lit(0.0)), F.col("is_service"), F.coalesce("service_type", F.lit(""))
    has, person = F.col, ~F.col("is_service")
    rules = [
        (service & (kind == "marketing"), "ai_full", "service_marketing", "FILE_TO_FOLDER", "Promotions"),
        (service & (kind == "newsletter"), "ai_full", "service_newsletter", "FILE_TO_FOLDER", "Updates"),
        (service & (kind == "notification"), "ai_full", "service_notification", "FILE_TO_FOLDER", "Updates"),
        (has("is_calendar_response"), "ai_full", "calendar_response", "FILE_TO_FOLDER", "Calendar"),
        (has("is_auto_reply"), "ai_full", "auto_reply", "FILE_TO_FOLDER", "Auto-replies"),
        (has("is_newsletter") & (near < 0.2), "ai_full", "newsletter_pattern", "FILE_TO_FOLDER", "Newsletters"),
        (service & (kind == "transactional") & body_holds(mail, "orders"), "ai_full", "transactional", "FILE_TO_FOLDER", "Orders"),
        (has("has_approval"), "human_required", "approval_request", "PREPARE_DECISION_CONTEXT", None),
        (person & (near > 0.6), "human_required", "important_relationship", "PREPARE_DECISION_CONTEXT", None),
        (person & has("has_confirm") & (near > 0.2), "human_required", "explicit_reply_request", "DRAFT_REPLY", None),
        (person & has("has_deadline") & has("has_request"), "human_required", "deadline_request", "PREPARE_DECISION_CONTEXT", None),
        (person & has("has_scheduling") & (near < 0.5), "ai_partial", "scheduling_request", "SCHEDULE_MEETING", None),
        (person & has("is_fyi") & (near > 0.1), "ai_partial", "fyi_from_contact", "DRAFT_REPLY", None),
        (has("has_confirm") & (near < 0.3), "ai_partial", "confirm_request", "DRAFT_REPLY", None),
        (has("has_attachment_ref"), "ai_partial", "has_attachment", "SUMMARIZE_ATTACHMENT", None),
    ]
    tier = F.when(near > 0.4, 1).when(has("has_request"), 2).when(service, 4).when(near < 0.1, 5).otherwise(3)
    first = F.lit(None)
    for holds, *said in reversed(rules):
        first = F.when(holds, F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("handleability", "reason", "action", "folder"), said, strict=True)])).otherwise(first)
    return got.withColumns({"near": near, "rule": first, "tier": tier})


def handleability(mail: DataFrame, strengths: DataFrame) -> DataFrame:
    """(id, handleability, reason, action, folder, llm_priority) of received messages: the first rule that holds.

    strengths: (id, relationship_strength); a message without one counts as 0. Only needs_llm has an llm_priority
    (1 first), and no action. Everything is one projection over one join by id.
    """
    return _ruled(mail, strengths).select(
        "id",
        F.coalesce("rule.handleability", F.lit("needs_llm")).alias("handleability"),
        F.coalesce("rule.reason", F.lit("ambiguous")).alias("reason"),
        "rule.action",
        "rule.folder",
        F.when(F.col("rule").isNull(), F.col("tier")).cast("long").alias("llm_priority"),
    )


def decision_metadata(mail: DataFrame, strengths: DataFrame) -> DataFrame:
    """(id, reason, metadata): what a decision is based on, as a JSON object with the fields that the rule has, and all patterns."""
    reason = F.coalesce("rule.reason", F.lit("ambiguous"))
    only_for = lambda value, *reasons: F.when(reason.isin(*reasons), value)
    fields = {
        "action": F.col("rule.action"), "folder": F.col("rule.folder"), "track_delivery": only_for(body_holds(mail, "tracked"), "transactional"),
        "priority": only_for(F.lit("high"), "approval_request", "deadline_request"), "relationship": only_for(F.col("near"), "important_relationship"),
        "needs_personalization": only_for(F.lit(True), "explicit_reply_request"), "needs_approval": only_for(F.lit(True), "scheduling_request"),
        "draft_type": F.coalesce(only_for(F.lit("acknowledgment"), "fyi_from_contact"), only_for(F.lit("confirmation"), "confirm_request")),
        "llm_priority": F.when(F.col("rule").isNull(), F.col("tier")), "patterns": F.struct(*PATTERNS),
    }
    return _ruled(mail, strengths).select("id", reason.alias("reason"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("metadata"))


def category_counts(classified: DataFrame) -> DataFrame:
    """Messages per class."""
    return classified.groupBy("handleability").agg(F.count(F.lit(1)).alias("n"))


def real_person(mail: DataFrame, contacts: DataFrame) -> DataFrame:
    """(id, is_real_person) of received messages: not marketing, and a contact that answers, matters, or wrote 1 to 3 messages."""
    who = contacts.select(F.col("email").alias("_who"), "reply_rate", "is_important", "emails_from")
    marketing = reduce(lambda a, b: a | b, [F.col("from_email").like(p) for p in MARKETING_LIKE])
    known = F.coalesce(F.col("reply_rate") > 0, F.lit(False)) | F.coalesce("is_important", F.lit(False)) | F.coalesce(F.col("emails_from").between(1, 3), F.lit(False))
    got = mail.filter(~F.col("is_sent")).select("id", "from_email")
    return got.join(who, F.lower("from_email") == F.col("_who"), "left").select("id", F.coalesce(~marketing & known, F.lit(False)).alias("is_real_person"))
