"""Messages as a mail API gives them: nested JSON payloads, base64url bodies, label ids, and the history of changes.

The envelope and its parts down to DEPTH are read by from_json, as column expressions. A payload that goes deeper
(mail within mail within mail) keeps its JSON text, and only such rows are walked with a stack, in Arrow batches.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from interlake.functions import text as t

#: Levels of parts that column expressions read; deeper rows take the walk. It decides the plan, not the result.
DEPTH = 5
#: Label ids and the flags they stand for (fixed values).
FLAGS = {"SENT": "is_sent", "INBOX": "is_inbox", "UNREAD": "is_unread", "STARRED": "is_starred", "DRAFT": "is_draft", "SPAM": "is_spam", "TRASH": "is_trash"}
HEADERS = "array<struct<name:string,value:string>>"


def payload_type(depth: int = DEPTH) -> str:
    """DDL of a payload whose parts nest so deep; those of the last level stay JSON text."""
    parts = f"array<{payload_type(depth - 1)}>" if depth else "string"
    return f"struct<mimeType:string,filename:string,headers:{HEADERS},body:struct<data:string>,parts:{parts}>"


def message_type() -> str:
    return f"id string, threadId string, historyId string, snippet string, labelIds array<string>, sizeEstimate long, payload {payload_type()}"


def header_map(headers: Column) -> Column:
    """Headers by lower-cased name; of repeated ones the last."""
    pairs = F.transform(F.filter(headers, lambda h: h["name"].isNotNull()), lambda h: F.struct(F.lower(h["name"]).alias("k"), F.coalesce(h["value"], F.lit("")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]
    return F.map_from_arrays(F.coalesce(names, F.array().cast("array<string>")), F.coalesce(F.transform(names, last), F.array().cast("array<string>")))


def decode_base64url(data: Column) -> Column:
    """Text of base64url data, padded or not; bytes that aren't UTF-8 become U+FFFD, and what isn't base64 gives null."""
    bare = F.regexp_replace(F.translate(data, "-_", "+/"), "[=\\s]", "")
    full = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    return F.make_valid_utf8(F.try_to_binary(full, F.lit("base64")).cast("string"))


def body_of(payload: Column, kind: str, depth: int = DEPTH) -> Column:
    """The first text of this type: the payload's own, else that of its parts, in order, each with its parts."""
    own = F.when(payload["mimeType"].contains(kind), F.nullif(decode_base64url(payload["body"]["data"]), F.lit("")))
    if not depth:
        return own
    found = F.transform(payload["parts"], lambda p: body_of(p, kind, depth - 1))
    return F.coalesce(own, F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))


def has_attachments(payload: Column, depth: int = DEPTH) -> Column:
    """Whether a part at any depth has a file name or is disposed as an attachment."""
    if not depth:
        return F.lit(False)

    def one(part: Column) -> Column:
        disposed = F.exists(part["headers"], lambda h: (F.lower(h["name"]) == "content-disposition") & F.lower(h["value"]).contains("attachment"))
        return F.coalesce(part["filename"] != "", F.lit(False)) | F.coalesce(disposed, F.lit(False)) | has_attachments(part, depth - 1)

    return F.coalesce(F.exists(payload["parts"], one), F.lit(False))


def is_deeper(payload: Column, depth: int = DEPTH) -> Column:
    """Whether parts lie below the levels that the schema reads."""
    if not depth:
        return payload["parts"].isNotNull()
    return F.coalesce(F.exists(payload["parts"], lambda p: is_deeper(p, depth - 1)), F.lit(False))


WALKED = StructType([StructField("body_plain", StringType()), StructField("body_html", StringType()), StructField("has_attachments", BooleanType())])


def _decoded(data: str) -> str | None:
    bare = re.sub(r"[=\s]", "", data.translate(str.maketrans("-_", "+/")))
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True).decode("utf-8", "replace") or None
    except (binascii.Error, ValueError):
        return None


def _walk(raw: str) -> tuple[str | None, str | None, bool]:
    """First plain text, first HTML text and whether there is an attachment, over all parts of a message in order, by a stack."""
    found: dict[str, str | None] = {"text/plain": None, "text/html": None}
    attached, root = False, json.loads(raw)["payload"]
    stack = [root]
    while stack:
        part = stack.pop()
        kind, data = part.get("mimeType") or "", (part.get("body") or {}).get("data")
        for wanted in found:
            if found[wanted] is None and wanted in kind and data:
                found[wanted] = _decoded(data)
        if part is not root:
            disposed = ((h.get("value") or "") for h in part.get("headers") or [] if (h.get("name") or "").lower() == "content-disposition")
            attached = attached or bool(part.get("filename")) or any("attachment" in v.lower() for v in disposed)
        stack += reversed([p for p in part.get("parts") or [] if p])
    return *found.values(), attached


@F.pandas_udf(WALKED)
def walked(raw: pd.Series) -> pd.DataFrame:
    """What _walk() finds in each message; nulls for null."""
    return pd.DataFrame([(None, None, None) if r is None else _walk(r) for r in raw], columns=WALKED.names).astype(object)


def label_flags(labels: Column) -> dict[str, Column]:
    """One boolean for each label id that has a flag."""
    return {flag: F.coalesce(F.array_contains(labels, label), F.lit(False)) for label, flag in FLAGS.items()}


def parse_payloads(raw: DataFrame, column: str = "value") -> DataFrame:
    """Messages of raw JSON texts, their parts at any depth; what isn't JSON (or nests beyond the 1,000 levels that Spark's reader takes) gives a row of nulls with parse_error true."""
    m = raw.select("*", F.from_json(column, message_type(), {"mode": "PERMISSIVE"}).alias("m"))
    m = m.withColumn("h", header_map(F.col("m.payload.headers"))).withColumn("deep", walked(F.when(is_deeper(F.col("m.payload")), F.col(column))))
    deep = F.col("deep.has_attachments").isNotNull()
    h = lambda name: F.col("h")[name]
    labels = F.coalesce("m.labelIds", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    addresses = lambda name: F.coalesce(F.transform(t.split_addresses_api(h(name)), lambda a: t.parse_address_api(a)["email"]), empty)
    return m.select(
        F.col("m.id").alias("api_id"), F.col("m.threadId").alias("thread_id"), F.col("m.historyId").alias("history_id"),
        F.coalesce(h("message-id"), F.lit("")).alias("message_id"), F.coalesce(h("subject"), F.lit("")).alias("subject"), F.coalesce(h("from"), F.lit("")).alias("from_address"),
        t.parse_date_api(h("date")).alias("date_sent"), F.coalesce("m.snippet", F.lit("")).alias("snippet"), F.coalesce("m.sizeEstimate", F.lit(0)).cast("long").alias("size_bytes"),
        F.coalesce("deep.has_attachments", has_attachments(F.col("m.payload"))).alias("has_attachments"), labels.alias("label_ids"), addresses("to").alias("to_addresses"), addresses("cc").alias("cc_addresses"),
        h("in-reply-to").alias("in_reply_to"), t.parse_references(h("references")).alias("references"),
        F.when(deep, F.col("deep.body_plain")).otherwise(body_of(F.col("m.payload"), "text/plain")).alias("body_plain"),
        F.when(deep, F.col("deep.body_html")).otherwise(body_of(F.col("m.payload"), "text/html")).alias("body_html"),
        *[flag.alias(name) for name, flag in label_flags(labels).items()], F.col("m.id").isNull().alias("parse_error"),
    )


def to_records(messages: DataFrame) -> DataFrame:
    """Messages as the pipeline's records, with a header map made of the parts that are there."""
    who = t.parse_address_api(F.col("from_address"))
    date = F.date_format("date_sent", "yyyy-MM-dd'T'HH:mm:ssXXX")
    listed = lambda c, by: F.when(F.size(c) > 0, F.array_join(c, by))
    headers = {"message-id": F.col("message_id"), "from": F.col("from_address"), "subject": F.col("subject"), "date": date, "to": listed("to_addresses", ", "), "cc": listed("cc_addresses", ", "), "in-reply-to": F.col("in_reply_to"), "references": listed("references", " ")}
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in headers.items()]))
    return messages.filter(~F.col("parse_error")).select(
        "message_id", "api_id", "thread_id", who["email"].alias("from_email"), who["name"].alias("from_name"), F.col("to_addresses").alias("to_emails"), F.col("cc_addresses").alias("cc_emails"),
        F.array().cast("array<string>").alias("bcc_emails"), "subject", date.alias("date_str"), F.coalesce("body_plain", F.lit("")).alias("body_text"), "body_html",
        F.map_from_entries(entries).alias("headers"), F.col("label_ids").alias("labels"), "in_reply_to", "references",
    )


def union_of_ids(*frames: DataFrame, key: str = "message_id") -> DataFrame:
    """The distinct ids of several lists of changes."""
    return reduce(DataFrame.union, [f.select(key) for f in frames]).distinct()
