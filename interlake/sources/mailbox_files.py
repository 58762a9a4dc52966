"""Mailbox files and raw messages as rows.

A mailbox file is cut at its 'From ' lines by the text source, which also deals large files out by byte ranges; its messages stay
bytes until each part is read by its own character set. A message that can't be parsed gives a record of nulls and stops nothing.
"""

from __future__ import annotations

import email
import email.errors
import email.header
import re
from collections.abc import Iterator
from email.message import Message

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Field of a record and its header (fixed values).
HEADERS = {
    "message_id": "Message-ID", "thread_id": "X-GM-THRID", "in_reply_to": "In-Reply-To", "references": "References", "date": "Date",
    "from": "From", "to": "To", "cc": "Cc", "bcc": "Bcc", "subject": "Subject", "labels": "X-Gmail-Labels",
}
RECORD = StructType([StructField(n, StringType()) for n in [*HEADERS, "body", "body_html"]] + [StructField("has_attachments", BooleanType())])
CUT = len("\nFrom ")
QUOTED = re.compile(rb"(?m)^>(>*From )")
PUSH = "emailAddress string, historyId string"


def _decoded(value: str | None) -> str | None:
    """An RFC 2047 header as text; unknown character sets are read as UTF-8."""
    if value is None or (isinstance(value, str) and "=?" not in value):
        return value
    out = []
    for part, charset in email.header.decode_header(str(value)):
        try:
            out.append(part.decode(charset or "utf-8", "replace") if isinstance(part, bytes) else part)
        except LookupError:
            out.append(part.decode("utf-8", "replace"))
    return "".join(out)


def _attached(part: Message) -> bool:
    return "attachment" in str(part.get("Content-Disposition", "")).lower()


def _text(part: Message) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _record(raw: str | bytes | None) -> tuple | None:
    if raw is None:
        return None
    try:
        message = email.message_from_bytes(raw.encode("utf-8", "replace") if isinstance(raw, str) else bytes(raw))
        parts = [(p, p.get_content_type(), _attached(p)) for p in message.walk() if not p.is_multipart()]
        plain, rich = ("\n".join(_text(p) for p, own, attached in parts if own == kind and not attached) for kind in ("text/plain", "text/html"))
        named = any(attached or (not own.startswith("text/") and p.get_filename()) for p, own, attached in parts)
        first = {}
        for name, value in message.items():
            first.setdefault(name.lower(), value)
        return (*[_decoded(first.get(h.lower())) for h in HEADERS.values()], plain or rich, rich or None, bool(message.is_multipart() and named))
    except (email.errors.MessageError, ValueError, AttributeError):
        return None


@F.pandas_udf(RECORD)
def _records(raw: pd.Series) -> pd.DataFrame:
    empty = (None,) * len(RECORD)
    return pd.DataFrame([_record(r) or empty for r in raw], columns=RECORD.names).astype(object)


def parse_messages(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds record, the parsed message of a raw RFC 5322 text or its bytes; a record of nulls where that fails."""
    return raw.withColumn("record", _records(F.col(column)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (chunk, file, block): a chunk without its separator's own line, its lines as they were before 'From ' was quoted in them.

    behind: how many bytes stand before the chunk in its byte range; a range is read by one task, from its beginning. Empty chunks go.
    """
    at, seen = None, 0
    for batch in batches:
        chunks, files, blocks = batch.columns
        raws, kept, out = [], [], []
        for i, (chunk, *place) in enumerate(zip(chunks.to_pylist(), files.to_pylist(), blocks.to_pylist(), strict=True)):
            if place != at:
                at, seen = place, 0
            if chunk:
                raw = chunk.partition(b"\n")[2]
                raws.append(QUOTED.sub(rb"\1", raw) if b">From " in raw else raw)
                kept.append(i)
                out.append(seen)
            seen += len(chunk) + CUT
        kept = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary()), files.take(kept), blocks.take(kept), pa.array(out, pa.int64())], names=["raw", "file", "block", "behind"])


def mbox_text(raw: Column) -> Column:
    """A message as it stands in a mailbox file: lines that begin with 'From ', quoted or not, get a '>' more."""
    return F.when(F.contains(raw, F.lit("From ")), F.regexp_replace(raw, r"(?m)^(>*From )", r">$1")).otherwise(raw)


def write_mbox(rows: DataFrame, path: str, *, raw: str = "raw", sender: str = "sender", box: str = "box", order: str = "id", boxes: int = 32) -> None:
    """Write raw messages as mailbox files, one file below path/box=<value> for each value of `box`, in the order given.

    A message begins with a line 'From <sender>'. Values of box are dealt out to `boxes` tasks, so their number bounds what one task writes.
    """
    made = rows.select(F.col(box).alias("box"), F.col(order).alias("_at"), _entry(raw, sender))
    made.repartition(boxes, "box").sortWithinPartitions("box", "_at").drop("_at").write.partitionBy("box").text(path)


def write_box(rows: DataFrame, path: str, *, raw: str = "raw", sender: str = "sender") -> None:
    """Write raw messages, which come in one partition and in order, as one mailbox file below path; nothing is shuffled or sorted."""
    rows.select(_entry(raw, sender)).write.text(path)


def _entry(raw: str, sender: str) -> Column:
    return F.concat(F.lit("From "), F.col(sender), F.lit("\n"), mbox_text(F.col(raw))).alias("value")


def observed_errors(messages: DataFrame, seen: Observation) -> DataFrame:
    """The same rows; what reads or writes them all also counts messages and errors (records of nulls) for `seen`, in the same pass."""
    return messages.observe(seen, F.count(F.lit(1)).alias("messages"), F.count_if(F.col("record.has_attachments").isNull()).alias("errors"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file, mbox_offset, raw_size_bytes, record) of every message of mailbox files.

    mbox_offset is the byte at which the message's 'From ' line begins; raw_size_bytes counts what follows that line. A running sum
    inside each byte range, taken where the range is read, and one over the ranges of a file give the offset, so a large file stays
    dealt out and no message goes through a shuffle.
    """
    cut = CUT
    read = spark.read.option("lineSep", "\nFrom ").text(path)
    chunks = read.select(
        F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    size = F.octet_length("chunk").cast("long") + cut
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = chunks.groupBy("file", "block").agg(F.sum(size).alias("bytes")).select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("from"))
    found = chunks.mapInArrow(_cut, "raw binary, file string, block long, behind long")
    placed = found.join(F.broadcast(blocks), ["file", "block"])  # a row a byte range
    at = F.greatest(F.lit(0), F.col("from") + F.col("behind") - cut + 1)
    return parse_messages(placed.select("raw", "file", at.alias("mbox_offset"), F.octet_length("raw").cast("long").alias("raw_size_bytes")))


def label_counts(labels: DataFrame, column: str = "labels") -> DataFrame:
    """(label, count) over the arrays of a column; a label twice in one message counts twice."""
    return labels.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def mailbox_report(messages: DataFrame, *, body: str = "body", attached: str = "has_attachments", labels: str = "labels", top: int = 50) -> DataFrame:
    """One row of an import: total_emails, emails_with_body, emails_with_attachments, n_labels, the `top` labels with counts, errors.

    A row whose `attached` is null wasn't parsed: it is an error and counts nowhere else. All labels are in label_counts(); here only
    the report's list of the most frequent ones (ties by name) is kept. No rows give zeros and an empty list.
    """
    read = F.col(attached).isNotNull()
    figures = messages.agg(
        F.count_if(read).alias("total_emails"), F.count_if(read & (F.col(body) != "")).alias("emails_with_body"), F.count_if(F.col(attached)).alias("emails_with_attachments"), F.count_if(~read).alias("errors")
    )
    counts = label_counts(messages.filter(read), labels)
    first = counts.orderBy(F.desc("count"), "label").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("count"), "label"))).alias("found"))
    first = first.select(F.transform("found", lambda x: F.struct(x["label"].alias("label"), (-x["count"]).alias("count"))).alias("label_counts"))
    return figures.crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("n_labels")))).crossJoin(F.broadcast(first))  # one row each


def write_report(report: DataFrame, path: str) -> None:
    """The one row of a report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, letters unescaped and nulls kept, one file a partition."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and bad ones land in _corrupt_record if the schema names it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def parse_push(data: Column) -> Column:
    """struct(emailAddress, historyId) of a base64 push notification, on a batch or a stream; null where it isn't one."""
    return F.from_json(F.try_to_binary(data, F.lit("base64")).cast("string"), PUSH)
