"""Mailbox files, raw messages and the notification stream on small inputs."""

from __future__ import annotations

import base64
import json

from interlake.operators import changes as c
from interlake.sources import mailbox_files as mf
from interlake.streaming.notifications import notifications
from pyspark.sql import functions as F

MBOX = """From a@x Mon Jan 05 10:00:00 2026
Message-ID: <1@x>
From: =?utf-8?q?J=C3=B6rg?= <j@x.test>
Subject: plain

hello
>From me
From b@x Mon Jan 05 10:00:00 2026
Message-ID: <2@x>
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/html

<p>rich</p>
--B
Content-Type: application/pdf
Content-Disposition: attachment; filename=a.pdf

x
--B--
"""


def test_mbox(spark, tmp_path):
    (tmp_path / "m.mbox").write_text(MBOX)
    got = {r.message_id: r for r in mf.read_mbox(spark, str(tmp_path / "m.mbox")).select("record.*").collect()}
    assert set(got) == {"<1@x>", "<2@x>"}
    assert got["<1@x>"]["from"] == "Jörg <j@x.test>" and got["<1@x>"].body.strip() == "hello\nFrom me" and not got["<1@x>"].has_attachments
    assert got["<2@x>"].body.strip() == got["<2@x>"].body_html.strip() == "<p>rich</p>" and got["<2@x>"].has_attachments


def test_mbox_bytes_and_offsets(spark, tmp_path):
    latin = b"Message-ID: <n%d@x>\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\nX-Gmail-Labels: Inbox\n\ncaf\xe9 %d"
    messages = [b"From a@x Mon Jan 05\n" + latin % (n, n) + b"\nline" * (n % 7) for n in range(300)]
    whole = b"\n".join(messages)
    (tmp_path / "l.mbox").write_bytes(whole)
    (tmp_path / "m.mbox").write_text("\n" + MBOX)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)  # many byte ranges a file
    try:
        rows = mf.read_mbox(spark, str(tmp_path)).select("mbox_offset", "raw_size_bytes", "raw", "record", F.element_at(F.split("file", "/"), -1).alias("f")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = sorted((r for r in rows if r.f == "l.mbox"), key=lambda r: r.mbox_offset)
    at = 0
    for n, (r, text) in enumerate(zip(found, messages, strict=True)):
        assert (r.mbox_offset, bytes(r.raw)) == (at, text.partition(b"\n")[2]) and r.raw_size_bytes == len(r.raw)
        assert r.record.message_id == f"<n{n}@x>" and r.record.body.startswith(f"caf\u00e9 {n}")
        at += len(text) + 1
    assert sorted(r.mbox_offset for r in rows if r.f == "m.mbox") == [1, 2 + MBOX.index("\nFrom b@x")]


def test_report_and_json_lines(spark, tmp_path):
    none = spark.createDataFrame([], "body string, has_attachments boolean, labels array<string>")
    empty = mf.mailbox_report(none).collect()[0]
    assert (empty.total_emails, empty.errors, empty.n_labels, empty.label_counts) == (0, 0, 0, [])
    rows = spark.createDataFrame([("h\u00e9", True, ["b", "a"]), ("", False, ["b"]), (None, False, None), (None, None, ["z"])], none.schema)
    got = mf.mailbox_report(rows, top=1).collect()[0]
    assert (got.total_emails, got.emails_with_body, got.emails_with_attachments, got.errors, got.n_labels) == (3, 1, 1, 1, 2)
    assert [tuple(x) for x in got.label_counts] == [("b", 2)]
    mf.write_report(mf.mailbox_report(rows), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().errors == 1
    mf.write_jsonl(rows, str(tmp_path / "lines"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "lines")).collect())
    assert "h\u00e9" in text and '"labels":null' in text
    assert mf.read_jsonl(spark, str(tmp_path / "lines"), none.schema).count() == 4


def test_raw_nulls_and_empty_texts(spark):
    rows = mf.parse_messages(spark.createDataFrame([(1, None), (2, ""), (3, "no header at all")], "id int, raw string")).select("id", "record.message_id", "record.body").collect()
    assert {r.id: r.message_id for r in rows} == {1: None, 2: None, 3: None}


def test_push_stream(spark, tmp_path):
    data = [base64.b64encode(json.dumps({"emailAddress": a, "historyId": h}).encode()).decode() for a, h in (("a@x", "1"), ("a@x", "1"), ("b@x", "1"))]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(d,) for d in [*data, "!!", None]], "data string").withColumn("received_at", F.lit("2026-01-05 10:00:00").cast("timestamp")).write.parquet(folder)
    stream = notifications(spark.readStream.schema("data string, received_at timestamp").parquet(folder))
    query = stream.writeStream.format("memory").queryName("pushed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.email, r.history_id) for r in spark.table("pushed").collect()) == [("a@x", "1"), ("b@x", "1")]


def test_changes_on_empty_and_repeated_keys(spark):
    none = spark.createDataFrame([], "k long, v string")
    some = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")
    assert sorted(map(tuple, c.insert_if_absent(none, some, "k", "v").collect())) == [(1, "a"), (2, None)]
    assert c.insert_if_absent(some, none, "k", "v").count() == 0
    assert c.upsert(some, none, "k").count() == 3 and c.upsert(none, some, "k").count() == 3
    assert c.delete_where(some, "v = 'a'").count() == 2


def test_mbox_offsets_without_a_shuffle_of_messages(spark, tmp_path):
    """Running sums go on over Arrow batches, and what is shuffled is a row a byte range."""
    (tmp_path / "a.mbox").write_text("".join(f"From a@x\nMessage-ID: <{n}@x>\n\n{'x' * n}\n" for n in range(9)))
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = mf.read_mbox(spark, str(tmp_path))
        text = (tmp_path / "a.mbox").read_text()
        got = {r.i: r.mbox_offset for r in found.select(F.col("record.message_id").alias("i"), "mbox_offset").collect()}
        assert got == {f"<{n}@x>": text.index(f"From a@x\nMessage-ID: <{n}@x>") for n in range(9)}
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
