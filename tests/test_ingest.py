"""Stored tables, the history stream, kept figures, stages, labels, mailbox files and deep payloads on small inputs."""

from __future__ import annotations

import base64
import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from interlake import storage
from interlake.operators import labels as lb
from interlake.operators import mail as m
from interlake.plans import stages
from interlake.plans.mailbox import messages
from interlake.sources import api_messages, history
from interlake.sources import mailbox_files as mf
from interlake.streaming import figures
from interlake.tables import Table
from pyspark.sql import Observation
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("part-*.parquet")}


def values(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ["k"], buckets=16)
    with pytest.raises(ValueError, match="never written"):
        table.read()
    assert table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    first, seen = files(tmp_path), table.read()
    assert table.upsert(spark.createDataFrame([(7, "new"), (7, "later"), (500, "more")], "k long, v string"), "v", writer="w", number=3)
    added = files(tmp_path) - first
    assert files(tmp_path) >= first and 1 <= len({f.split("/")[2] for f in added}) <= 2  # two buckets at most
    assert seen.filter("k = 7").first().v == "old" and seen.count() == 200  # a reader goes on with what it began with
    now = {r.k: r.v for r in table.read().collect()}
    assert len(now) == 201 and now[7] == "later" and now[500] == "more" and now[8] == "old"
    assert not table.upsert(spark.createDataFrame([(7, "again")], "k long, v string"), writer="w", number=3) and table.version == 2
    assert table.upsert(spark.createDataFrame([], "k long, v string"), writer="w", number=4) and table.read().count() == 201
    table.vacuum(keep=1)
    assert table.read().count() == 201 and not added & (first - files(tmp_path)) and len(files(tmp_path)) < len(first | added)


def test_merge_and_replace(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ["k"], buckets=4)
    part = spark.createDataFrame([("a", 1, 5), ("b", 2, None), ("a", 3, 1)], "k string, n long, least int")
    for number in (0, 1, 1, 0):
        table.merge(part, {"n": F.sum, "least": F.min}, writer="w", number=number)
    assert values(table.read().select("k", "n")) == [("a", 8), ("b", 4)] and table.read().filter("k = 'a'").first().least == 1
    table.replace(table.read().filter("k = 'a'"))  # its own rows
    assert values(table.read().select("k", "n")) == [("a", 8)]
    table.replace(table.read().limit(0))
    assert table.read().count() == 0 and table.read().columns == ["k", "n", "least"]


def test_two_writers_do_not_both_win(spark, tmp_path):
    one, two = Table(spark, str(tmp_path / "t"), ["k"]), Table(spark, str(tmp_path / "t"), ["k"])
    rows = spark.createDataFrame([(1, "x")], "k long, v string")
    one.upsert(rows)
    state = two._state()
    one.upsert(rows)
    with pytest.raises(RuntimeError, match="another writer"):
        two._commit(state | {"version": state["version"] + 1})


def test_history_goes_on_after_a_break_and_a_lost_cursor(spark, tmp_path):
    pages, at, known = str(tmp_path / "pages"), str(tmp_path / "at"), Table(spark, str(tmp_path / "known"), ["message_id"], buckets=4)
    rows = lambda ids: spark.createDataFrame([(i, f"m{i % 40}" if i % 4 else None) for i in ids], "history_id long, message_id string")
    history.write_history(rows(range(1, 60)), pages)
    assert history.sync_history(spark, pages, known, at, cursor=10) == 59
    assert history.sync_history(spark, pages, known, at, cursor=10) in (10, 59)  # nothing new
    first = values(known.read())
    assert first == sorted({f"m{i % 40}": (f"m{i % 40}", i, False) for i in range(59, 10, -1) if i % 4}.values())
    history.write_history(rows(range(60, 100)), pages)
    assert history.sync_history(spark, pages, known, at) == 99
    both = {f"m{i % 40}": (f"m{i % 40}", i, False) for i in range(99, 10, -1) if i % 4}
    assert values(known.read()) == sorted(both.values())  # as one run over all, none twice
    # The provider has forgotten what the cursor stands at.
    late = Table(spark, str(tmp_path / "late"), ["message_id"], buckets=4)
    history.forget_before(pages, 50)
    with pytest.raises(Exception, match="no listing"):
        history.sync_history(spark, pages, late, str(tmp_path / "at2"), cursor=10)
    spark.createDataFrame([(i, f"all{i}") for i in range(30)], "history_id long, message_id string").write.parquet(str(tmp_path / "listing"))
    history.sync_history(spark, pages, late, str(tmp_path / "at3"), cursor=10, listing=str(tmp_path / "listing"))
    assert values(late.read().select("message_id", "resync")) == sorted((f"all{i}", True) for i in range(30))


def test_a_repeated_batch_changes_no_figure(spark, tmp_path):
    mail = messages(spark, SF)
    kept = figures.Figures(spark, str(tmp_path), buckets=4)
    parts = [mail.filter(F.col("id") % 3 == n) for n in (2, 0, 1)]
    for n, part in enumerate(parts):
        assert len(kept.add(part, n)) == 5
        assert kept.add(part, n) == []
    # As if the last batch had failed halfway: two tables lack it.
    half = figures.Figures(spark, str(tmp_path / "half"), buckets=4)
    for n, part in enumerate(parts[:2]):
        half.add(part, n)
    for name in ("threads", "links"):
        half.tables[name].merge(figures.partials(parts[2])[name], figures.TOTALS[name], writer="mail", number=2)
    assert sorted(half.add(parts[2], 2)) == ["arrivals", "contacts", "initiated"]
    for own in (kept, half):
        assert values(own.thread_stats()) == values(m.thread_stats(mail)) and values(own.sender_stats()) == values(m.sender_stats(mail))
    assert sorted(map(str, kept.contact_profile().collect())) == sorted(map(str, m.contact_profile(mail).collect()))


def test_stages_stop_start_and_skip(spark, tmp_path):
    calls = []

    def one(name, n):
        def make(table, spark, sf_dir):
            calls.append(name)
            if name == "bad" and "mend" not in calls:
                raise ValueError("broken stage")
            return table("a").withColumn(name, F.lit(n)) if name != "a" else spark.range(n)

        return make

    todo = [stages.Stage("a", one("a", 7), {"most": "max(id)"}), stages.Stage("b", one("b", 1)), stages.Stage("ask", one("ask", 2), kind="model"), stages.Stage("bad", one("bad", 3)), stages.Stage("end", one("end", 4))]
    events = []
    pipeline = stages.Pipeline(spark, SF, str(tmp_path), todo)
    run = pipeline.run(leave_out={"model"}, tell=lambda name, event, result: events.append((name, event)))
    assert not run.success and run.completed == ["a", "b"] and run.skipped == ["ask"] and run.failed == ["bad"] and "broken stage" in run.error
    assert events == [("a", "start"), ("a", "complete"), ("b", "start"), ("b", "complete"), ("ask", "skip"), ("bad", "start"), ("bad", "fail")]
    assert run.results["a"].records_processed == 7 and run.results["a"].metadata == {"most": 6} and str(run.results["a"]).startswith("SUCCESS: stored a (7 records in")
    assert pipeline.missing() == ["ask", "bad", "end"]
    calls[:] = ["mend"]
    again = pipeline.run(start_from="bad")
    assert again.success and again.completed == ["bad", "end"] and again.skipped == ["a", "b", "ask"] and calls == ["mend", "bad", "end"]
    assert pipeline.table("end").count() == 7
    with pytest.raises(ValueError, match="no stage"):
        pipeline.run(start_from="nowhere")


def test_label_replies(spark):
    said = ['{"label": " Budget ", "confidence": 0.9}', '```json\n{"label":"x"}\n```', "Just a name", '{"label": 1', "", None, '{"confidence": 0.2}', "y" * 80]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, reply string").select("i", lb.parsed_label(F.col("reply")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) if r.r else None for r in rows] == [("Budget", 0.9, True), ("x", 0.5, True), ("Just a name", 0.3, True), ('{"label": 1', 0.3, True), (None, 0.3, False), None, ("", 0.2, True), ("y" * 50, 0.3, True)]


def test_term_labels_on_ties_nulls_and_labelled(spark):
    meta = spark.createDataFrame([("content", 1, None), ("content", 2, "known"), ("content", 3, None), ("content", 4, None)], "dimension string, cluster_id int, auto_label string")
    texts = spark.createDataFrame([("content", 1, "budget Budget review plan of it"), ("content", 2, "review other"), ("content", 3, "one"), ("content", None, "x"), ("content", 4, None)], "dimension string, cluster_id int, text string")
    assert values(lb.term_labels(meta, texts)) == [("content", 1, "budget plan review")]
    assert {r.cluster_id for r in lb.term_labels(meta, texts, redo=True, least=1).collect()} == {1, 2, 3}
    assert lb.term_labels(meta, texts.limit(0)).collect() == []


def test_mailbox_files_round_trip(spark, tmp_path):
    raws = [f"Message-ID: <{i}@x>\nSubject: s{i}\n\nFrom me\n>From you\n>>From all\nend {i}" for i in range(50)]
    rows = spark.createDataFrame([(i, f"a{i}@x", i % 3, r) for i, r in enumerate(raws)] + [(50, "b@x", 0, "Message-ID: <50@x>\nContent-Type: text/plain; charset=idna\n\nunreadable")], "id int, sender string, box int, raw string")
    mf.write_mbox(rows, str(tmp_path / "boxes"), boxes=2)
    assert len(list((tmp_path / "boxes").rglob("part-*"))) == 3
    seen = Observation()
    got = mf.observed_errors(mf.read_mbox(spark, str(tmp_path / "boxes" / "box=*")), seen).select("raw", "record.*").collect()
    assert seen.get == {"messages": 51, "errors": 1}
    assert sorted(bytes(r.raw).decode().rstrip("\n") for r in got) == sorted(r.raw for r in rows.collect())


def coded(text):
    return base64.urlsafe_b64encode(text if isinstance(text, bytes) else text.encode()).decode().rstrip("=")


def test_payloads_of_any_depth(spark):
    rnd = random.Random(2)
    texts, raws = {}, []
    for depth in [*range(51), 400]:
        text = f"depth {depth} ÿ~?" + "x" * rnd.randrange(5)
        part = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": coded(f"<b>{depth}</b>")}}, {"mimeType": "text/plain", "body": {"data": coded(text)}}, {"mimeType": "text/plain", "body": {"data": coded("second")}}]}
        if depth % 2:
            part["parts"].append({"mimeType": "application/pdf", "headers": [{"name": "CONTENT-disposition", "value": "Attachment; x"}], "parts": None})
        for _ in range(depth):
            part = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {"data": "!!"}}, part, None]}
        texts[str(depth)] = text
        raws.append((json.dumps({"id": str(depth), "payload": part}),))
    raws.append((json.dumps({"id": "bytes", "payload": {"mimeType": "text/plain", "body": {"data": coded(b"a\xff\xfeb")}}}),))
    got = {r.api_id: r for r in api_messages.parse_payloads(spark.createDataFrame(raws, "value string")).collect()}
    assert {d: got[d].body_plain for d in texts} == texts
    assert all(got[d].body_html == f"<b>{d}</b>" and got[d].has_attachments == bool(int(d) % 2) for d in texts)
    assert got["bytes"].body_plain == "a��b"
    for raw, in raws[:5]:  # the walk and the columns tell the same
        plain, rich, attached = api_messages._walk(raw)
        own = got[json.loads(raw)["id"]]
        assert (plain, rich, attached) == (own.body_plain, own.body_html, own.has_attachments)


def test_terms_of_shared_texts_count_as_often_as_they_are_used(spark):
    texts = [("content", 1, "alpha beta"), ("content", 1, "alpha beta"), ("content", 2, "alpha gamma")]
    one = spark.createDataFrame(texts, "dimension string, cluster_id long, text string")
    few = one.groupBy("dimension", "cluster_id", "text").agg(F.count(F.lit(1)).alias("times"))
    few = few.select("dimension", "cluster_id", "times", lb.terms(F.col("text")).alias("terms"))
    a, b = lb.term_weights(one), lb.term_weights(few)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 4


def test_kept_figures_are_written_by_all_tasks(spark, tmp_path):
    from interlake.plans import ingest_queries, mailbox

    spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), "id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props")).withColumnRenamed("id", "user_id").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    made = []
    real = ingest_queries.new_folder
    ingest_queries.new_folder = lambda *a: made.append(real(*a)) or made[-1]
    try:
        got = ingest_queries._kept(spark, str(tmp_path)).thread_stats()
    finally:
        ingest_queries.new_folder = real
    assert got.agg(F.sum("email_count")).first()[0] == mailbox.messages(spark, str(tmp_path)).count() == 400
    assert len(spark.read.parquet(f"{made[0]}/in").inputFiles()) > 5


def test_only_some_boxes_of_a_mailbox_are_on_disk(spark, monkeypatch):
    """Boxes are written, read and removed one after the other, and a text that they show is kept once a box, not once a message."""
    from interlake.plans import ingest_queries

    monkeypatch.setattr(ingest_queries, "AT_ONCE", 1, raising=False)
    monkeypatch.setattr(ingest_queries, "GROUP", 1, raising=False)
    folders, there, kept = [], [], []
    folder, read, ordered = ingest_queries.new_folder, mf.read_mbox, getattr(ingest_queries, "in_order_with_texts", None)
    boxes = lambda: list(Path(folders[0].removeprefix("file://")).rglob("box=*/*.txt"))
    monkeypatch.setattr(ingest_queries, "new_folder", lambda *args: folders.append(folder(*args)) or folders[-1])
    monkeypatch.setattr(mf, "read_mbox", lambda *args: there.append(len({f.parent for f in boxes()})) or read(*args))
    monkeypatch.setattr(ingest_queries, "in_order_with_texts", lambda rows, texts, *more: kept.append(texts.count()) or ordered(rows, texts, *more), raising=False)
    found = ingest_queries.src_mbox(spark, SF)
    mail = messages(spark, SF)
    assert found.count() == mail.count() and there == [1] * 32 and boxes() == []
    shown = mail.filter("id % 3 <> 0 AND id % 50 <> 7")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(kept) == shown.selectExpr(f"id % {n}", "id % 32").distinct().count() < shown.count()


def test_rows_in_order_take_texts_from_one_copy(spark):
    texts = spark.createDataFrame([(1, "one"), (2, "zwei ü"), (2, "two"), (3, None), (4, ""), (None, "none"), (9, "unused")], "doc long, text string")
    rows = spark.createDataFrame([(n, n % 7 if n % 7 < 6 else None, ["x"] * (n % 3)) for n in range(40)], "id long, doc long, labels array<string>").repartition(5)
    got = list(map(tuple, storage.in_order_with_texts(rows, texts, "doc", "text", "id").collect()))
    said = {1: ["one"], 2: ["zwei ü", "two"], 4: [""]}
    assert [g[0] for g in got] == [n for n in range(40) for _ in said.get(n % 7, [None])]
    assert sorted(map(str, got)) == sorted(str((n, n % 7 if n % 7 < 6 else None, ["x"] * (n % 3), text)) for n in range(40) for text in said.get(n % 7, [None]))


def test_texts_are_handed_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(storage, "BATCH", 5000)
    batch = pa.RecordBatch.from_pydict({"_key": pa.array([1] * 31, pa.int64()), "text": pa.array(["x" * 1000] + [None] * 30), "_row": pa.array([None] + [{"id": n} for n in range(30)])})
    out = list(storage._looked_up(iter([batch])))
    assert [b.num_rows for b in out] == [5] * 6 and [r["id"] for b in out for r in b.column("_row").to_pylist()] == list(range(30))


def test_texts_are_stored_for_some_boxes_at_a_time(spark, monkeypatch, tmp_path):
    """Where the documents' number shares no factor with that of the boxes, each falls to many of them; no more copies than COPIES are there at a time."""
    from interlake.plans import ingest_queries

    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(n, f"text {n}") for n in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stored = []
    ordered = ingest_queries.in_order_with_texts
    monkeypatch.setattr(ingest_queries, "in_order_with_texts", lambda rows, texts, *more: stored.append(len(texts.inputFiles()) and texts.count()) or ordered(rows, texts, *more))
    found = ingest_queries.src_mbox(spark, str(tmp_path))
    assert len(stored) == 32 and max(stored) <= 3 * ingest_queries.COPIES
    mail = messages(spark, str(tmp_path), body=True, whole=True)
    shown = mail.filter("id % 3 = 1 AND id % 50 <> 7").select("message_id", F.md5("body_text").alias("body_md5"))
    assert found.count() == mail.count() and shown.exceptAll(found.select("message_id", "body_md5")).count() == 0


def test_a_mailbox_without_messages_or_documents(spark, tmp_path):
    from interlake.plans import ingest_queries

    spark.read.parquet(f"{SF}/events.parquet").limit(5).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ingest_queries.src_mbox(spark, str(tmp_path)).count() == 5
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    spark.createDataFrame([(0, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert ingest_queries.src_mbox(spark, f"{tmp_path}/none").count() == 0
