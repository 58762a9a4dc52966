"""Features, clusterings, cleaning, API payloads and syncing on worked values and invariants."""

from __future__ import annotations

import base64
import datetime as dt
import json

import numpy as np
from interlake.functions import text as t
from interlake.operators import features, inbox, keyed, model_inputs
from interlake.sources import api_messages
from interlake.streaming import sync
from pyspark.sql import functions as F


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


def test_quotes_and_visible_text(spark):
    assert one(spark, "hi\n> old\n\nagain\nOn Monday Ann wrote:\n> x\n\nlast", t.strip_quotes) == "hi\nagain\n\n\nlast"  # a reply head and its quotation go as one, the blank lines around stay
    assert one(spark, "a\nSubject: b\nc > tail", t.strip_quotes) == "a\nc"
    assert one(spark, None, t.strip_quotes) == ""
    page = "<head><title>no</title></head><p>Seen &amp; <span style='DISPLAY: none'>no <b>nor this</b></span>heard</p><!-- no --><script>no</script><img width='1'>end"
    assert one(spark, page, t.visible_text) == "Seen & heard end"
    got = one(spark, "<p>Hello {{name}}</p><p>you</p>", t.sanitize)
    assert got.text == "Hello you" and got.html_stripped and not got.quotes_removed
    empty = one(spark, None, t.sanitize)
    assert empty.text == "" and empty.original_length == 0 and empty.reduction_ratio == 0


def test_api_addresses_and_dates(spark):
    assert tuple(one(spark, '"Ann Lee" <Ann@X.test>', t.parse_address_api)) == ("ann@x.test", "Ann Lee")
    assert tuple(one(spark, "<Bob@Y.test>", t.parse_address_api)) == ("bob@y.test", None)
    assert tuple(one(spark, " nobody ", t.parse_address_api)) == ("nobody", None)
    assert one(spark, 'a@x, "B, C" <b@x>,, ', t.split_addresses_api) == ["a@x", '"B, C" <b@x>']
    assert one(spark, "2026-01-05T10:11:12Z", lambda c: F.unix_seconds(t.parse_date_api(c))) == 1767607872


def test_payload_with_nested_parts(spark):
    data = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    inner = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": data("<b>h</b>")}}, {"mimeType": "text/plain", "body": {"data": data("plain ~ ÿ?")}}]}
    file = {"mimeType": "application/pdf", "headers": [{"name": "Content-Disposition", "value": "ATTACHMENT; x"}]}
    message = {"id": "1", "labelIds": ["SENT"], "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "From", "value": "A <A@x>"}, {"name": "from", "value": "B <B@x>"}], "parts": [{"mimeType": "multipart/related", "parts": [inner]}, {"mimeType": "multipart/mixed", "parts": [file]}]}}
    raw = spark.createDataFrame([(json.dumps(message),), ("no json",), (json.dumps({"id": "2"}),)], "value string")
    rows = {r.api_id: r for r in api_messages.parse_payloads(raw).collect()}
    assert rows["1"].body_plain == "plain ~ ÿ?" and rows["1"].body_html == "<b>h</b>" and rows["1"].has_attachments and rows["1"].is_sent
    assert rows["1"].from_address == "B <B@x>" and rows["2"].body_plain is None and not rows["2"].has_attachments and rows[None].parse_error
    assert api_messages.to_records(api_messages.parse_payloads(raw)).count() == 2


def test_kmeans_invariants(spark):
    rnd = np.random.default_rng(1)
    centres = [(0.0, 0.0), (50.0, 50.0), (0.0, 90.0)]
    rows = [(i, float(centres[i % 3][0] + rnd.normal()), float(centres[i % 3][1] + rnd.normal())) for i in range(90)]
    matrix = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: r for r in features.kmeans_clusters(features.standard_scale(matrix, "a", "b"), ["a", "b"], 3).collect()}
    assert len({got[i].cluster for i in range(3)}) == 3 and all(got[i].cluster == got[i % 3].cluster for i in range(90))
    assert min(r.prob for r in got.values()) == 0 and all(0 <= r.prob <= 1 for r in got.values())
    assert features.kmeans_clusters(matrix.limit(0), ["a", "b"], 3).count() == 0
    same = features.kmeans_clusters(matrix.limit(1), ["a", "b"], 3).collect()
    assert len(same) == 1 and same[0].prob == 1
    scaled = features.standard_scale(matrix.withColumn("c", F.lit(4.0)), "a", "c").agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("c").alias("c")).first()
    assert abs(scaled.m) < 1e-9 and abs(scaled.s - 1) < 1e-9 and scaled.c == 0


def test_far_content_is_noise_only_if_asked(spark):
    rows = [(i, [float(i % 2) * 10 + (0.01 * i if i < 38 else 4.0), 1.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    plain = {r.id: r.cluster for r in features.cluster_content(table, 2).collect()}
    noisy = {r.id: (r.cluster, r.prob) for r in features.cluster_content(table, 2, noise=0.05).collect()}
    assert set(plain.values()) == {0, 1}
    assert {i for i, (c, _) in noisy.items() if c == -1} == {38, 39} and noisy[38] == (-1, 0.0)
    assert all(noisy[i][0] == plain[i] for i in range(38))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "id long, embedding array<double>")
    assert {r.cluster for r in features.cluster_content(same, 2, noise=0.5).collect()} == {0}


def test_patches_and_pages(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "k int, x string, y int")
    new = spark.createDataFrame([(1, None), (3, "c"), (9, "z")], "k int, x string")
    assert sorted(map(tuple, keyed.patch(rows, new, ["k"]).collect())) == [(1, None, 5), (2, "b", 6), (3, "c", 7)]
    assert tuple(inbox.envelope(rows, inbox.page(rows, [F.asc("k")], 2, 1), 2, 1).first()) == (3, 2, 1, False)
    assert keyed.checked(rows, {"x": F.col("x") != "b", "y": F.col("y") > 5}).orderBy("k").first().errors == ["y"]
    assert [r.ok for r in spark.createDataFrame([("a-b1",), ("A",), ("a--b",), ("-a",)], "slug string").select(keyed.slug_rule().alias("ok")).collect()] == [True, False, False, False]


def test_replies_and_prompts(spark):
    replies = spark.createDataFrame([(1, '```json\n{"action_type": "task"}\n```'), (2, ' {"action_type":"reply","urgency":"today"} '), (3, "no"), (4, None)], "email_id int, reply string")
    got = {r.email_id: (r.action_type, r.urgency, r.parse_error) for r in model_inputs.answers_from_replies(replies).collect()}
    assert got == {1: ("task", None, False), 2: ("reply", "today", False), 3: (None, None, True), 4: (None, None, True)}
    fields = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    assert sorted(r.prompt for r in model_inputs.filled_prompt("a {name} {other} b{", fields).collect()) == ["a  {other} b{", "a x {other} b{"]


def test_phases_and_micro_batches(spark, tmp_path):
    now = dt.datetime(2026, 1, 31)
    mail = spark.createDataFrame([(i, now - dt.timedelta(hours=i)) for i in range(400)], "id long, date_parsed timestamp_ntz")
    first = sync.phase_batches(mail, sync.Phase("quick", 0, 7, 10))
    assert first.count() == 168 and first.filter("batch.n > 2").count() == 0 and first.groupBy("batch").count().agg(F.max("count")).first()[0] == 10
    done = []
    assert sync.run_phases(mail, sync.phases(), lambda rows, p: done.append((p.name, rows.count()))) == ["quick", "recent", "deep"]
    assert done == [("quick", 168), ("recent", 232), ("deep", 0)]
    mail.select("id").repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    query = sync.micro_batches(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), [lambda b, n: seen.append(b.count()), lambda b, n: seen.append(b.agg(F.max("id")).first()[0])], str(tmp_path / "at"))
    query.awaitTermination(60)
    assert sum(seen[::2]) == 400 and max(seen[1::2]) == 399


def test_rows_that_stand_for_many_equal_ones_weigh_as_many(spark):
    """A clustering of kinds with their numbers is that of all rows: a heavy kind pulls the centre, and with it what the others get."""
    kinds = [(g * 10 + j, [g * 50.0 + j, g * 20.0 - j], 40 if j == 0 else 1) for g in range(3) for j in range(4)]
    few = spark.createDataFrame(kinds, "id long, embedding array<double>, times int")
    many = spark.createDataFrame([(i * 100 + n, v) for i, v, times in kinds for n in range(times)], "id long, embedding array<double>")
    a = {r.id: (r.cluster, round(r.prob, 9)) for r in features.cluster_content(few, 3, times="times").collect()}
    b = {r.id: (r.cluster, round(r.prob, 9)) for r in features.cluster_content(many, 3).collect()}
    assert {i: b[i * 100][1] for i in a} == {i: p for i, (_, p) in a.items()}
    assert len({(a[i][0], b[i * 100][0]) for i in a}) == 3 == len({c for c, _ in a.values()})
