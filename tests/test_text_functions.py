"""Worked values, nulls and empty texts of the text functions."""

from __future__ import annotations

from interlake.functions import text as t
from interlake.operators import clusters as c
from interlake.operators import entities as e
from interlake.plans import text_queries
from pyspark.sql import functions as F


def values(spark, function, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    return [r.o for r in table.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_header_values(spark):
    got = {(r["kind"], r["value"]): r["found"] for r in text_queries.header_values(spark, "").collect()}
    assert got["address", '"Ann Lee" <Ann@X.test>'] == "ann@x.test|Ann Lee|ann@x.test"
    assert got["address", "no address"] == "-|-|"
    assert got["address", "Carl <c@z.test>; d@z.test, <E@z.test>"] == "c@z.test|Carl|c@z.test d@z.test e@z.test"
    assert got["label", 'Inbox,"A, B",Opened'] == "Inbox/A, B/Opened|false" and got["label", '"Sent"'] == "Sent|true"
    assert got["reference", "<a@x> b@x  junk <c@x>"] == "<a@x> <b@x> <c@x>"
    dates = {v: found for (kind, v), found in got.items() if kind == "date"}
    assert dates == dict(zip(text_queries.DATES, ["1767607872", "1767616872", "1767604272", "1767607872", "1767607872", None, None], strict=True))


def test_cleaners(spark):
    assert values(spark, t.sanitize_text, ["a\x00b\r\nc\rd", None, ""]) == ["ab\nc\nd", None, ""]
    assert values(spark, t.word_count, [" a  b c\n", None, "", "  "]) == [3, 0, 0, 0]
    assert values(spark, t.preview, ["x " * 150, None, "", " a\n b "]) == [("x " * 100)[:200] + "...", None, None, "a b"]
    assert values(spark, t.strip_template, ["a {{ b\nc }} d\n{% if %}e{# f #}<% g %>", None]) == ["a d e", None]
    signed = values(spark, t.strip_signature, ["hi\n\n-- \nAnn", "hi - there", "Sent via ", "Sent via mail", "-- x", None, ""])
    assert [tuple(r) for r in signed] == [("hi", True), ("hi - there", False), ("Sent via ", False), ("", True), ("", True), (None, False), ("", False)]
    assert values(spark, t.collapse_whitespace, [" a \t b \n \n\n c\n d ", None]) == ["a b\n\nc\nd", None]
    assert values(spark, t.normalize_chars, ["é“x”​—…", None]) == ['é"x"-...', None]
    assert values(spark, t.html_to_text, ["<html><head><title>t</title></head><body><!-- c --><p>a&amp;b</p><script>x()</script> c</body>", None, ""]) == ["a&b c", None, ""]
    assert values(spark, t.truncate_tokens, ["x" * 16001, "x" * 16000]) == ["x" * 16000 + "...", "x" * 16000]


def test_older_cleaners(spark):
    assert values(spark, t.legacy_strip_html, ["<noscript>n</noscript><p>a&amp;b</p> <head>h</head>c", None, ""]) == ["a&b c", "", ""]
    assert values(spark, t.legacy_strip_templates, ["a {{ b\nc }} d\n{% if %}e{# f #}<% g %>", None, ""]) == ["a d e<% g %>", "", ""]
    quoted = ["hi\n> old\n On Monday Ann wrote:\nTo: me\nfrom: kept\n --\nAnn", "--\nx", "-- x\nOn y wrote: z", "Sent from my iPad", None, ""]
    assert values(spark, t.legacy_strip_quotes, quoted) == ["hi\nfrom: kept", "", "-- x\nOn y wrote: z", "", "", ""]


def test_references_need_their_semicolon(spark):
    pages = ["and&amp Ly.&amp;&amp; x", "a&ampb &amp", "&copy;&quot;&#65;&#x42;&#67", "&notit; &nosuch; &amp;amp", "&copy;&amp;quot;"]
    told = ["and&amp Ly.&& x", "a&ampb &amp", '©"AB&#67', "&notit; &nosuch; &amp", "©&quot;"]
    assert values(spark, t.html_to_text, pages) == told and values(spark, t.legacy_strip_html, pages) == told


def test_project_status_edges(spark):
    table = spark.createDataFrame([(14,), (15,), (30,), (31,), (None,)], "d int")
    assert [r.s for r in table.select(c.project_status(F.col("d")).alias("s")).collect()] == ["active", "stale", "stale", "completed", "stale"]


def test_entities_of_empty_tables(spark):
    mail = spark.createDataFrame([], "id long, from_email string, subject string, thread_id string, date_parsed timestamp, is_sent boolean")
    contacts = spark.createDataFrame([], "email string, name string, reply_rate double, emails_from long, is_important boolean")
    people = spark.createDataFrame([], "id long, is_real_person boolean")
    clusters = spark.createDataFrame([], "id long, cluster int")
    threads = e.projects_from_threads(mail, contacts, "me@corp.test")
    assert threads.count() == 0
    assert e.projects_from_clusters(mail, clusters, people, threads).count() == 0
    assert c.cluster_activity(mail, clusters).count() == 0


def test_own_addresses(spark):
    got = values(spark, lambda v: e.is_you(v, "me@corp.test"), ["ME@corp.test", "x.me.y@corp.test", "me@other.test", "bob@corp.test"])
    assert got == [True, True, False, False]
