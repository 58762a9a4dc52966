"""The queries on whole texts and tables against their oracles, and proof that nothing is cut."""

from __future__ import annotations

import duckdb
import pytest
from interlake.plans import feature_queries, list_queries, scoring, whole_queries
from interlake.functions import text as t
from interlake.operators import features as f
from interlake.operators import rules as r
from interlake.plans.mailbox import BODY_SQL, WHOLE_BODY_SQL, messages, with_collapsed, with_previews
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(values):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in values)


@pytest.mark.parametrize("name", sorted(whole_queries.ORACLES))
def test_whole_oracle(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in ("events", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, sql = whole_queries.QUERIES[name](spark, SF), whole_queries.ORACLES[name]
    columns = sorted(got.columns)
    assert columns == sorted(db.sql(sql).columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(*columns).collect()) == rows(db.sql(f"SELECT {listed} FROM ({sql})").fetchall())


def test_words_after_400_characters_count(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, "x" * 5000 + " unsubscribe?")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert messages(spark, str(tmp_path), body=True, whole=True).filter("body_text NOT LIKE '%unsubscribe?'").count() == 0
    patterns = whole_queries.QUERIES["detect_patterns_whole"](spark, str(tmp_path))
    assert patterns.filter("NOT has_question").count() == 0
    sure = F.min("service_confidence").alias("least")
    assert whole_queries.QUERIES["detect_service_whole"](spark, str(tmp_path)).agg(sure).first().least >= 0.3
    assert scoring.QUERIES["detect_service"](spark, str(tmp_path)).agg(sure).first().least == 0  # the fixture's 400 characters
    assert whole_queries.QUERIES["parse_message_whole"](spark, str(tmp_path)).filter("body NOT LIKE '%unsubscribe?'").count() == 0


def test_no_half_of_the_mailbox_is_left_out(spark):
    n = messages(spark, SF).count()
    target, batch = whole_queries._tables(spark, SF)
    assert target.count() == batch.count() == n
    kept = whole_queries.QUERIES["delete_by_predicate_whole"](spark, SF)
    assert kept.filter("id % 2 = 1").count() > 0 and kept.count() + target.filter("from_email LIKE '%@svc.test'").count() == n


def test_facts_of_bodies_equal_those_of_their_texts(spark, tmp_path):
    """What a document tells once, put together with the phrase, is what the whole body tells; also across the seam of the two."""
    texts = ["", None, " \n\n  led <b>x</b>\n \n y ", "of end of", "\n\n", "<!-- unsubscribe --> a&amp;b", "unsubscribe", "k.", "\u00a0 z\u00a0", "\nq", "end of day\u0130?", "  two  words "]
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    path = str(tmp_path)
    whole, facts = messages(spark, path, body=True, whole=True), messages(spark, path, whole=True, facts=True)
    said = lambda rows: rows.select("id", "is_service", "service_confidence", *r.PATTERNS)
    a, b = (said(r.with_patterns(r.with_service(x))) for x in (whole, facts))
    assert a.exceptAll(b).count() == 0 and b.count() == whole.count()
    a, b = f.email_features(whole), f.email_features(facts)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    ids = messages(spark, path).select("id")
    a = whole.select("id", t.collapse_whitespace(F.col("body_text")).alias("body"), F.left("body_text", F.lit(20)).alias("body_preview"))
    b = with_previews(spark, path, with_collapsed(spark, path, ids), 20).select("id", "body", "body_preview")
    assert a.exceptAll(b).count() == 0 and b.count() == whole.count()


def test_scores_of_a_page_are_made_once(spark, monkeypatch):
    """The ranks and the contexts of the page by rank read the same scores."""
    made = []
    real = scoring.p.priority_scores
    monkeypatch.setattr(scoring.p, "priority_scores", lambda *args: made.append(1) or real(*args))
    assert list_queries.QUERIES["inbox_priority_page"](spark, SF, whole=True).count() == 100 and len(made) == 1


def test_a_batch_is_drawn_before_its_context_and_texts_are_read_once(spark, monkeypatch):
    """The context is joined to the 50 messages drawn, and what documents tell is found once for classes, scores and features."""
    joined, read = [], []
    context, found = feature_queries.mi.with_model_context, feature_queries.messages
    monkeypatch.setattr(feature_queries.mi, "with_model_context", lambda wanted, *more: joined.append(wanted.count()) or context(wanted, *more))
    for module in (feature_queries, scoring):
        monkeypatch.setattr(module, "messages", lambda *args, facts=False, **more: read.append(facts) or found(*args, facts=facts, **more))
    got = feature_queries.QUERIES["llm_batch"](spark, SF, whole=True).collect()
    assert len(got) == 50 and joined == [50] and sum(read) == 1


def test_prompts_show_scores_of_whole_texts(spark, tmp_path):
    """Services that only the end of a text gives away count in the scores and ranks that a prompt shows."""
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(n, "word " * 300 + "unsubscribe" * (n % 2)) for n in range(7)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in ("events", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    sql = feature_queries.ORACLES["llm_prompt"]
    whole = rows(db.sql(sql.replace(BODY_SQL, WHOLE_BODY_SQL)).fetchall())
    assert whole and rows(feature_queries.QUERIES["llm_prompt"](spark, str(tmp_path)).select("id", "prompt_md5").collect()) == whole
    assert BODY_SQL not in sql
