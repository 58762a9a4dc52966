"""Every message query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import math
import re

import duckdb
import pytest
from interlake.operators import mail as m
from interlake.operators import priority as p
from interlake.operators import rules as r
from interlake.plans import change_queries, entity_queries, feature_queries, ingest_queries, list_queries, run_queries, scoring, text_queries
from interlake.plans import queries as q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(values):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in values)


PLANS = [q, scoring, entity_queries, text_queries, change_queries, run_queries, feature_queries, list_queries, ingest_queries]
QUERIES = {n: f for p in PLANS for n, f in p.QUERIES.items()}
ORACLES = {n: s for p in PLANS for n, s in p.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in ("events", "documents", "embeddings", "pages", "orders", "customer"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(*columns).collect()) == rows(db.sql(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall())


def test_worked_scores(spark):
    """Persons weigh relationship, services importance; a tie in the rank goes to the smaller id."""
    mail = spark.createDataFrame([(1, "a@x", False), (2, "b@x", False), (3, "a@x", True), (4, None, False)], "id long, from_email string, is_sent boolean")
    features = spark.createDataFrame([(1, 0.8, 0.6, False, 0.0), (2, 0.0, 0.6, True, 0.8), (4, None, None, False, None)], "id long, relationship_strength double, urgency_score double, is_service boolean, service_importance double")
    actions = spark.createDataFrame([(1, "PENDING")], "id long, action string")
    vectors = spark.createDataFrame([(2, [0.0, 0.0], 1), (4, None, -1)], "id long, embedding array<double>, cluster int")
    got = {r.id: r for r in p.priority_scores(mail, features, actions, vectors).collect()}
    assert {i: round(r.feature_score, 6) for i, r in got.items()} == {1: 0.72, 2: 0.7, 4: 0.0}
    assert (got[1].replied_similarity, got[1].cluster_novelty, got[1].sender_novelty) == (0.5, 0.5, 0.5)
    tied = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.9), (4, 1.0), (5, 0.0)], "id long, priority_score double")
    assert {r.id: r.priority_rank for r in p.ranked(tied, parts=4).collect()} == {4: 1, 2: 2, 1: 3, 3: 4, 5: 5}


def test_shared_vectors_score_like_a_vector_a_message(spark):
    """Messages that name a vector get what they got with a copy of it each: null and zero vectors, senders of few and none, noise, unknown names."""
    mail = spark.createDataFrame([(i, None if i % 11 == 0 else f"s{i % 7 if i < 60 else i}@x", i % 5 == 0) for i in range(70)], "id long, from_email string, is_sent boolean")
    got = mail.filter("NOT is_sent")
    features = got.selectExpr("id", "id % 10 / 10.0D AS relationship_strength", "0.5D AS urgency_score", "id % 3 = 0 AS is_service", "0.4D AS service_importance")
    actions = got.selectExpr("id", "element_at(array('REPLIED', 'IGNORED', 'PENDING'), int(id % 3) + 1) AS action")
    held = [(v, None if v == 3 else [0.0] * 4 if v == 5 else [math.sin(v * 3.0 + j) for j in range(4)], v % 4 - 1) for v in range(12)]
    held = spark.createDataFrame(held, "vec_id long, embedding array<double>, cluster int")
    uses = mail.selectExpr("id", "id % 14 AS vec_id")
    each = uses.join(held, "vec_id").drop("vec_id")
    told = lambda df: {r.id: tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()}
    want, found = told(p.priority_scores(mail, features, actions, each)), told(p.priority_scores(mail, features, actions, held, uses))
    assert found == want and len(found) == got.count() and len({r[4] for r in found.values()}) > 10


def test_rules_with_nulls_and_empty_tables(spark):
    schema = "id long, from_email string, subject string, body_text string, is_sent boolean"
    strengths = spark.createDataFrame([(1, 0.9)], "id long, relationship_strength double")
    mail = spark.createDataFrame([(1, "a@corp.test", None, None, False), (2, None, "Accepted: x", "", False), (3, None, None, None, False)], schema)
    got = {row.id: (row.handleability, row.reason, row.llm_priority) for row in r.handleability(mail, strengths).collect()}
    assert got == {1: ("human_required", "important_relationship", None), 2: ("ai_full", "calendar_response", None), 3: ("needs_llm", "ambiguous", 5)}
    assert r.handleability(spark.createDataFrame([], schema), strengths).count() == 0


def test_response_buckets(spark):
    edges = {3599: "IMMEDIATE", 3600: "SAME_DAY", 86399: "SAME_DAY", 86400: "NEXT_DAY", 172799: "NEXT_DAY", 172800: "LATER"}
    got = spark.createDataFrame([(s,) for s in edges], "s long").select("s", m.response_bucket(F.col("s"))).collect()
    assert dict(map(tuple, got)) == edges


def test_entry_without_subpackage_queries():
    import __spark_entry__ as entry

    assert set(q.QUERIES) <= set(entry.queries()) and set(q.ORACLES) <= set(entry.oracle_sql())


def test_vectors_go_to_their_senders_once(spark, monkeypatch):
    """The mean of a sender's vectors and their distances from it come from one exchange by sender."""
    rows = [(i, i % 4, [float(i % 3), 1.0]) for i in range(24)]
    mail = spark.createDataFrame([(i, False, f"s{s}@x") for i, s, _ in rows], "id long, is_sent boolean, from_email string")
    features = spark.createDataFrame([(i, 0.5, 0.5, False, 0.0) for i, _, _ in rows], "id long, relationship_strength double, urgency_score double, is_service boolean, service_importance double")
    actions = spark.createDataFrame([(i, "REPLIED") for i, _, _ in rows], "id long, action string")
    vectors = spark.createDataFrame([(i, v, 0) for i, _, v in rows], "id long, embedding array<float>, cluster int")
    plans, real = [], p.stored
    monkeypatch.setattr(p, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert p.priority_scores(mail, features, actions, vectors).count() == 24
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert len(re.findall(r"Exchange hashpartitioning\(from_email#\d+, \d+\)", plans[-1])) == 1
