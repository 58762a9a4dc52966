"""The memory with a time to live against a plain one, as a table and as a stream."""

from __future__ import annotations

import base64
import datetime as dt
import json
import random

import pytest
from interlake.streaming import ttl
from interlake.streaming.notifications import notifications
from pyspark.sql import functions as F

START = dt.datetime(2026, 1, 5, tzinfo=dt.timezone.utc)


def plain(rows, seconds, most=None):
    """rows: (account, key, micros); those that pass a dictionary of keys and times."""
    out, known = [], {}
    for account, key, us in sorted(set(rows), key=lambda r: (r[2], r[1])):
        own = known.setdefault(account, {})
        for k in [k for k, v in own.items() if us - v > seconds * 1_000_000]:
            del own[k]
        if key in own:
            continue
        while most and len(own) >= most:
            del own[min(own, key=own.get)]
        own[key] = us
        out.append((account, key, us))
    return sorted(out)


def table(spark, rows):
    made = spark.createDataFrame([(a, k, us, "x", "y") for a, k, us in rows], "email string, history_id string, us long, row string, slice string")
    return made.withColumn("at", F.timestamp_micros("us")).repartition(5)


def random_rows(n, accounts, keys, seconds, seed):
    rnd = random.Random(seed)
    base = int(START.timestamp()) * 1_000_000
    return [(f"a{rnd.randrange(accounts)}", f"h{rnd.randrange(keys)}", base + rnd.randrange(seconds) * 1_000_000 + rnd.choice([0, rnd.randrange(1_000_000)])) for _ in range(n)]


@pytest.mark.parametrize(("n", "accounts", "keys", "seconds", "live"), [(3000, 1, 1, 4000, 7), (3000, 5, 3, 90_000, 300), (400, 20, 30, 500, 10_000), (2000, 2, 2, 5000, 0.5)])
def test_table_equals_a_plain_memory(spark, n, accounts, keys, seconds, live):
    rows = random_rows(n, accounts, keys, seconds, n + keys)
    rows += rows[:50] + [(a, k, us + round(live * 1_000_000)) for a, k, us in rows[:60]] + [(a, k, us + round(live * 1_000_000) + 1) for a, k, us in rows[:60]]  # repeats, both sides of the edge
    got = ttl.let_through(table(spark, rows), ["email", "history_id"], "at", ttl=live)
    assert got.columns == table(spark, rows).columns
    found = sorted((r.email, r.history_id, r.us) for r in got.collect())
    assert found == plain(rows, live) and len(found) < len(set(rows))


def test_nulls_empty_and_times_before_1970(spark):
    assert ttl.let_through(table(spark, []), ["email"], "at", ttl=5).collect() == []
    rows = [("a", "h", -10_000_000), ("a", "h", -6_000_000), ("a", "h", -1), ("a", None, 5), (None, "h", 5), ("a", "h", None), ("a", "", 5)]
    got = ttl.let_through(table(spark, rows), ["email", "history_id"], "at", ttl=5).collect()
    assert sorted((r.history_id, r.us) for r in got) == [("", 5), ("h", -10_000_000), ("h", -1)]
    with pytest.raises(ValueError, match="positive"):
        ttl.let_through(table(spark, []), ["email"], "at", ttl=0)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_limited_memory_forgets_the_oldest(spark, most):
    rows = random_rows(2500, 3, 12, 3000, most)
    got = ttl.let_through_limited(table(spark, rows), ["email"], ["email", "history_id"], "at", ttl=60, most=most)
    assert sorted((r.email, r.history_id, round(r.at.timestamp() * 1_000_000)) for r in got.collect()) == plain(rows, 60, most)


def pushed(rows):
    return [(base64.b64encode(json.dumps({"emailAddress": a, "historyId": h}).encode()).decode(), dt.datetime.fromtimestamp(us / 1_000_000, dt.timezone.utc)) for a, h, us in rows]


@pytest.mark.parametrize("most", [None, 2])
def test_stream_equals_table_on_shuffled_micro_batches(spark, tmp_path, most):
    rnd = random.Random(3)
    rows = [(a, k, us // 1000 * 1000) for a, k, us in random_rows(600, 2, 4, 3000, 9)]
    late = sorted(rows, key=lambda r: r[2] + rnd.randrange(100) * 1_000_000)  # arrives up to 100 s late
    end = max(r[2] for r in rows) + 10_000 * 1_000_000
    batches = [late[i : i + 100] for i in range(0, 600, 100)] + [[("end", "e", end)], [("end", "f", end + 1000)]]
    schema, out = "data string, received_at timestamp", []
    for i, batch in enumerate(batches):
        rnd.shuffle(batch)
        spark.createDataFrame(pushed(batch), schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        if i in (2, 7):  # a break: the second run goes on from the first one's state
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
            kept = notifications(stream, ttl=60, most=most, delay="120 seconds", in_order=True)
            query = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert query.awaitTermination(200)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    out = sorted((r.email, r.history_id, round(r.received_at.timestamp() * 1_000_000)) for r in found if r.email != "end")
    assert out == plain(rows, 60, most)
    again = notifications(spark.createDataFrame(pushed(rows), schema), ttl=60, most=most).collect()
    assert sorted((r.email, r.history_id, round(r.received_at.timestamp() * 1_000_000)) for r in again) == out
