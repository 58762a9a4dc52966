"""Whitening, sharding and the filter audit against brute force, with nulls, ties, repeats, long texts, empty tables and clashing columns."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from interlake.llm import filter_audit, sharding, whitening
from interlake.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, x string, n long, whitened string"
DOCS = "doc_id long, text string, lang string, size string, row string, part string, shard int, slot int, key string, mask string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, "w") for i, v in rows], VECTORS).repartition(3)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "r", "p", 1, 2, "k", "m") for i, t, lang in rows], DOCS).repartition(3)


def whitened_by_numpy(matrix, k):
    """x, distinct x, deviations, and by component the whitened values of every row and the shares."""
    x = np.floor(64 * matrix).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centre = (n * fit - sums) / n
    values, vectors_ = np.linalg.eigh(centre.T @ centre / n)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), ((n * x - sums) / n) @ vectors_ / np.sqrt(values), values / np.square(centre).sum() * n


@pytest.mark.parametrize("spectrum", ["flat", "steep"])
def test_whitening_equals_eigenvectors(spark, spectrum):
    rng = np.random.default_rng(3)
    dims = 24
    scales = np.ones(dims) if spectrum == "flat" else 4.0 ** -np.arange(dims) * 400
    matrix = (rng.standard_normal((400, dims)) * scales) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0] + (0.5 if spectrum == "flat" else 40)
    rows = [(i, v) for i, v in enumerate(matrix.tolist())]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(None, rows[0][1]), (7, rows[1][1])]  # repeats, a null id, an id twice
    k = 5 if spectrum == "flat" else 3
    model = whitening.fit(whitening.quantised(vectors(spark, rows), vector="embedding"), k=k, oversample=4, passes=8)
    assert model.complete == (spectrum == "flat") and model.residual <= 1e-12 * model.eigenvalues[0] and model.identity_error < 1e-9
    bad = [(2000, None), (2001, []), (2002, [float("nan")] * dims), (2003, [float("inf")] + [0.0] * (dims - 1)), (2004, [None] + [0.0] * (dims - 1)), (2005, [1.0, 2.0]), (2006, [1e300] * dims)]
    got = whitening.fit_and_apply(vectors(spark, rows + bad), k=k, oversample=4, passes=8).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    n, deviation, white, share = whitened_by_numpy(np.array([v for _, v in rows]), k)
    place = {i: p for p, (i, _) in enumerate(rows) if i not in (None, 7)}
    own = {r["vec_id"]: r for r in got if r["vec_id"] in place}
    assert all((r["n"], r["deviation"]) == (n, deviation[place[i]]) for i, r in own.items())
    found = np.array([own[i]["whitened"] for i in place])
    want = white[[place[i] for i in place]]
    sign = np.sign((found * want).sum(0))
    assert np.abs(found * sign - want).max() < 1e-7
    assert np.abs(np.array(got[0]["explained"]) / share - 1).max() < 1e-9 and got[0]["identity_error"] < 1e-9
    flat = whitening.by_component(whitening.fit_and_apply(vectors(spark, rows), k=k)).collect()
    assert len(flat) == k * len(rows) and {r["component"] for r in flat} == set(range(1, k + 1))


def test_whitening_of_few_and_equal_rows(spark):
    assert whitening.fit_and_apply(vectors(spark, [(1, None)])).collect() == []
    assert whitening.by_component(whitening.fit_and_apply(vectors(spark, []))).collect() == []
    alike = whitening.fit_and_apply(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).collect()
    assert [(r["n"], r["deviation"], list(r["whitened"])) for r in alike] == [(1, 0, [])] * 2
    line = whitening.fit_and_apply(vectors(spark, [(i, [i, 2 * i, 0]) for i in range(9)])).collect()
    assert all(len(r["whitened"]) == 1 and abs(r["explained"][0] - 1) < 1e-12 for r in line)  # rank 1
    far = whitening.fit_and_apply(vectors(spark, [(i, [float(i << 45), 0.0]) for i in range(3)])).collect()
    assert {r["vec_id"]: r["deviation"] for r in far} == {0: None, 1: 0, 2: None}  # beyond a long


def test_whitening_query_sums_are_whole(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    by_vector = {}
    for r in rows:
        by_vector.setdefault(r["vec_id"], []).append(r)
    stored = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    n, deviation, white, share = whitened_by_numpy(np.array([r["embedding"] for r in stored], np.float64), 16)
    assert len(rows) == 16 * len(stored)
    for i, r in enumerate(stored):
        own = sorted(by_vector[r["vec_id"]], key=lambda x: x["component"])
        assert (own[0]["n"], own[0]["deviation"]) == (n, deviation[i])
        assert np.abs(np.abs([x["whitened"] for x in own]) - np.abs(white[i])).max() < 1e-7


def sharded_plainly(rows, shards):
    order = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t, _ in order]
    out, slots, before = [], {}, 0
    for (i, t, _), size in zip(order, sizes):
        shard = min(shards - 1, (2 * before + size) * shards // (2 * sum(sizes)))
        out.append((i, size, zlib.crc32((t or "").encode()), shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def test_shards_equal_plain_prefix_sums(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.randrange(60) if i % 5 else None, [None, "", "ü" * rnd.randrange(40), "copy " * 20, "a" * rnd.randrange(300)][i % 5 if i % 7 else 3], "en") for i in range(400)]
    rows += [(61, "z" * 1_500_000, "en")] + [(5, "the same", "de")] * 150
    for shards, partitions in ((16, 5), (3, None), (1, 2)):
        got = sharding.assign(documents(spark, rows), shards=shards, partitions=partitions).collect()
        key = lambda r: tuple((x is not None, x or 0) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(sharded_plainly(rows, shards), key=key)
    even = [(i, "b" * rnd.randrange(500), "en") for i in range(800)]
    sums = {}
    for r in sharding.assign(documents(spark, even), shards=16).collect():
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 2 * 500
    assert sharding.assign(documents(spark, [])).collect() == []
    sharding.write_shards(documents(spark, even), str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*documents(spark, even).columns, "_shard"} and back.count() == 800
    where = {r["doc_id"]: r["shard"] for r in sharding.assign(documents(spark, even), shards=4).collect()}
    assert all(where[r["doc_id"]] == r["_shard"] for r in back.collect())
    with pytest.raises(ValueError, match="_shard"):
        sharding.write_shards(back, str(tmp_path / "again"))


def test_shards_stay_in_the_jvm(spark):
    plan = QUERIES["op12_prefix_sum_shards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def failed_plainly(rows):
    out = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((i, lang or "", "".join(c for c, yes in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), copy)) if yes)))
    return out


def audited_plainly(failed, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(i, f) for i, p, f in failed if p == part]
        gone_of = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                gone_of[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == letter for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(gone_of[order[step - 1]])
    return out


def test_audit_equals_every_order_by_hand(spark):
    rnd = random.Random(8)
    said = lambda n, kinds: " ".join(f"w{rnd.randrange(kinds)}" for _ in range(n))
    rows = [(i, [said(120, 10**6), said(30, 10**6), said(150, 20), said(120, 10**6).upper(), said(110, 10**6) + " 50%", None, "", "\x85 \x1c x"][i % 8], [None, "", "en", "de", "fr"][i % 5]) for i in range(90)]
    rows += [(100 + i, rows[i % 3][1], "en") for i in range(25)] + [(3, rows[0][1], "de"), (3, rows[0][1], "de"), (None, rows[1][1], None), (None, None, "en")]
    labels = [(i, i % 2, None if i % 3 else 1) for i in range(120)] + [(0, 1, 1), (None, 1, 1), (5, None, None)]
    failed = failed_plainly(rows)
    masks = filter_audit.failures(documents(spark, rows))
    named = [(r["doc_id"], r["part"], "".join(c for k, c in enumerate("ABCDE") if r["mask"] >> k & 1)) for r in masks.collect()]
    assert sorted(named, key=str) == sorted(failed, key=str)
    said_of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit(filter_audit.with_labels(masks, said_of)).collect()}
    assert got == audited_plainly(failed, labels)
    assert len(got) == 600 * len({p for _, p, _ in failed})
    none = filter_audit.with_labels(filter_audit.failures(documents(spark, [])), said_of)
    assert filter_audit.audit(none).collect() == []


def test_copies_meet_with_and_without_broadcast(spark, monkeypatch):
    rows = [(i, f"text {i % 7}" if i % 3 else f"own {i}", "en") for i in range(120)]
    want = sorted(map(str, failed_plainly(rows)))
    for hot in (10**9, 1):  # all groups by broadcast, none
        monkeypatch.setattr(filter_audit, "HOT", hot)
        got = [(r["doc_id"], r["part"], "".join(c for k, c in enumerate("ABCDE") if r["mask"] >> k & 1)) for r in filter_audit.failures(documents(spark, rows)).collect()]
        assert sorted(map(str, got)) == want


def test_long_texts_are_split_in_chunks(monkeypatch):
    rnd = random.Random(1)
    data = "".join(rnd.choice("ab\t \n\x0bé\x85") for _ in range(5000)).encode() + b"x" * 3000 + b" end"
    want = (len(data.split()), len(set(data.split())))
    for chunk in (1, 7, 100, 4096):
        monkeypatch.setattr(filter_audit, "CHUNK", chunk)
        assert filter_audit.word_counts(data) == want
    monkeypatch.undo()
    assert filter_audit.word_counts(b"word other " * 300_000) == (600_000, 2)


def test_zeta_sums_over_subsets():
    counts = np.random.default_rng(2).integers(0, 9, 16)
    assert filter_audit.zeta(counts).tolist() == [sum(int(counts[t]) for t in range(16) if t & s == t) for s in range(16)]
    assert filter_audit.survivors(counts).tolist() == [sum(int(counts[t]) for t in range(16) if t & s == 0) for s in range(16)]


@pytest.mark.parametrize("name", ["op12_prefix_sum_shards", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
