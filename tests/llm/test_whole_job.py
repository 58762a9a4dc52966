"""Inputs beyond the sizes and shapes that the operators once took whole."""

from __future__ import annotations

import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from interlake.llm import language_id, line_dedup, minhash_dedup, mixing, packing, suffix_dedup, telephony, token_files, tokens, toxicity
from interlake.llm._text import codepoints
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def test_anchors_beyond_16_mib():
    rnd = np.random.default_rng(1)
    passage = rnd.integers(0, 256, 300).astype(np.uint8).tobytes()
    long = rnd.integers(0, 256, (1 << 24) + 5000).astype(np.uint8).tobytes()
    edge = (1 << 24) - 150
    data = long[:edge] + passage + long[edge:] + passage
    _, lo, nw, h, same = suffix_dedup.anchors([data, passage], 100)
    assert nw.sum() == len(data) - 99 + 201  # every window of both is in one snippet
    row, *_ = suffix_dedup.anchors([data, passage], 100)

    def named(doc, first):
        """Anchor of each window of the passage that starts at `first` of a document."""
        own = row == doc
        at = np.searchsorted(lo[own], np.arange(first, first + 201), "right") - 1
        return h[own][at].tolist()

    assert named(0, edge) == named(0, len(data) - 300) == named(1, 0)


def test_repeats_beyond_16_mib(spark):
    rnd = random.Random(3)
    passage = "".join(rnd.choices("abcdefghij", k=400))
    filler = bytes(np.random.default_rng(4).integers(97, 123, (1 << 24) + 70_000).astype(np.uint8)).decode()
    docs = spark.createDataFrame([(0, filler + passage), (1, "before " + passage + " after")], SCHEMA)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.drop_repeats(docs).select("doc_id", "kept").filter("doc_id = 1").collect()}
    assert got == {1: b"before  after"}


def test_suffixes_of_zero_bytes():
    for text in (b"\0\0", b"ab\0\0\0", b"\0" * 40, b"\0a\0\0a\0\0\0", bytes(random.Random(5).choices(b"\0\1", k=300)) + b"\0" * 9):
        assert suffix_dedup.suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def _equals_library(texts, **how):
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = not how.get("added", False)
    ids, offsets = tokens.encode(texts, TOKENIZER, **how)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_more_words_than_the_cache_holds(monkeypatch):
    cache = tokens.WordCache(TOKENIZER, most=50)
    monkeypatch.setattr(tokens, "word_cache", lambda path: cache)
    rnd = random.Random(6)
    _equals_library([" ".join(f"w{i}" for i in range(30))])
    _equals_library([" ".join(f"w{i}" for i in range(10, 45))])  # part is known, and the rest doesn't fit beside it
    _equals_library([" ".join(f"w{i}" for i in range(500)), "", "w1 w2", " ".join(f"x{rnd.randrange(400)}" for _ in range(900))])


def test_added_tokens_as_by_the_library():
    end = "<|endoftext|>"
    rnd = random.Random(7)
    texts = [end, f"a {end} b{end}{end}c", f"it'{end}s", f" {end} \n", "<|endoftext|", ""] + ["".join(rnd.choice([end, "a", " ", "'s", "\n", "é", "<|"]) for _ in range(12)) for _ in range(300)]
    _equals_library(texts, added=True)
    _equals_library(texts)


def test_toxicity_prefilter_misses_nothing():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "moron": 1.5}, {"bloc": 1.0, "nitwit": 1.0})
    rnd = random.Random(8)
    parts = ["idiot", "moron", "nitwit", "blocks", "kill", "you", "2", "4", "\u00b2", "'", "_", " ", ".", "\u0130", "\u00e9", "\u0301", "s"]
    texts = ["idiot2", "4moron", "nitwit'x", "nitwit\u00b2", ""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(5000)]
    assert np.array_equal(lexicon.features(texts), np.log1p(np.array([lexicon.channels(t) for t in texts])))
    assert lexicon.features(["idiot2", "4moron"]).any(1).all()
    lowered = [t.lower() for t in texts]
    cps, offsets = codepoints(lowered)
    start, end, doc = toxicity.token_spans(cps, offsets)
    joined = "".join(lowered)
    assert [(d, joined[a:b]) for a, b, d in zip(start, end, doc)] == [(i, w) for i, t in enumerate(texts) for clause in toxicity.clauses(t) for w in clause]


def test_pipeline_keeps_one_of_many_copies(spark):
    clean = "\n".join(f"line {i} of a clean text that many hold, number {i * i}" for i in range(20))
    texts = [None, "alone here"] + [clean] * 15 + ["two only", "two only", "twice\ntwice", ""] + [f"own {i}\n FOOTER \nfooter" for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    want = dict(enumerate(texts)) | {i: "" for i in range(3, 17)} | {i: f"own {i - 21}" for i in range(22, 33)}
    want[21] = "own 0\n FOOTER "
    for most in (1 << 19, 0):
        got = {r.doc_id: r for r in line_dedup.rewrite(docs, first_by="doc_id", broadcast_keys=most).collect()}
        assert {i: r.text for i, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)
    staged = corpus_pipeline.keep_one_of_near_copies(spark, corpus_pipeline.drop_common_lines(spark, docs, ""), "")
    assert [r.doc_id for r in staged.collect() if r.text == clean] == [2]


def test_suffix_dedup_by_small_shards_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "GROUP", 700)
    monkeypatch.setattr(suffix_dedup, "SEEN", 3)
    rnd = random.Random(12)
    passage = "".join(rnd.choices("abcd", k=260))
    texts = ["a" * 400, "ab" * 150, None, ""]
    for i in range(60):  # one anchor with many different contents, whole copies, and parts of the passage
        cut = rnd.randrange(1, 160)
        texts.append("".join(rnd.choices("xyz", k=rnd.randrange(120))) + passage[cut : cut + rnd.randrange(60, 200)] + "".join(rnd.choices("xyz\0", k=rnd.randrange(90))))
    texts += texts[5:25]
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[i] = (int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    got = suffix_dedup.drop_repeats(docs).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in got} == want


def test_seen_tells_only_later_places():
    rnd = np.random.default_rng(3)
    seen = suffix_dedup.Seen(4)
    first: dict[tuple, tuple] = {}
    for _ in range(40):
        h, same = rnd.integers(0, 6, 30).astype(np.uint64), rnd.integers(0, 3, 30).astype(np.uint64)
        doc, lo = rnd.integers(0, 50, 30), rnd.integers(0, 5, 30)
        got = seen.later(h, same, doc, lo)
        for key, where in zip(zip(h.tolist(), same.tolist()), zip(doc.tolist(), lo.tolist())):
            first[key] = min(first.get(key, where), where)
        for key, where, later in zip(zip(h.tolist(), same.tolist()), zip(doc.tolist(), lo.tolist()), got.tolist()):
            assert not later or where > first[key]


def _thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_of_equal_hash(monkeypatch):
    one, other = _thue_morse(2048)
    _equals_library([one, other, f"{other} {one}", "end"])
    from interlake.llm._text import shingle_sets

    a, b = shingle_sets([one, other])
    assert a.tolist() != b.tolist()
    hashes = tokens.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda *args: hashes(*args) % np.uint64(37) + np.uint64(1))  # most words share a hash
    monkeypatch.setattr(tokens, "word_cache", lambda path, cache=tokens.WordCache(TOKENIZER): cache)
    rnd = random.Random(11)
    _equals_library([" ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 3))) for _ in range(50)) for _ in range(30)])


def test_language_blocks_give_the_whole_bundle(monkeypatch):
    from interlake.llm import language_id

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc dé1\n") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    whole, letters = language_id.bundles(texts, dims=64, seed=1)
    monkeypatch.setattr(language_id, "TEXTS", 7)
    monkeypatch.setattr(language_id, "GRAMS", 5)
    parts, again = language_id.bundles(texts, dims=64, seed=1)
    assert np.allclose(whole, parts, atol=1e-6) and (letters == again).all()
    signs = language_id._letters(64, 1).astype(int)
    for t, row in zip(texts, whole):  # letter by letter: every run of other signs between letters is one gap
        symbols = [int(language_id._symbols()[ord(c)]) for c in t.lower()]
        squeezed = [s for i, s in enumerate(symbols) if s or (i and symbols[i - 1])]
        total = sum((np.roll(signs[a], 2) * np.roll(signs[b], 1) * signs[c] for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:])), np.zeros(64))
        assert np.allclose(row, total / (np.linalg.norm(total) or 1), atol=1e-5)


def test_pipeline_by_small_steps(spark, tmp_path):
    """Every stage of the pipeline against a plain version of it, on nulls, empty texts, copies, common lines and repeated sequences."""
    rnd = random.Random(21)
    words = ["".join(rnd.choice("aeioubcdfgl") for _ in range(rnd.randint(3, 8))) for _ in range(500)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [None, "", "12 34 !!", " \n "] + [said(rnd.randint(20, 400)) for _ in range(60)]
    base = said(300).split()
    for i in range(5):
        copy = list(base)
        copy[i * 7] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[10]] * 3 + [said(30) + "\nthe same footer in all of these" for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else "de", [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in known.collect()} == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    lined = {r.doc_id: r.text for r in stages["line_dedup"](spark, known, "").collect()}
    assert lined == {r.doc_id: r.text if r.doc_id < 73 else r.text.split("\n")[0] for r in known.collect()}
    kept = stages["minhash_dedup"](spark, stages["line_dedup"](spark, known, ""), "")
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in lined.items()}
    root = {i: i for i in lined}
    for a in lined:
        for b in lined:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert {r.doc_id for r in kept.collect()} == set(root.values())
    mixed = stages["source_mixing"](spark, kept, "")
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(root.values()) and max(copies.values()) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    for i, n in copies.items():
        for c in range(n):
            pieces = sorted((r for r in out if r.doc_id == i and r.copy == c), key=lambda r: r.piece)
            ids = np.concatenate([np.frombuffer(r.ids, "<u2") for r in pieces]).tolist()
            assert ids == [*plain.encode(lined[i], add_special_tokens=False).ids, 2]
    assert len({(r.doc_id, r.piece, r.copy) for r in out}) == len(out)
    filled = {}
    for r in out:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(n for _, n in places) <= 1024
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


REPEATED = "doc_id long, text string, lang string, source string, n_chars long, _reps string, _mixed_id string, _nth string, _kept_id string, _null string, tag string, doc string, row map<string,int>"


def repeated_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), "r", "m", "n", "k", "u", "t", "d", {"a": 1}) for i, t in rows], REPEATED).repartition(3)


def test_suffix_dedup_with_repeated_and_null_ids(spark):
    rnd = random.Random(12)
    said = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = said(230)
    rows = [(7, shared + said(300)), (7, said(10) + shared), (None, said(80) + shared), (None, shared), (None, None), (3, said(150)), (9, shared + said(20)), (3, ""), (7, said(10) + shared)]
    rows[-1] = rows[1]
    got = suffix_dedup.drop_repeats(repeated_docs(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    by_text = {}
    for r in got:
        by_text.setdefault((r["doc_id"], r["n_bytes"]), set()).add((r["n_removed"], bytes(r["kept"])))
    assert all(len(x) == 1 for x in by_text.values())  # equal rows, equal results
    # Of all documents that hold the passage, one keeps it: a null id comes first, and of two of them that of the smaller hash.
    whole = [r for r in got if shared.encode() in bytes(r["kept"])]
    assert len(whole) == 1 and whole[0]["doc_id"] is None
    named = spark.createDataFrame([("b", shared), ("a", shared + "x"), (None, "short")], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.drop_repeats(named).collect()} == {"a": 0, "b": 230, None: 0}


def test_lines_count_documents_not_rows(spark):
    rows = [(1, "only once\nx")] * 12 + [(i, f"ten\nown {i}") for i in range(2, 12)] + [(None, "null line")] * 10
    got = line_dedup.drop_lines(repeated_docs(spark, rows), min_docs=10, filter_bits=12).collect()
    assert {(r["doc_id"], r["n_dropped"]) for r in got} == {(1, 0), (None, 1), *((i, 1) for i in range(2, 12))}
    first = line_dedup.rewrite(repeated_docs(spark, rows), min_docs=10, filter_bits=12, first_by="doc_id")
    assert first.columns == repeated_docs(spark, rows).columns
    assert {r["doc_id"]: r["text"] for r in first.collect() if r["doc_id"] is not None} == {1: "only once\nx", 2: "ten\nown 2", **{i: f"own {i}" for i in range(3, 12)}}
    kept = line_dedup.rewrite(repeated_docs(spark, rows), min_docs=10, filter_bits=12).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, "only once\nx")] * 12 + [(i, f"own {i}") for i in range(2, 12)] + [(0, "")] * 10)


def test_repeated_rows_leave_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long)] * 4 + [(8, long + " more"), (6, "another text"), (6, "of the same id"), (None, long), (None, "no id"), (None, "no id"), (None, None)]
    kept = minhash_dedup.keep_representatives(repeated_docs(spark, rows))
    assert kept.columns == repeated_docs(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, long), (6, "another text"), (6, "of the same id"), (None, "no id"), (None, None)], key=str)
    classes = minhash_dedup.near_duplicates(repeated_docs(spark, rows)).collect()
    assert len(classes) == len(rows) and {r["class_id"] for r in classes if r["doc_id"] in (5, 8)} == {5}
    named = spark.createDataFrame([("b", long), ("a", long + " x"), ("c", "alone")], "doc_id string, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(named).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, f"some words {i}") for i in range(20)]
    mixed = mixing.repeat_mixed(repeated_docs(spark, rows))
    assert mixed.columns == repeated_docs(spark, rows).columns and mixed.count() == 20


def test_repeated_null_and_long_documents_everywhere(spark, tmp_path):
    """Ids that repeat or are null, repeated rows and a text above 1 MiB: every row comes out, equal texts with equal results."""
    rnd = random.Random(31)
    words = ["water", "school", "the", "nitwit", "of", "Haus", "l'eau", "día"]
    long = " ".join(rnd.choice(words) for _ in range(250_000))
    assert len(long) > 1 << 20
    rows = [(None, "the school"), (None, None), (5, "the same water"), (5, "the same water"), (5, "another of them"), (6, long), (None, "the school"), (7, ""), (5, None)]
    docs = repeated_docs(spark, rows)
    want = sorted(map(str, (i for i, _ in rows)))
    named = lambda got: sorted(str(r["doc_id"]) for r in got)

    model = language_id.train(docs, learn=F.lit(True))
    got = language_id.predict(docs, model).collect()
    assert named(got) == want and len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 5}) <= 3

    plain = Tokenizer.from_file(TOKENIZER)
    sizes = [len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    pieces = packing.pack(packing.tokenized_pieces(docs, tokenizer=TOKENIZER), n_rows=20, capacity=1024).collect()
    assert sum(r["length"] for r in pieces) == sum(sizes) and len(pieces) == sum(-(-n // 1024) for n in sizes)
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in sorted(x)[:k]) == sorted(x)[k][0] for x in held.values() for k in range(len(x)))

    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert named(scored) == want and all(0 <= r["score"] <= 1 for r in scored)

    media = telephony.decode_media(telephony.store_payloads(docs).select(F.struct("doc_id", "n_bytes").alias("row"), "media"), key="row", digests=True).collect()
    padded = [(t or "").encode() for _, t in rows]
    padded = [b + b"\xff" * (-len(b) % 576 if b else 576) for b in padded]
    assert sorted(r["payload_sha256"] for r in media) == sorted(hashlib.sha256(b).hexdigest() for b in padded)
    assert sorted(r["tail_crc32"] for r in media) == sorted(zlib.crc32(b[-32:]) for b in padded)
    by_payload = {}
    for r in media:
        by_payload.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["media_bytes"], r["feature"], r["tail_crc32"]))
    assert all(len(x) == 1 for x in by_payload.values())

    folder = str(tmp_path / "tokens")
    manifest = token_files.write_tokens(docs, folder, tokenizer=TOKENIZER, partitions=3)
    files = spark.createDataFrame(manifest.collect(), manifest.schema)
    read = sorted(token_files.read_tokens(spark, folder, files, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in read] == sorted(-(1 << 63) if i is None else i for i, _ in rows)
    assert sum(r["n_tokens"] for r in read) == sum(sizes) and all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 2 for r in read)
    assert [r["start"] for r in read] == [sum(r["n_tokens"] for r in read[:k]) for k in range(len(read))]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in read)
