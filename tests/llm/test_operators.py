"""The training-data operators against brute force on small tables, with nulls, ties, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from interlake.llm import embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, packing, suffix_dedup, telephony, token_files, toxicity
from interlake.llm.components import connected_components
from interlake.llm.tokens import encode
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, n long, row string"


def table(spark, texts, **more):
    rows = [(i, t, "en" if i % 2 else "de", [None, "a", "b"][i % 3], len(t or ""), "x", 1, 2, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = said(60)
    out = [None, "", " \n ", "\n\n", "!!!", "ü" * 300, "a" * 500, said(4000)]
    for i in range(60):
        out.append(said(rnd.randint(1, 120)) + ("\n" + shared if i % 4 == 0 else "") + ("\nFooter LINE \t" if i % 2 else "\n footer line"))
    base = said(200).split()
    for i in range(12):
        copy = list(base)
        for _ in range(i):
            copy[rnd.randrange(len(copy))] = "changed"
        out.append(" ".join(copy))
    return [*out, out[-1], out[20], out[20]]


def test_tokens_match_the_library():
    rnd = random.Random(1)
    alphabet = list("ab'stvrelmd  \n\t,.'1²½Ⅷé中 　\x1c\x85\U0001f600_-")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", "don't'll", "<|endoftext|>"]
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    ids, offsets = encode(texts, TOKENIZER)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_line_dedup(spark, texts):
    docs = table(spark, texts)
    count = Counter(k for t in texts for k in {x.strip(line_dedup.BLANKS).lower() for x in (t or "").encode().split(b"\n")} if k)
    want = {}
    for i, t in enumerate(texts):
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if count[x.strip(line_dedup.BLANKS).lower()] < 10]
        want[i] = (len(lines), len(lines) - len(kept), b"\n".join(kept).decode())
    for most in (1 << 19, 0):
        got = line_dedup.drop_lines(docs, broadcast_keys=most, filter_bits=12).collect()
        assert {r[0]: (r[1], r[2], r[3]) for r in got} == want
    again = {r["doc_id"]: r for r in line_dedup.rewrite(docs).collect()}
    assert again[0]["text"] is None and again[20]["text"] == want[20][2] and again[20]["n_chars"] == len(want[20][2])
    seen, first = set(), {}
    for i, t in enumerate(texts):
        kept = []
        for x in (t or "").encode().split(b"\n"):
            k = x.strip(line_dedup.BLANKS).lower()
            if not k or k not in seen:
                kept.append(x)
            seen.add(k)
        first[i] = b"\n".join(kept).decode()
    assert {r["doc_id"]: r["kept"] for r in line_dedup.keep_first(docs, filter_bits=12).collect()} == first


def test_suffix_dedup(spark, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[i] = (len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    got = suffix_dedup.drop_repeats(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got} == want


def test_suffix_array_and_common_prefixes():
    for text in (b"banana", b"a" * 50, bytes(random.Random(2).choices(b"ab", k=400))):
        order = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        # Windows of two snippets; each one's common prefix with the window before it, 9 bytes at most.
        starts, counts = np.array([0, len(text) // 2]), np.array([len(text) // 3, len(text) // 3])
        windows = {s + k for s, c in zip(starts.tolist(), counts.tolist()) for k in range(c)}
        own = np.array([i for i in order.tolist() if i in windows])
        got = suffix_dedup.common_prefixes(np.frombuffer(text, np.uint8), own, starts, counts, 9)
        for before, i in zip([None, *own.tolist()], own.tolist()):
            common = 0
            while before is not None and common < 9 and max(i, before) + common < len(text) and text[i + common] == text[before + common]:
                common += 1
            assert got[i] == common
        assert all(got[i] == -1 for i in range(len(text)) if i not in windows)


def test_near_duplicates(spark, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert all(got[i]["kept"] == (root[i] == i) for i in got)
    kept = minhash_dedup.keep_representatives(table(spark, texts))
    assert kept.columns == table(spark, texts).columns and kept.count() == len(set(root))


def test_dart_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(3)
    elements = rnd.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rnd.integers(1, 6, 300).astype(float), rnd.integers(1, 6, 300).astype(float)
    got = minhash_dedup.signatures([elements, elements], 2000, [a, b])
    assert abs((got[0] == got[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    half = minhash_dedup.signatures([elements[:200], elements[100:]], 2000)
    assert abs((half[0] == half[1]).mean() - 1 / 3) < 0.05


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (7, 7)]
    root = {x: x for e in edges for x in e if None not in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: v for k, v in root.items() if k in linked}


def test_embedding_links(spark):
    rnd = np.random.default_rng(6)
    centres = rnd.standard_normal((30, 16))
    vectors = [(c + 0.12 * rnd.standard_normal(16)).astype(np.float32).tolist() for c in centres for _ in range(12)]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [float("nan")] * 16, [None] * 16, [1.0] * 8]
    labels = [None if i % 17 == 0 else i % 2 for i in range(len(vectors))]
    rows = [(i, v, lab, 5, "k") for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))]
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, rep string")).collect()}
    usable = [v is not None and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v)) for v in vectors]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and labels[i] is not None and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if r == hi else r for r in root]
    found = sum(got[i]["n_links"] for i in got)
    assert found <= sum(links) and found >= 0.97 * sum(links)
    assert [got[i]["component_id"] for i in range(len(rows))] == root


def test_rotation_estimate_is_unbiased():
    rnd = np.random.default_rng(8)
    x, q = rnd.standard_normal((2, 400, 64))
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, q))
    signs, factor = embedding_dedup.encode(x)
    got, width = embedding_dedup.estimate(q @ embedding_dedup.rotation(64, 1), signs, factor, 4.0)
    error = got - q @ x.T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= width).mean() > 0.999


def test_packing(spark, texts):
    docs = table(spark, texts)
    rows = packing.pack(packing.tokenized_pieces(docs, tokenizer=TOKENIZER, most=64), n_rows=len(texts), capacity=64, shard=40).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for r in pieces:
            part = np.array(want[i][at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and (r["length"] == 64 or r["piece"] == 0)
            at += r["length"]
        assert at == len(want[i])
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == np.cumsum([0, *[r["length"] for r in held[:-1]]]).tolist() and sum(r["length"] for r in held) <= 64


def test_packing_takes_the_least_sum_of_squares():
    for seed, capacity, least in ((1, 12, 1), (2, 40, 5), (3, 100, 1), (4, 7, 7)):
        rnd = random.Random(seed)
        lengths = [rnd.randint(least, capacity) if rnd.random() < 0.7 else capacity // 3 + 1 for _ in range(300)]
        gaps, want = [], {}  # of each bin its gap
        stack = {g: [] for g in range(capacity + 1)}  # bins by gap, the last to come first
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            s = lengths[i]

            def total(g, s=s):
                """The sum of squared counts of open bins by gap, once this piece is in a bin of gap g."""
                after = [*gaps]
                after[after.index(g)] = g - s
                return sum(n * n for left, n in Counter(after).items() if left)

            able = sorted({g for g in gaps if g >= s})
            if able:
                gap = min(able, key=lambda g: (total(g), g))
                b = stack[gap].pop()
            else:
                gap, b = capacity, len(gaps)
                gaps.append(capacity)
            want[i] = (b, capacity - gap)
            gaps[b] = gap - s
            if gap > s:
                stack[gap - s].append(b)
        which, offset = packing.sum_of_squares(np.array(lengths), capacity)
        assert [(int(b), int(o)) for b, o in zip(which, offset)] == [want[i] for i in range(len(lengths))]


def test_token_files(spark, texts):
    got = {r["doc_id"]: r for r in token_files.round_trip(table(spark, texts), tokenizer=TOKENIZER, partitions=3).collect()}
    plain, start = Tokenizer.from_file(TOKENIZER), 0
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_damage_shows(tmp_path):
    path = tmp_path / "a.zst"
    with path.open("wb") as f:
        w = token_files.Writer(f, frame_bytes=64)
        for i in range(10):
            w.add(i, np.arange(i * 20, dtype=np.uint32))
        w.close()
    with path.open("rb") as f:
        r = token_files.Reader(f, path.stat().st_size)
        assert [r.ids(i).tolist() for i in range(10)] == [list(range(i * 20)) for i in range(10)]
        r.sums = r.sums ^ 1
        r.last = (-1, b"")
        with pytest.raises(ValueError, match="checksum"):
            r.ids(5)


def test_mixing(spark, texts):
    docs = table(spark, [("word " * (i % 9)) if i % 5 else t for i, t in enumerate(texts)])
    rows = mixing.mix(docs).collect()
    assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    for s in (None, "a", "b"):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert mixing.repeat_mixed(docs).count() == sum(r["reps"] for r in rows)


def test_water_fill_clamps(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 1000, 2), ("c", 5, 3)], "source string, source_size long, weight int")
    got = {r["source"]: r["target"] for r in mixing.water_fill(sources).collect()}
    assert got["a"] == 30 and got["c"] == 15 and got["b"] == pytest.approx(970)


def test_language(spark):
    rnd = random.Random(7)
    made = {"de": "der die und nicht schule wasser ung heit".split(), "en": "the and of with water school tion ing".split()}
    texts = [" ".join(rnd.choice(made["en" if i % 2 else "de"]) for _ in range(20)) for i in range(80)] + [None, "", "123 !!"]
    docs = table(spark, texts)
    model = language_id.train(docs.filter("doc_id < 80"), learn=~language_id.held_out(F.col("doc_id"), 4, 2))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (80, 81, 82))
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == 80


def test_toxicity(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("lmnoprst") for _ in range(5)) for _ in range(200)]
    texts = []
    for i in range(200):
        w = [rnd.choice(words) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                w[rnd.randrange(40)] = rnd.choice(["blockhead", "nitwit"])
        texts.append(" ".join(w))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(201, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, learn=F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(200)) and got[200] == got[201] == 0


def test_lexicon_equals_counts_by_hand(spark):
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5))) for _ in range(60)]
    texts = []
    for i in range(160):
        w = [rnd.choice(words) for _ in range(25)]
        if i % 3 == 0:
            w[rnd.randrange(25)] = rnd.choice(["dumbos", "dumboes", "dumbox", "dumbony", "dumb"])
        texts.append((" ".join(w).title() if i % 2 else ", ".join(w), int(i % 3 == 0)))
    texts += [texts[0]] * 4 + [("", 1), ("", 0)]
    limits = {"support": 4, "odds": 0.5, "surprise": 1.0}
    got = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, toxic int"), **limits)
    held, follow = {0: Counter(), 1: Counter()}, {}
    for text, toxic in texts:
        w = re.split(r"[^a-z]+", text.lower())
        held[toxic].update(x for x in set(w) if len(x) > 2)
        if toxic:
            for a, b in zip(w, [*w[1:], ""]):
                follow.setdefault(a, set()).add(b)
    t = {w: min(held[1][w], len(follow.get(w, ()))) for w in {*held[0], *held[1]}}
    c = {w: held[0][w] for w in t}
    share = sum(t.values()) / (sum(t.values()) + sum(c.values()))

    def strong(t, c, least):
        odd = np.log((t + 0.5) / (c + 0.5)) - np.log(share / (1 - share))
        ratio = 2 * ((t * np.log(t / ((t + c) * share)) if t else 0) + (c * np.log(c / ((t + c) * (1 - share))) if c else 0))
        return odd if t >= least and odd >= limits["odds"] and ratio >= limits["surprise"] else None

    want = {w: strong(t[w], c[w], limits["support"]) for w in t}
    roots = {}
    for w in t:
        for n in toxicity.ROOTS:
            if len(w) > n:
                roots.setdefault(w[:n], []).append(w)
    rooted = {r: strong(sum(t[w] for w in ws), sum(c[w] for w in ws), 2 * limits["support"]) for r, ws in roots.items() if sum(t[w] > 0 for w in ws) >= 4}
    assert got.words == pytest.approx({w: o for w, o in want.items() if o is not None}) and len(got.words) > 2
    assert got.roots == pytest.approx({r: o for r, o in rooted.items() if o is not None}) and "dumb" in got.roots


def test_inflected_threats():
    lexicon = toxicity.Lexicon({}, {})
    at = dict(zip(toxicity.CHANNELS, range(8)))
    for said in ("he is killing them", "they destroyed you", "er tötet dich", "wir vernichteten sie", "il te brûlera", "te mataré", "destruyeron y destruyen", "ils frappaient, ils frappent"):
        assert lexicon.channels(said)[4:].sum() >= 1, said
    assert lexicon.channels("nobody will ever be killed by you")[at["threat_targeted"]] == 1
    assert lexicon.channels("tu es là")[4:].sum() == 0  # a pronoun, no verb
    assert lexicon.candidates(["they destroyed it", "nothing here"]).tolist() == [True, False]


def test_toxicity_grammar_channels():
    lexicon = toxicity.Lexicon({"nitwit": 2.0}, {"bloc": 1.0})
    at = dict(zip(toxicity.CHANNELS, range(8)))
    assert lexicon.channels("a nitwit here")[at["insult"]] == 2
    assert lexicon.channels("you are a nitwit")[at["insult_targeted"]] == 2
    assert lexicon.channels("this is not a nitwit. blockhead")[at["insult_negated"]] == 2
    assert lexicon.channels("she wrote that nitwit")[at["insult_reported"]] == 2
    assert lexicon.channels("i will kill you")[at["threat_targeted"]] == 1


def test_telephony(spark, texts):
    got = {r["row"]["doc_id"]: r for r in telephony.decode_media(telephony.store_payloads(table(spark, texts)).select(F.struct("doc_id", "n_bytes").alias("row"), "media"), key="row", digests=True).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        b += b"\xff" * (576 - len(b) % 576 if len(b) % 576 or not b else 0)
        assert got[i]["payload_sha256"] == hashlib.sha256(b).hexdigest() and got[i]["payload_bytes"] == len(b)
    assert telephony.mu_law_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.a_law_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def _slow_adpcm(block):
    steps, change = telephony.ADPCM_STEPS, telephony.INDEX_CHANGE
    now, at = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            d = (steps[at] >> 3) + (steps[at] if n & 4 else 0) + (steps[at] >> 1 if n & 2 else 0) + (steps[at] >> 2 if n & 1 else 0)
            now = max(-32768, min(32767, now - d if n & 8 else now + d))
            at = max(0, min(88, at + change[n & 7]))
            out.append(now)
    return out


def test_adpcm_against_one_step_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (20, 36)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [_slow_adpcm(b.tobytes()) for b in blocks]


def test_empty_tables(spark):
    docs = table(spark, ["x"]).limit(0)
    assert line_dedup.drop_lines(docs).count() == 0
    assert suffix_dedup.drop_repeats(docs).count() == 0
    assert minhash_dedup.near_duplicates(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert packing.pack(packing.tokenized_pieces(docs, tokenizer=TOKENIZER), n_rows=0).count() == 0
    assert token_files.round_trip(docs, tokenizer=TOKENIZER).count() == 0
    assert language_id.predict(docs, language_id.train(docs)).count() == 0
    assert telephony.decode_media(telephony.store_payloads(docs), digests=True).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _brute_links(vectors, labels, threshold=0.93):
    """(links of each row, root of each row), by plain cosines."""
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (new == root).all():
            return near.sum(1), root
        root = new


def test_embedding_links_by_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rnd = np.random.default_rng(16)
    centres = rnd.standard_normal((120, 24))
    vectors = [(c + 0.13 * rnd.standard_normal(24)).tolist() for c in centres for _ in range(5)]
    vectors += [(centres[0] + 0.05 * rnd.standard_normal(24)).tolist() for _ in range(200)]  # a dense cluster that fills its buckets
    labels = [i % 3 // 2 for i in range(len(vectors))]
    order = rnd.permutation(len(vectors))
    rows = [(int(i), vectors[i], labels[i]) for i in order]
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, root = _brute_links(vectors, labels)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum()
    assert np.mean([got[i].component_id == root[i] for i in range(len(vectors))]) > 0.99


def test_doubles_are_not_rounded(spark):
    """A pair whose cosine is below the threshold by less than single precision tells."""
    c = 0.93 - 3e-9
    rows = [(0, [1.0, 0.0], 1), (1, [c, (1 - c * c) ** 0.5], 1), (2, [1e-200, 0.0], 1), (3, [1e200, 0.0], 1)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: 2, 1: 0, 2: 2, 3: 2}


def test_bit_estimate_holds_its_bound():
    rnd = np.random.default_rng(9)
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rnd.standard_normal((2, 300, 100)))
    signs, factor = embedding_dedup.encode(x)
    codes = embedding_dedup.pack_signs(signs)
    got, width = embedding_dedup.Query(q @ embedding_dedup.rotation(100, 1)).estimate(slice(0, 300), codes, np.bitwise_count(codes).sum(1, dtype=np.int64), factor, 4.0)
    error = got - q @ x.T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= width).mean() > 0.999


def test_stored_steps_and_rows_with_partners():
    rnd = np.random.default_rng(19)
    centres = rnd.standard_normal((40, 70))
    x = np.concatenate([centres, centres[:15] + 0.1 * rnd.standard_normal((15, 70))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = embedding_dedup.Query(x @ embedding_dedup.rotation(70, 1))
    back = embedding_dedup.Query.read(made.stored(), 70)
    assert all((a == b).all() for a, b in zip([*made.planes, made.least, made.step, made.total], [*back.planes, back.least, back.step, back.total]))
    signs, factor = embedding_dedup.encode(x)
    codes = embedding_dedup.pack_signs(signs)
    close = x @ x.T >= 0.93
    np.fill_diagonal(close, False)
    alone = embedding_dedup._near(back, codes, factor, (np.arange(55), None), 0.93, 4.0)
    assert close.any(1).sum() == 30 and alone[close.any(1)].all() and alone.sum() < 45  # none missed, most others ruled out
    two = embedding_dedup._near(back, codes, factor, (np.arange(40), np.arange(40, 55)), 0.93, 4.0)
    assert two[close.any(1)].all() and not two[15:40].all()


def test_strays_of_a_full_bucket(spark, monkeypatch):
    """Members of a bucket in other components than the largest meet all of it, block by block."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rnd = np.random.default_rng(5)
    base = rnd.integers(1, 1 << 62, 60).astype(np.uint64)
    sets = [np.sort(np.concatenate([base[i % 7 :], rnd.integers(1, 1 << 62, i % 7).astype(np.uint64)])) for i in range(40)]
    component = [0] * 25 + list(range(25, 40))
    darts = (minhash_dedup.signatures(sets, 125) >> np.uint64(16)).astype(np.uint16)
    rows = [(i % 2, i, component[i], darts[i].tobytes(), sets[i].tobytes()) for i in range(40)]
    got = minhash_dedup._joining(spark.createDataFrame(rows, "key long, rep long, component long, darts binary, shingles binary"), 0.8, 125).collect()

    def roots(pairs):
        root = {c: c for c in component}
        for a, b in list(pairs) * 40:
            lo, hi = sorted((root[component[a]], root[component[b]]))
            root = {c: lo if r == hi else r for c, r in root.items()}
        return root

    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    want = [(a, b) for a in range(40) for b in range(a) if a % 2 == b % 2 and component[a] != component[b] and alike(a, b)]
    assert roots([(r.a, r.b) for r in got]) == roots(want) and all(alike(r.a, r.b) for r in got)
