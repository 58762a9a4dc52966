"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult (a lexicon of words and word roots with weights, learned from
labels), threat, target, negation, report, other. Small transducers, each remembering for a few
words that a negation, a target or a report came by, are composed into one table; a clause runs
through it, and each insult or threat comes out on a channel: plain, targeted, negated or
reported. A document's score is a logistic function of the weights on its channels.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import by_batch, checkpointed, only
from interlake.llm._text import chunks, codepoints, doc_starts, prefix_hash, span_hash

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Closed classes in the four languages of the corpus.
WORDS = {
    THREAT: "kill hurt destroy beat burn shoot stab crush töten schlagen vernichten verbrennen tuer frapper détruire brûler matar golpear destruir quemar",
    TARGET: "you your yours he she him her they them everyone people du dich dir ihr euch sie ihn tu te toi vous lui elle eux ils tú usted ustedes ti él ella ellos",
    NEGATION: "not no never nor without isn't aren't nicht kein keine keinen nie niemals pas jamais aucun sin nunca ningún tampoco",
    REPORT: "said says say wrote writes quoted reported claims claimed called according sagte sagt schrieb laut dit écrit selon dijo dice escribió según",
}
#: Stems and endings of the verbs of threat, by language: every stem takes every ending of its row.
THREAT_FORMS = [
    ("kill hurt destroy burn stab crush beat shoot", ["", "s", "es", "ed", "en", "ing"]),
    ("töt vernicht verbrenn schlag", ["en", "e", "st", "est", "t", "et", "te", "ten", "ete", "eten", "end"]),
    ("tu frapp brûl", ["er", "e", "es", "ent", "ons", "ez", "é", "ée", "és", "ant", "erai", "eras", "era", "erons", "erez", "eront", "erais", "erait"]),
    ("mat golpe quem", ["ar", "o", "as", "a", "amos", "an", "é", "aste", "ó", "aron", "aré", "arás", "ará", "aremos", "arán", "aría", "ando", "ado", "ada"]),
    ("détrui", ["re", "s", "t", "sent", "rai", "ras", "ra", "ront", "sant", "te"]),
    ("destru", ["ir", "yo", "yes", "ye", "yen", "iré", "irás", "irá", "irán", "yó", "ido", "yendo"]),
]
ROOTS = (4, 5, 6)
#: How many words each memory lasts.
LASTS = {NEGATION: 3, TARGET: 4, REPORT: 12}
CHANNELS = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_targeted", "threat_negated", "threat_reported")

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")


@lru_cache(1)
def closed_classes() -> dict[str, int]:
    """Symbol of every listed word, and of every form of a verb of threat that isn't listed otherwise."""
    forms = {stem + ending: THREAT for stems, endings in THREAT_FORMS for stem in stems.split() for ending in endings}
    return forms | {w: kind for kind, words in WORDS.items() for w in words.split()}


@lru_cache(1)
def grammar() -> tuple[np.ndarray, np.ndarray]:
    """(next state, channel or -1) by composed state and symbol: the product of the three memories."""
    sizes = [LASTS[k] + 1 for k in (NEGATION, TARGET, REPORT)]
    states = list(product(*map(range, sizes)))
    number = {s: i for i, s in enumerate(states)}
    after, channel = np.zeros((len(states), 6), np.int16), np.full((len(states), 6), -1, np.int8)
    for (neg, tgt, rep), symbol in product(states, range(6)):
        i = number[neg, tgt, rep]
        step = [LASTS[k] if symbol == k else max(0, x - 1) for k, x in ((NEGATION, neg), (TARGET, tgt), (REPORT, rep))]
        after[i, symbol] = number[tuple(step)]
        if symbol in (INSULT, THREAT):
            kind = 2 if neg else 3 if rep else 1 if tgt else 0
            channel[i, symbol] = kind + 4 * (symbol == THREAT)
    return after, channel


def clauses(text: str) -> list[list[str]]:
    """Words of each clause, lower-cased."""
    out: list[list[str]] = [[]]
    for t in _TOKEN.findall(text.lower()):
        if t in ".!?;:\n":
            if out[-1]:
                out.append([])
        else:
            out[-1].append(t)
    return out


@lru_cache(1)
def _word_chars() -> np.ndarray:
    """True for the code points of which _TOKEN makes words."""
    return np.array([chr(cp).isalnum() and not chr(cp).isdecimal() for cp in range(sys.maxunicode + 1)])


def token_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word that clauses() finds: runs of letters, two with one apostrophe between them as one."""
    word, fresh = _word_chars()[cps], doc_starts(len(cps), offsets)
    start = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | fresh))
    end = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | np.concatenate([fresh[1:], [True]]))) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    linked = np.zeros(len(start), bool)  # with the next run, by one apostrophe
    near = np.flatnonzero((start[1:] == end[:-1] + 1) & (doc[1:] == doc[:-1]))
    linked[near] = cps[end[near]] == 0x27
    place = np.arange(len(start))
    chain = np.maximum.accumulate(np.where(np.concatenate([[False], linked[:-1]])[: len(start)], 0, place)) if len(start) else place
    head = np.flatnonzero((place - chain) % 2 == 0)  # of a chain of runs the first and second are one word, the third and fourth, ...
    return start[head], end[np.where(linked[head], head + 1, head)], doc[head]


class Lexicon:
    """Weights of insult words and roots."""

    def __init__(self, words: dict[str, float], roots: dict[str, float]):
        self.words, self.roots = words, roots
        self.classes = closed_classes()
        listed = [*words, *(w for w, k in self.classes.items() if k == THREAT)]
        self.word_hash = np.sort(_hashes(listed))
        self.root_hash = {n: np.sort(_hashes([r for r in roots if len(r) == n])) for n in ROOTS}

    def symbol(self, word: str) -> tuple[int, float]:
        known = self.classes.get(word)
        if known is not None:
            return known, 1.0
        weight = self.words.get(word, 0.0)
        for n in ROOTS:
            if len(word) > n:
                weight = max(weight, self.roots.get(word[:n], 0.0))
        return (INSULT, weight) if weight else (OTHER, 0.0)

    def channels(self, text: str) -> np.ndarray:
        """Sum of weights on each channel over all clauses."""
        after, channel = grammar()
        out = np.zeros(len(CHANNELS))
        for words in clauses(text):
            state = 0
            marked = [self.symbol(w) for w in words]
            if not any(s in (INSULT, THREAT) for s, _ in marked):
                continue
            # A target may also follow its insult: run the clause backwards for that memory.
            ahead = 0
            later = [False] * len(marked)
            for i in range(len(marked) - 1, -1, -1):
                later[i] = ahead > 0
                ahead = LASTS[TARGET] if marked[i][0] == TARGET else max(0, ahead - 1)
            for (s, w), follows in zip(marked, later, strict=True):
                c = channel[state, s]
                if c >= 0:
                    out[c + 1 if follows and c % 4 == 0 else c] += w
                state = after[state, s]
        return out

    def candidates(self, texts: list[str]) -> np.ndarray:
        """True for texts with a listed word or root, by the hashes of the words that clauses() finds: only these need the grammar."""
        out = np.zeros(len(texts), bool)
        for first, part in chunks([t.lower() for t in texts]):
            cps, offsets = codepoints(part)
            start, end, doc = token_spans(cps, offsets)
            prefix = prefix_hash(cps)
            hit = _among(span_hash(prefix, start, end), self.word_hash)
            for n, table in self.root_hash.items():
                if len(table):
                    longer = np.flatnonzero(end - start > n)
                    hit[longer] |= _among(span_hash(prefix, start[longer], start[longer] + n), table)
            out[first + np.unique(doc[hit])] = True
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(CHANNELS)))
        for i in np.flatnonzero(self.candidates(texts)):
            out[i] = self.channels(texts[i])
        return np.log1p(out)


def _hashes(words: list[str]) -> np.ndarray:
    cps, offsets = codepoints(words)
    return span_hash(prefix_hash(cps), offsets[:-1], offsets[1:])


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def learn_lexicon(labelled: DataFrame, *, most: int = 1 << 20, support: int = 5, odds: float = 2.0, surprise: float = 20.0) -> Lexicon:
    """Insult words and roots from rows (text, toxic 0/1): all of them are counted.

    A word's evidence is the number of toxic texts that hold it, or of different words that
    follow it in them if those are fewer, so that copies of one text count once; against it
    stands the number of clean texts that hold the word. Roots (first 4 to 6 letters) add up
    their words. All with enough support, log odds and log-likelihood ratio are kept. They go to the
    driver and out again: a lexicon of over `most` words or roots is an error, as its size is checked
    before, and no entry is left out (raise `support` then).
    """
    words = labelled.select("toxic", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))
    following = F.arrays_zip(F.col("w").alias("w"), F.slice(F.col("w"), F.lit(2), F.size("w")).alias("next"))
    bad = words.filter("toxic = 1").select(F.explode(F.array_distinct(following)).alias("p")).select(F.col("p.w").alias("word"), F.xxhash64(F.coalesce(F.col("p.next"), F.lit(""))).alias("next"))
    contexts = bad.filter("length(word) > 2").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("contexts"))
    held = words.select("toxic", F.explode(F.array_distinct("w")).alias("word")).filter("length(word) > 2")
    docs = held.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    both = checkpointed(docs.join(contexts, "word", "left").select("word", F.least("t", F.coalesce("contexts", F.lit(0))).alias("t"), "c"))
    size = both.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not size["t"] or not size["c"]:
        return Lexicon({}, {})
    share = size["t"] / (size["t"] + size["c"])

    def strong(df: DataFrame, least: int) -> DataFrame:
        t, c = F.col("t"), F.col("c")
        odd = F.log((t + 0.5) / (c + 0.5)) - F.log(F.lit(share / (1 - share)))
        ratio = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
        return df.filter(t >= least).withColumn("weight", odd).filter((odd >= odds) & (ratio >= surprise))

    def gathered(df: DataFrame) -> list:
        got = df.limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} lexicon entries: raise support, odds or surprise")
        return got

    found = gathered(strong(both, support))
    roots = both.select(F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in ROOTS])).alias("word"), F.col("word").alias("whole"), "t", "c").filter("word is not null")
    roots = roots.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("n")).filter(F.col("n") >= 4)
    rooted = gathered(strong(roots, 2 * support))
    words_kept = {r["word"]: r["weight"] for r in found}
    roots_kept = {r["word"]: r["weight"] for r in rooted}
    return Lexicon(words_kept, roots_kept)


def fit(labelled: DataFrame, lexicon: Lexicon, *, sample_rows: int = 20_000) -> np.ndarray:
    """Bias and a weight (0 or more) for each channel, by logistic regression on at most sample_rows labelled rows, chosen by hash."""
    n = labelled.count()
    share = min(1.0, sample_rows / max(1, n))
    rows = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def features(batch):
        return {"y": batch.column(1), "x": lexicon.features([t or "" for t in batch.column(0).to_pylist()]).tolist()}

    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(by_batch(features, schema), "y int, x array<double>").groupBy("x", "y").count().collect()
    weights = np.zeros(len(CHANNELS) + 1)
    if not got:
        weights[0] = -20.0
        return weights
    x = np.array([[1.0, *r["x"]] for r in got])
    y, n_each = np.array([r["y"] for r in got], float), np.array([r["count"] for r in got], float)
    n_each /= n_each.sum()
    for _ in range(4000):  # projected gradient: no channel speaks for a text
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 0.5 * (x.T @ (n_each * (p - y)) + 1e-5 * np.r_[0, weights[1:]])
        weights[1:] = np.maximum(weights[1:], 0)
    return weights


def train(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", broadcast_labels: int = 1 << 20, **options) -> dict:
    """Lexicon and channel weights from the labelled rows for which `learn` (on doc_id) holds. Null labels, texts and ids are left out; a doc_id with several
    label rows, or several texts, counts with each pair.

    Labels (two numbers each) go to the texts by broadcast if there are `broadcast_labels` at most; else both sides shuffle.
    """
    marks = only(labels, doc_id=doc_id, toxic=label).filter("toxic is not null")
    if learn is not None:
        marks = marks.filter(learn)
    if marks.limit(broadcast_labels + 1).count() <= broadcast_labels:
        marks = F.broadcast(marks)
    labelled = only(docs, doc_id=doc_id, text=text).filter("text is not null").join(marks, "doc_id")
    lexicon = learn_lexicon(labelled, **options)
    return {"lexicon": lexicon, "weights": fit(labelled, lexicon)}


def score(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null and empty ones get the bias alone."""
    base = only(docs, doc_id=doc_id, text=text)
    kind = base.schema["doc_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most `most` words and as many roots
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batch):
        m = sent.value
        x = m["lexicon"].features([t or "" for t in batch.column(1).to_pylist()])
        p = 1 / (1 + np.exp(-(m["weights"][0] + x @ m["weights"][1:])))
        return {"doc_id": batch.column(0), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return base.mapInArrow(by_batch(run, schema), f"doc_id {kind.simpleString()}, score double, predicted int")
