"""Language identification by hyperdimensional profiles.

Letters have fixed random sign vectors; an n-gram vector binds (multiplies) them after permuting
(rotating) each by its place; a document bundles (adds) its n-gram vectors; the prediction is the
language whose prototype, the bundle of its documents' unit vectors less the mean of all
languages, has the largest cosine with the document's vector less the same mean.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import by_batch, only, sliced
from interlake.llm._text import LETTER, char_classes, chunks, codepoints, mix

SYMBOLS = 64  # classes of letters: 0 between words, 1-26 a-z, the rest by hash of the code point
UNKNOWN = "und"
TEXTS, GRAMS = 512, 4096  # texts, and different trigrams, whose counts are held side by side


@lru_cache(1)
def _symbols() -> np.ndarray:
    kinds = char_classes()
    table = np.zeros(len(kinds), np.uint8)
    cps = np.flatnonzero(kinds == LETTER)
    table[cps] = 27 + (mix(cps.astype(np.uint64)) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
    for i in range(26):
        table[ord("a") + i] = i + 1
    return table


@lru_cache(2)
def _letters(dims: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dims), dtype=np.int8)
    return (signs * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The bound vectors of trigrams of symbols (a * 64 + b) * 64 + c."""
    letters = _letters(dims, seed)
    return np.roll(letters, 2, 1)[grams >> 12] * np.roll(letters, 1, 1)[(grams >> 6) & 63] * letters[grams & 63]


def bundles(texts: list[str], *, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of float32 per text, its bundle scaled to length 1 (zero without letters); and where there are letters."""
    out, letters = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), bool)
    runs = ((a + first, part) for a in range(0, len(texts), TEXTS) for first, part in chunks([t.lower() for t in texts[a : a + TEXTS]], 1 << 18))
    for first, part in runs:
        cps, offsets = codepoints(part)
        sym = _symbols()[cps].astype(np.int32)
        doc = np.repeat(np.arange(len(part)), np.diff(offsets))
        letters[first : first + len(part)] = np.bincount(doc[sym > 0], minlength=len(part)) > 0
        # Runs of non-letters count as one gap; each text has a gap at both ends.
        keep = sym > 0
        gap = ~keep & np.concatenate([[False], keep[:-1] & (doc[1:] == doc[:-1])]) if len(sym) else keep
        sym, doc = sym[keep | gap], doc[keep | gap]
        if len(sym) < 3:
            continue
        same = doc[2:] == doc[:-2]
        gram = ((sym[:-2] << 12) | (sym[1:-1] << 6) | sym[2:])[same]
        at = doc[:-2][same]
        flag = np.zeros(SYMBOLS**3, bool)
        flag[gram] = True
        distinct = np.flatnonzero(flag)
        index = np.zeros(SYMBOLS**3, np.int32)
        index[distinct] = np.arange(len(distinct))
        which = index[gram]
        for a in range(0, len(distinct), GRAMS):
            some = distinct[a : a + GRAMS]
            here = slice(None) if len(some) == len(distinct) else (which >= a) & (which < a + len(some))
            counts = np.bincount(at[here] * len(some) + which[here] - a, minlength=len(part) * len(some)).reshape(len(part), -1)
            out[first : first + len(part)] += counts.astype(np.float32) @ gram_vectors(some, dims, seed).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1), letters


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", learn: Column | None = None, dims: int = 1024, seed: int = 11) -> dict:
    """Prototypes of all languages in the rows for which `learn` holds (all by default).

    Every such row with a non-null language and text counts; each task adds up its own, and the
    sums meet by language and dimension. What comes to the driver is `dims` numbers per language.
    """
    rows = docs.filter(learn) if learn is not None else docs
    rows = only(rows, text=text, lang=lang).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in sliced(batches):
            langs = np.array(batch.column(1).to_pylist(), object)
            vectors, _ = bundles(batch.column(0).to_pylist(), dims=dims, seed=seed)
            for name in set(langs.tolist()):
                here = langs == name
                sums[name] = sums.get(name, 0) + vectors[here].sum(0, dtype=np.float64)
                seen[name] = seen.get(name, 0) + int(here.sum())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([seen[k] for k in sums], pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], schema=schema)

    parts = rows.mapInArrow(add, "lang string, n long, total array<double>")
    added = parts.select("lang", "n", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    found = added.groupBy("lang").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    langs = [r["lang"] for r in found]
    means = np.array([[e["x"] for e in r["v"]] for r in found]).reshape(len(found), dims) / np.array([[r["n"]] for r in found]).reshape(-1, 1) if found else np.zeros((0, dims))
    centre = means.mean(0) if len(langs) > 1 else np.zeros(dims)
    proto = means - centre
    length = np.linalg.norm(proto, axis=1, keepdims=True)
    return {"langs": langs, "prototypes": (proto / np.where(length > 0, length, 1)).astype(np.float32), "centre": centre.astype(np.float32), "dims": dims, "seed": seed}


def _scores(texts: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    vectors, letters = bundles(texts, dims=model["dims"], seed=model["seed"])
    if not model["langs"]:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    moved = vectors - model["centre"]
    length = np.linalg.norm(moved, axis=1, keepdims=True)
    cosine = (moved / np.where(length > 0, length, 1)) @ model["prototypes"].T
    best = cosine.argmax(1)
    value = np.clip((1 + cosine[np.arange(len(best)), best].astype(np.float64)) / 2, 0, 1)
    return [model["langs"][i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)], np.where(letters, value, 0.0)


def predict(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    lang_pred is a learned language, or 'und' with score 0 if the text is null or has no letter, or
    if nothing was learned. score is (1 + cosine) / 2. Of equal cosines the first language in order wins.
    """
    base = only(docs, doc_id=doc_id, text=text)
    kind = base.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # dims floats per language

    def score(batch):
        names, scores = _scores([t or "" for t in batch.column(1).to_pylist()], sent.value)
        return {"doc_id": batch.column(0), "lang_pred": names, "score": scores}

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([("doc_id", to_arrow_type(base.schema["doc_id"].dataType)), ("lang_pred", pa.string()), ("score", pa.float64())])
    return base.mapInArrow(by_batch(score, arrow), f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict, *, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and scores above min_score; in one pass over the table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at, arrow = docs.columns.index(text), to_arrow_schema(docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            good = _scores([t or "" for t in batch.column(at).to_pylist()], sent.value)[1] > min_score
            if good.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good)).columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) modulo folds is fold; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
