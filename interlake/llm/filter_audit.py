"""Filter interaction audit: what each filter removes in every order of a cascade, by a subset-zeta transform.

Every document gets a mask of the filters that it fails. Counts per part and mask, at most 2^filters of them,
are all that the orders need: the documents that survive a set of filters are those whose mask has nothing
of the set, a sum over subsets that the zeta transform makes for all sets at once. A step of an order removes
the difference between the survivors of two neighbouring sets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import by_batch, checkpointed

LETTERS = "ABCDE"
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True
CHUNK = 1 << 20  # bytes of a text that are split at a time
HOT = 1024  # a key with more than 1 / HOT of the rows goes out by broadcast; there are HOT of them at most


def word_counts(data: bytes) -> tuple[int, int]:
    """Words (runs without the six ASCII blanks) and distinct words of a UTF-8 text, split in chunks that end at a blank."""
    if len(data) <= CHUNK:
        words = data.split()  # bytes split at exactly these blanks
        return len(words), len(set(words))
    raw = np.frombuffer(data, np.uint8)
    total, seen, at = 0, set(), 0
    while at < len(data):
        end, step = min(len(data), at + CHUNK), CHUNK
        while end < len(data) and not BLANK[raw[end]]:  # to the next blank, however far
            blanks = np.flatnonzero(BLANK[raw[end : end + step]])
            end = end + int(blanks[0]) if len(blanks) else min(len(data), end + step)
        words = data[at:end].split()
        total += len(words)
        seen.update(words)
        at = end
    return total, len(seen)


def text_mask(data: bytes) -> int:
    """Bits 0 to 3 for what a text by itself fails: A under 100 words, B under 80 % distinct words, C over 10 % capitals A-Z, D any of #$%&*|."""
    words, distinct = word_counts(data)
    raw = np.frombuffer(data, np.uint8)
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    points = len(raw) - int(np.count_nonzero((raw & 0xC0) == 0x80))
    return (words < 100) | (100 * distinct < 80 * words) << 1 | (100 * capitals > 10 * points) << 2 | bool(MARKS[raw].any()) << 3


def failures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask int) of every row: bits 0 to 4 for filters A to E failed.

    E fails a row if a row of smaller doc_id anywhere has the same text (compared by SHA-256); rows of equal doc_id aren't smaller than one
    another, and a row of null doc_id is neither smaller nor larger than any, so it passes E. A null text is empty, a
    null part is the empty string. Texts may be of any length. A text that a large share of all rows holds isn't a
    shuffled key: the least ids of texts with over 1/HOT of the rows go out by broadcast, HOT of them at most.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit("").cast("binary")).alias("data"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([("doc_id", to_arrow_type(slim.schema["doc_id"].dataType)), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])

    def scan(batch):
        masks, digests = [], []
        for value in batch.column(2):  # one text at a time as Python bytes
            data = value.as_py()
            masks.append(text_mask(data))
            digests.append(hashlib.sha256(data).digest())
        return {"doc_id": batch.column(0), "part": batch.column(1), "mask": masks, "digest": digests}

    rows = checkpointed(slim.mapInArrow(by_batch(scan, arrow), f"doc_id {id_type}, part string, mask int, digest binary"))
    groups = checkpointed(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = rows.count()
    hot = groups.filter(F.col("n") > total / HOT).select(F.col("digest").alias("hot_digest"), F.col("least").alias("hot_least"))
    cold = groups.filter(F.col("n") <= total / HOT).select(F.col("digest").alias("key"), "least")
    met = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    # Rows that met a hot text need no partner more: a key of their own keeps them spread.
    own = F.concat(F.lit("-").cast("binary"), F.xxhash64(F.monotonically_increasing_id()).cast("string").cast("binary"))
    met = met.withColumn("key", F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(own))
    met = met.join(cold, "key", "left")
    copy = F.coalesce(F.col("doc_id") > F.coalesce("hot_least", "least"), F.lit(False))
    return met.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """masks with good and toxic (0 or 1): whether any label row of the doc_id says quality 1, toxic 1. Null ids have no labels."""
    said = labels.filter(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("labelled"))
    said = said.agg(F.max((F.col(f"`{quality}`") == 1).cast("int")).alias("good"), F.max((F.col(f"`{toxic}`") == 1).cast("int")).alias("toxic"))
    both = masks.join(said.filter("good = 1 or toxic = 1"), masks["doc_id"] == said["labelled"], "left")
    return both.select("doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def zeta(counts: np.ndarray) -> np.ndarray:
    """Sums over all subsets of each index, bit by bit; counts: 2^filters numbers along the last axis."""
    out = counts.astype(np.int64).copy()
    for bit in range(int(math.log2(out.shape[-1]))):
        halves = out.reshape(*out.shape[:-1], -1, 2, 1 << bit)
        halves[..., 1, :] += halves[..., 0, :]
    return out


def survivors(counts: np.ndarray) -> np.ndarray:
    """For every set of filters the documents that fail none of it: subsets of the set's complement."""
    return zeta(counts)[..., ::-1]


@lru_cache(4)
def steps(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all orders of n filters, in order: the filter of each step, and the sets applied before and after it."""
    chosen = np.array(list(itertools.permutations(range(n))), np.int64)
    after = np.cumsum(1 << chosen, axis=1)
    return chosen, after - (1 << chosen), after


def audit_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Columns (orders x steps) from counts of documents, good and toxic ones by mask (3 x 2^filters)."""
    n = int(math.log2(counts.shape[-1]))
    left, (chosen, before, after) = survivors(counts), steps(n)
    gone = left[:, before] - left[:, after]
    none = left[0, 0]
    failing = none - left[0, 1 << np.arange(n)]
    total = np.zeros(n, np.int64)
    np.add.at(total, chosen.ravel(), gone[0].ravel())
    return {
        "kept": left[0, after], "removed": gone[0], "redundant": failing[chosen] - gone[0], "unique_fails": counts[0, 1 << np.arange(n)][chosen],
        "good_lost": gone[1], "toxic_lost": gone[2], "shapley": total[chosen],
    }


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(rows: DataFrame, *, letters: str = LETTERS, part: str = "part", mask: str = "mask", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, and the counts of COUNTS) of every part, order of the filters and step, zeros included.

    rows: a mask of failed filters (bit i for letters[i], other bits are an error) and two 0/1 labels each. Only counts per part and
    mask shuffle, summed up within tasks first; a part may hold any share of the rows. A table without rows gives none. A null
    part counts as one of its own; null masks and labels count as 0.
    """
    size = 1 << len(letters)
    names = ["".join(letters[i] for i in order) for order in itertools.permutations(range(len(letters)))]
    one = lambda c: F.sum(F.when(F.col(f"`{c}`") == 1, 1).otherwise(0)).cast("long")
    counted = rows.groupBy(F.col(f"`{part}`").alias("part"), F.coalesce(F.col(f"`{mask}`"), F.lit(0)).alias("mask")).agg(F.count(F.lit(1)).alias("n"), one(good).alias("good"), one(toxic).alias("toxic"))
    tables = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^filters cells at most
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])

    def expand(batches):
        for batch in batches:
            for name, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.zeros((3, size), np.int64)
                for cell in cells:
                    counts[:, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                made = audit_counts(counts)
                each = len(letters)
                head = [pa.array([name] * len(names) * each, pa.string()), pa.array(np.repeat(np.array(names, object), each), pa.string()), pa.array(np.tile(np.arange(1, each + 1), len(names)), pa.int32())]
                yield pa.RecordBatch.from_arrays(head + [pa.array(made[c].ravel(), pa.int64()) for c in COUNTS], schema=schema)

    return tables.select(F.col("part").cast("string"), "cells").mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
