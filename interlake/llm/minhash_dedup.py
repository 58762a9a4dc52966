"""Near-duplicate documents by DartMinHash signatures over word shingles.

Every element owns a Poisson process of darts on (weight, time), made from the element's hash
alone. A document throws the darts under its elements' weights up to the time at which about
k ln k + 2k of them are expected; each dart has a coordinate, and a coordinate keeps its earliest
dart. Two documents keep the same dart with a probability that is their weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import Documents, checkpointed, free_shuffles, sliced
from interlake.llm._text import mix, shingle_sets
from interlake.llm.components import connected_components

_U = np.uint64
BLOCK = 1024  # members of a bucket that one task compares with as many others
FIRST_BAND = -10  # the first band of time ends at 2^-10; later ones double


@lru_cache(256)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count with this mean."""
    n = int(area + 12 * math.sqrt(area) + 24)
    k = np.arange(n)
    log = -area + k * math.log(area) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return np.minimum(np.cumsum(np.exp(log)), 1.0)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """(n, k) darts, 0 where none fell; equal entries of two rows are the same dart.

    sets: hashes of each document's distinct elements. weights: their positive weights, all 1 by default.
    """
    out = np.zeros((len(sets), k), np.uint64)
    sizes = np.array([len(s) for s in sets])
    total = sizes.astype(float) if weights is None else np.array([w.sum() for w in weights], float)
    until = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    top = np.maximum(FIRST_BAND, np.ceil(np.log2(until))).astype(int)  # the band that holds the last moment
    doc = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    w = np.ones(len(x)) if weights is None else np.concatenate(weights).astype(float)
    found = []
    # Cells: weights [0, 1), [1, 2), [2, 4), ... by times [0, 2^-10), [2^-10, 2^-9), ...
    for row in range(0, 1 if not len(w) else max(1, math.ceil(math.log2(max(1.0, w.max()))) + 1)):
        low, high = (0.0, 1.0) if row == 0 else (2.0 ** (row - 1), 2.0**row)
        here = np.flatnonzero(w > low)
        for band in range(FIRST_BAND, int(top.max(initial=FIRST_BAND)) + 1):
            begin, end = (0.0 if band == FIRST_BAND else 2.0 ** (band - 1)), 2.0**band
            at = here[top[doc[here]] >= band]
            if not len(at):
                continue
            cell = mix(x[at] + _U((row * 128 + band + 64) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            count = np.searchsorted(_poisson((high - low) * (end - begin)), _unit(cell), "right")
            many = np.flatnonzero(count)
            repeat = np.repeat(many, count[many])
            nth = np.arange(len(repeat)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
            dart = mix(cell[repeat] ^ mix((nth + 1).astype(np.uint64) * _U(0xA0761D6478BD642F)))
            moment = begin + (end - begin) * _unit(mix(dart ^ _U(1)))
            owner = at[repeat]
            keep = moment <= until[doc[owner]]
            if weights is not None:
                keep &= low + (high - low) * _unit(mix(dart ^ _U(2))) < w[owner]
            found.append((doc[owner][keep], dart[keep], moment[keep]))
    if found:
        d, dart, moment = (np.concatenate(p) for p in zip(*found, strict=True))
        late = np.argsort(-moment, kind="stable")
        spot = d[late] * k + (mix(dart[late] ^ _U(3)) % _U(k)).astype(np.int64)
        out.ravel()[spot] = dart[late] | _U(1)  # of darts on one coordinate the earliest is written last
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys; equal if all rows of the band are."""
    out = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc * _U(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = acc
    return out


def _sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, same, keys, darts): a digest of the shingle set, the band keys, and 16 bits of every dart, of every document with words."""
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), ("keys", pa.list_(pa.int64())), ("darts", pa.binary())])

    def run(batches):
        for batch in sliced(batches, 256):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                own = [sets[i] for i in full]
                signature = signatures(own, bands * rows)
                keys = band_keys(signature, bands, rows).view(np.int64)
                darts = [row.tobytes() for row in (signature >> _U(16)).astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(full)], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(darts, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, same binary, keys array<long>, darts binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct shingle hashes, as bytes."""

    def run(batches):
        for batch in sliced(batches, 256):
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "shingles": [s.tobytes() for s in sets]}, schema=pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())]))

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose exact Jaccard similarity reaches the threshold."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")

    def check(batches):
        for batch in sliced(batches):
            a, b, sa, sb = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for i, (p, q) in enumerate(zip(sa, sb, strict=True)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if min(len(p), len(q)) >= threshold * max(len(p), len(q)):
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    if common >= threshold * (len(p) + len(q) - common):
                        good.append(i)
            if good:
                yield pa.RecordBatch.from_pydict({"a": [a[i] for i in good], "b": [b[i] for i in good]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _joining(members: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) of members (key, rep, component, darts, shingles) of one bucket that join different components by an exact similarity.

    Signatures are compared first; pairs whose estimate is near enough are computed. Of the pairs that
    join the same components a task returns one, so it never returns more rows than it read.
    """
    least = k * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / k))
    # The largest component of a bucket needs no comparison with itself: its members stand in one block each, and only the others go to all blocks.
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "component"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = parts.groupBy("key").agg(largest["component"].alias("main"), blocks(largest["n"]).alias("mains"), blocks(F.sum("n") - largest["n"]).alias("others"))
    dealt = members.join(sizes, "key").withColumn("is_main", F.col("component") == F.col("main"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own, is_main = F.col("own"), F.col("is_main")
    with_main = F.transform(upto(F.when(is_main, F.col("others")).otherwise(F.col("mains"))), lambda i: F.struct(F.lit(1).alias("kind"), F.when(is_main, own).otherwise(i).alias("lo"), F.when(is_main, i).otherwise(own).alias("hi"), is_main.alias("left")))
    among = F.transform(upto(F.col("others")), lambda i: F.struct(F.lit(0).alias("kind"), F.least(own, i).alias("lo"), F.greatest(own, i).alias("hi"), (own <= i).alias("left")))
    spread = dealt.withColumn("task", F.explode(F.when(is_main, with_main).otherwise(F.concat(with_main, among))))
    spread = spread.select("key", "task.kind", "task.lo", "task.hi", "task.left", "rep", "component", "darts", "shingles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        is_left, rep, component = (rows[c].to_numpy() for c in ("left", "rep", "component"))
        darts = np.frombuffer(b"".join(rows["darts"].to_pylist()), np.uint16).reshape(len(rep), k)
        alone = rows["kind"][0].as_py() == 0 and rows["lo"][0].as_py() == rows["hi"][0].as_py()  # one block with itself
        left = np.flatnonzero(is_left)
        right = left if alone else np.flatnonzero(~is_left)
        a, b = [], []
        columns = np.ascontiguousarray(darts[right].T)
        raw: list = rows["shingles"].to_pylist()
        sets: dict[int, frozenset] = {}
        joined: dict[int, int] = {}

        def shingles(i: int) -> frozenset:
            if i not in sets:
                sets[i] = frozenset(np.frombuffer(raw[i], np.uint64).tolist())
            return sets[i]

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for i in left.tolist():
            agree = np.zeros(len(right), np.int16)
            for c in range(k):
                agree += columns[c] == darts[i, c]
            j = right[(agree >= least) & (component[right] != component[i])]
            for other in (j[j > i] if alone else j).tolist():
                p, q = root(int(component[i])), root(int(component[other]))
                if p != q:
                    x, y = shingles(i), shingles(other)
                    common = len(x & y)
                    if common >= threshold * (len(x) + len(y) - common):
                        joined[max(p, q)] = min(p, q)
                        a.append(int(rep[i]))
                        b.append(int(rep[other]))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=schema)

    return spread.groupBy("key", "kind", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """(doc_id, class_id, kept) of every row: classes are the components of pairs with a Jaccard similarity of at least the threshold.

    class_id is the smallest doc_id of the class, and kept is true for that row. Words are runs of
    letters and numbers, lower-cased; a text with fewer than `words` has them all as one shingle; null
    texts and texts without words are classes of their own. doc_id may be of any type that sorts; rows with equal doc_id and
    text are one document and share a class, rows of one doc_id (or none) with other texts are documents of their own. Null ids
    come last, so a class has one only if none of its documents has an id.

    Documents of equal shingle sets become one first. Candidates share a band key. A bucket is not
    expanded into pairs: its members are compared with three of them (the smallest, the one that meets
    most others, a drawn one), and what is confirmed joins components. Members of a bucket that are
    then still in different components meet in blocks inside tasks, all of them, by their signatures;
    pairs whose estimate lies within five standard widths below the threshold are computed exactly.
    So no link between classes is lost; a pair within a component can't change it.
    """
    found = Documents(docs, doc_id, text)
    classes = found.named(_classes(found.rows.select(F.col("doc").alias("doc_id"), "text"), words, threshold, bands, rows), "doc_id", "class_id")
    return classes.select("doc_id", "class_id", "kept")


def _classes(base: DataFrame, words: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """near_duplicates() of (doc_id long, text)."""
    sketch = checkpointed(_sketch(base, words, bands, rows))
    same = sketch.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("darts").alias("darts"))
    reps = checkpointed(same)
    place = reps.select("rep", F.explode("keys").alias("key"))
    sizes = place.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    place = checkpointed(place.join(sizes, "key"))
    weight = place.groupBy("rep").agg(F.sum("n").alias("mass"))
    # The member that meets most others is the likeliest centre of a group; the others stand in as leaders of their own.
    central = F.max(F.struct("mass", "rep"))["rep"].alias("central")
    drawn = F.min(F.struct(F.xxhash64("rep", "key").alias("h"), F.col("rep").alias("r")))["r"].alias("drawn")
    lead = place.join(weight, "rep").groupBy("key").agg(F.min("rep").alias("first"), central, drawn)
    member = place.join(lead, "key")
    ends = F.explode(F.array("first", "central", "drawn"))
    pairs = checkpointed(member.select("rep", ends.alias("lead")).select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).filter("a <> b").distinct())
    nodes = place.select(F.col("rep").alias("doc_id")).distinct()
    sets = checkpointed(_sets(base.join(nodes, "doc_id", "left_semi"), words))
    free_shuffles(base.sparkSession)  # the texts' exchange is as large as the input
    links = checkpointed(_verified(pairs, sets, threshold))
    free_shuffles(base.sparkSession)
    parts = connected_components(links)

    # What is left: members of one bucket in different components.
    placed = place.select("key", "rep").join(parts, place["rep"] == parts["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    rest = placed.join(mixed, "key").join(reps.select("rep", "darts"), "rep").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    more = checkpointed(_joining(rest, threshold, bands * rows))
    if not more.isEmpty():
        parts = connected_components(links.union(more))
    classes = reps.join(parts, reps["rep"] == parts["node"], "left").select("same", F.coalesce("component", "rep").alias("class_id"))
    known = sketch.select("doc_id", "same").join(classes, "same").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return base.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row, with all its columns, of the document that represents each class: that of the smallest doc_id.

    Of rows equal in doc_id and text, the first that is met stays: each task keeps one of them before the shuffle.
    """
    found = Documents(docs, doc_id, text, keep_row=True)
    settings = {"words": 5, "threshold": 0.8, "bands": 25, "rows": 5} | options
    kept = _classes(found.rows.select(F.col("doc").alias("doc_id"), "text"), **settings).filter("kept").select(F.col("doc_id").alias("kept_doc"))
    if found.repeats:
        kept = kept.distinct()
    rows = found.rows.join(kept, F.col("doc") == F.col("kept_doc"), "left_semi")
    if found.repeats:
        rows = rows.groupBy("doc").agg(F.first("row").alias("row"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
