"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors.

A vector is scaled to length 1, rotated at random and stored once as its sign bits, with the inner
product of the rotated vector and its own code. From code and factor follows an unbiased estimate of the
cosine with any other vector, and a bound on its error. The other vector is taken in steps of
1/15 of its range, so an estimate is four counts of common bits for every 64 dimensions. A pair is
computed exactly, in double precision, only where estimate + bound reaches the threshold. Pairs meet
in buckets of sign bits of further rotations.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import checkpointed, sliced
from interlake.llm.components import connected_components

BUCKET = 256  # vectors that a bucket holds on average, about
BLOCK = 2048  # vectors of a bucket that one task compares with as many others


@lru_cache(64)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Signs (-1, 1) of the rotated rows, and each row's inner product with its code of length 1."""
    turned = unit @ rotation(unit.shape[1], seed)
    signs = np.where(turned >= 0, 1, -1).astype(np.int8)
    return signs, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def pack_signs(signs: np.ndarray) -> np.ndarray:
    """Rows of signs as rows of 64-bit words; bits beyond the dimensions are 0."""
    bits = np.packbits(signs > 0, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


class Query:
    """Rotated unit rows in 4-bit steps: four planes of bits, the step and the least value of each row."""

    def __init__(self, turned: np.ndarray):
        self.dims = turned.shape[1]
        self.least = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.least) / 15, 1e-300)
        level = np.rint((turned - self.least[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [pack_signs(((level >> k) & 1).astype(np.int8)) for k in range(4)]
        self.total = level.sum(1, dtype=np.int64)

    def stored(self) -> list[bytes]:
        """Each row as bytes, to be stored beside its code: half a byte a dimension and three numbers."""
        words = np.concatenate(self.planes, 1).view(np.uint8)
        return [w.tobytes() + np.array([a, b, t], np.float64).tobytes() for w, a, b, t in zip(words, self.least, self.step, self.total, strict=True)]

    @classmethod
    def read(cls, rows: list[bytes], dims: int) -> Query:
        """Rows that stored() gave."""
        out = cls.__new__(cls)
        raw = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
        out.dims, wide = dims, (raw.shape[1] - 3) // 4
        out.planes = [np.ascontiguousarray(raw[:, k * wide : (k + 1) * wide]) for k in range(4)]
        figures = np.ascontiguousarray(raw[:, 4 * wide :]).view(np.float64)
        out.least, out.step, out.total = figures[:, 0].copy(), figures[:, 1].copy(), figures[:, 2].astype(np.int64)
        return out

    def some(self, at: np.ndarray) -> Query:
        """These rows alone."""
        out = type(self).__new__(type(self))
        out.dims, out.planes = self.dims, [p[at] for p in self.planes]
        out.least, out.step, out.total = self.least[at], self.step[at], self.total[at]
        return out

    def estimate(self, rows: slice, codes: np.ndarray, ones: np.ndarray, factor: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of these rows with coded ones, and a bound of their error at `sure` standard widths of code and steps.

        codes: 64-bit words of signs, ones: how many of each are set, factor: inner products of the rows and their codes.
        """
        common = np.zeros((rows.stop - rows.start, len(codes)), np.int32)
        for k, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                common += np.bitwise_count(plane[rows, w][:, None] & codes[None, :, w]).astype(np.int32) << k
        # Of signs s and levels q: the sum of s * (least + step * q), with s = 2 * bit - 1.
        plain = self.least[rows, None] * (2 * ones - self.dims)[None, :] + self.step[rows, None] * (2 * common - self.total[rows, None])
        scale = 1 / (math.sqrt(self.dims) * factor)
        width = np.sqrt(np.maximum(0.0, 1 - factor**2)) / (factor * math.sqrt(max(1, self.dims - 1)))
        rough = self.step[rows, None] / math.sqrt(12) / factor[None, :]
        return plain * scale[None, :], sure * np.hypot(width[None, :], rough)


def estimate(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated unit rows with coded ones, and the bound of each coded one's error at `sure` standard widths."""
    d = turned.shape[1]
    got = (turned.astype(np.float32) @ signs.T.astype(np.float32)) / (math.sqrt(d) * factor)
    width = sure * np.sqrt(np.maximum(0.0, 1 - factor**2)) / (factor * math.sqrt(max(1, d - 1)))
    return got, width


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n vectors of one label: buckets of about BUCKET, and a pair at the threshold meets in one of the tables with this probability."""
    bits = max(0, math.ceil(math.log2(max(1, n) / BUCKET)))
    if bits == 0:
        return 0, 1
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def bucket_keys(unit: np.ndarray, bits: int, tables: int, seed: int = 1000) -> np.ndarray:
    """A bucket number of each row in each table: the signs of `bits` rotated coordinates, each table with its own."""
    if bits == 0:
        return np.zeros((len(unit), 1), np.int64)
    d = unit.shape[1]
    need = bits * tables
    turned = np.concatenate([unit @ rotation(d, seed + i) for i in range(-(-need // d))], 1)[:, :need] >= 0
    return turned.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _links(a: dict, b: dict | None, threshold: float, sure: float):
    """Pairs (i, j) with exact cosine >= threshold, of a with itself (i < j) or of a with b."""
    other = b or a
    query = Query(a["unit"] @ rotation(a["unit"].shape[1], 1))
    ones = np.bitwise_count(other["codes"]).sum(1, dtype=np.int64)
    for first in range(0, len(a["unit"]), 256):
        rows = slice(first, min(first + 256, len(a["unit"])))
        got, width = query.estimate(rows, other["codes"], ones, other["factor"], sure)
        i, j = np.nonzero(got + width >= threshold)
        i += first
        if b is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            cosine = np.einsum("ij,ij->i", a["unit"][i], other["unit"][j])
            good = cosine >= threshold
            yield i[good], j[good]


def _near(query: Query, codes: np.ndarray, factor: np.ndarray, sides: tuple, threshold: float, sure: float) -> np.ndarray:
    """True for the rows that have a partner whose estimate doesn't rule the threshold out: rows of sides[0] with one another, or with those of sides[1]."""
    left, right = sides[0], sides[0] if sides[1] is None else sides[1]
    out = np.zeros(len(codes), bool)
    asked, other, own = query.some(left), codes[right], factor[right]
    ones = np.bitwise_count(other).sum(1, dtype=np.int64)
    for first in range(0, len(left), 256):
        rows = slice(first, min(first + 256, len(left)))
        got, width = asked.estimate(rows, other, ones, own, sure)
        close = got + width >= threshold
        if sides[1] is None:
            close[np.arange(rows.stop - rows.start), np.arange(rows.start, rows.stop)] = False
        out[left[rows]] |= close.any(1)
        out[right] |= close.any(0)
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _block(rows: pa.Table) -> dict:
    raw = np.array(rows["vector"].to_pylist(), np.float64)
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(len(raw), -1)
    return {"id": rows["rep"].to_numpy(), "n": rows["n"].to_numpy(), "keys": np.array(rows["keys"].to_pylist(), np.int64), "unit": _unit(raw), "codes": codes, "factor": rows["factor"].to_numpy()}


def _forest(n: int, pairs) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Union-find over n rows: roots, and the pairs that joined two trees."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return np.array([find(x) for x in range(n)]), kept


def link_vectors(
    df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", threshold: float = 0.93, recall: float = 0.999, sure: float = 4.0
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two rows are linked if their labels are equal and not null (label=None: no condition), their
    lengths are equal and their cosine in double precision is at least the threshold. Null, zero
    and non-finite vectors link with nothing. Every link found is exact; one at the threshold
    is found with probability `recall` (of meeting in a bucket) times that of the bound, and links above it more likely.

    Equal vectors of a label become one row with a count. Bits and tables follow each label's
    count, so buckets keep their size as data grows. Buckets first get codes and quantised rows only, and tell which rows have a partner that
    the estimate doesn't rule out; those rows' vectors alone are fetched for the exact cosines. A bucket above BLOCK rows, as a dense
    cluster or a hot label makes, is compared in blocks by several tasks. Each pair counts in
    the first table where it meets. What leaves a task is a number of links for each vector and
    the edges of a spanning forest, never the pairs. Repeated vec_ids count as rows of their own
    but share a result; vec_id must not be null. Labels of up to 256 different vectors have one
    bucket, so none of their links is missed.
    """
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"  # whatever the column holds, unrounded
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("vector"), (F.col(f"`{label}`").cast("string") if label else F.lit("")).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vector").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    # -0.0 equals 0.0: grouping takes care of that for scalars only.
    able = rows.filter(good).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    reps = able.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    per_label = reps.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    reps = checkpointed(reps.join(per_label, "label"))

    keyed = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("rep", pa.int64()), ("n", pa.int64()), ("vector", pa.list_(pa.float32() if kind == "float" else pa.float64())), ("keys", pa.list_(pa.int64())), ("code", pa.binary()), ("factor", pa.float64()), ("steps", pa.binary())])

    def key(batches):
        for batch in sliced(batches, 4096):
            t = pa.Table.from_batches([batch])
            sizes, dims = t["of_label"].to_numpy(), np.array([len(v) for v in t["vector"]])
            keys: list = [None] * len(sizes)
            codes: list = [None] * len(sizes)
            steps: list = [None] * len(sizes)
            factors = np.zeros(len(sizes))
            for size, d in sorted(set(zip(sizes.tolist(), dims.tolist(), strict=True))):
                at = np.flatnonzero((sizes == size) & (dims == d))
                raw = np.array(t["vector"].take(at).to_pylist(), np.float64)
                unit = _unit(raw)
                signs, factors[at] = encode(unit)
                asked = Query(unit @ rotation(d, 1)).stored()
                for i, k, code, q in zip(at, bucket_keys(unit, *plan(size, threshold, recall)), pack_signs(signs), asked, strict=True):
                    keys[i], codes[i], steps[i] = k, code.tobytes(), q
            yield pa.RecordBatch.from_arrays([t["label"].combine_chunks(), pa.array(dims, pa.int32()), t["rep"].combine_chunks(), t["n"].combine_chunks(), t["vector"].combine_chunks(), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array(factors), pa.array(steps, pa.binary())], schema=keyed)

    made = reps.select("label", "rep", "n", "vector", "of_label").mapInArrow(key, f"label string, dims int, rep long, n long, vector array<{kind}>, keys array<long>, code binary, factor double, steps binary")
    coded = checkpointed(made)
    # Codes and steps go to the buckets, about a byte a dimension; vectors follow only where an estimate leaves a partner.
    places = coded.select("label", "dims", "rep", "code", "factor", "steps", F.posexplode("keys").alias("t", "key"))
    sizes = places.groupBy("label", "dims", "t", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    spread = places.join(sizes, ["label", "dims", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    near_schema = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("t", pa.int32()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("own", pa.int32()), ("rep", pa.int64())])

    def sides_of(own: np.ndarray, lo: int, hi: int) -> tuple:
        return np.flatnonzero(own == lo), None if lo == hi else np.flatnonzero(own == hi)

    def estimate_block(rows: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        query = Query.read(rows["steps"].to_pylist(), rows["dims"][0].as_py())
        near = _near(query, codes, rows["factor"].to_numpy(), sides_of(rows["own"].to_numpy(), rows["lo"][0].as_py(), rows["hi"][0].as_py()), threshold, sure)
        return rows.select(near_schema.names).filter(pa.array(near)).cast(near_schema)

    block = ["label", "dims", "t", "key", "lo", "hi"]
    slim = spread.select(*block, "own", "rep", "code", "factor", "steps").groupBy(*block).applyInArrow(estimate_block, "label string, dims int, t int, key long, lo int, hi int, own int, rep long")
    spread = slim.join(coded.select("label", "dims", "rep", "n", "vector", "keys", "code", "factor"), ["label", "dims", "rep"])

    found_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        table, lo, hi = rows["t"][0].as_py(), rows["lo"][0].as_py(), rows["hi"][0].as_py()
        block = _block(rows)
        own = rows["own"].to_numpy()
        sides = sides_of(own, lo, hi)
        parts = [None if s is None else {k: v[s] for k, v in block.items()} for s in sides]
        count = np.zeros(len(own), np.int64)
        pairs = []
        for i, j in _links(parts[0], parts[1], threshold, sure):
            i, j = sides[0][i], (sides[0] if lo == hi else sides[1])[j]
            if table:  # met in an earlier table: counted there
                fresh = ~(block["keys"][i, :table] == block["keys"][j, :table]).any(1)
                i, j = i[fresh], j[fresh]
            np.add.at(count, i, block["n"][j])
            np.add.at(count, j, block["n"][i])
            pairs.append((i, j))
        if not pairs:
            return pa.table({"a": [], "b": [], "links": []}, schema=found_schema)
        _, forest = _forest(len(own), zip(np.concatenate([p[0] for p in pairs]).tolist(), np.concatenate([p[1] for p in pairs]).tolist(), strict=True))
        ids, linked = block["id"], np.flatnonzero(count)
        a = np.concatenate([ids[linked], ids[[i for i, _ in forest]]]) if forest else ids[linked]
        b = np.concatenate([ids[linked], ids[[j for _, j in forest]]]) if forest else ids[linked]
        return pa.table({"a": a, "b": b, "links": np.concatenate([count[linked], np.zeros(len(forest), np.int64)])}, schema=found_schema)

    got = checkpointed(spread.select("label", "dims", "t", "key", "lo", "hi", "own", "rep", "n", "vector", "keys", "code", "factor").groupBy("label", "dims", "t", "key", "lo", "hi").applyInArrow(compare, "a long, b long, links long"))
    counts = got.groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(got.filter("a <> b"))
    by_rep = reps.join(counts, reps["rep"] == counts["a"], "left").join(parts, reps["rep"] == parts["node"], "left")
    by_rep = by_rep.select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind))).join(by_rep, ["label", "vector"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept")
    )
