"""Line dedup: Bloom filters of lines seen once and twice; only suspected repeats shuffle for exact confirmation."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from interlake.llm._spark import by_batch, checkpointed, only, sliced

BLANKS = b" \t\n\x0b\x0c\r"
_PIECE = 1 << 16  # bytes of a filter that travel together
LEAST_BITS, MOST_BITS = 16, 28  # of a filter; a filter of 2^28 bits takes 32 MB


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The text's lines and their keys: blanks stripped at both ends, A-Z lower-cased."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip(BLANKS).lower() for x in lines]


def digest(key: bytes) -> bytes:
    """128 bits that stand for a key."""
    return xxhash.xxh3_128_digest(key)


def _document_digests(text: str | None, least: int) -> list[bytes]:
    """Digests of the distinct keys of a text with at least `least` code points."""
    return [digest(k) for k in {k for k in line_keys(text)[1] if _long_enough(k, least)}]


def _long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least `least` code points."""
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


def _first_lines(text: str | None, least: int) -> list[tuple[bytes, int]]:
    """_document_digests() with the first line of each key."""
    first: dict[bytes, int] = {}
    for n, k in enumerate(line_keys(text)[1]):
        if _long_enough(k, least):
            first.setdefault(k, n)
    return [(digest(k), n) for k, n in first.items()]


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """Two places in a filter of 2^bits bits for each digest."""
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return (halves >> np.uint64(64 - bits)).astype(np.int64)


def _are_set(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for the rows of `at` whose bits are all set."""
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(1)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    if len(at):
        at = np.sort(at)
        byte = at >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        packed[byte[first]] |= np.bitwise_or.reduceat(np.uint8(128) >> (at & 7).astype(np.uint8), first)


class TwoFilters:
    """Keys seen once, and keys seen again while in the first filter."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = (np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(2))

    def add(self, digests: list[bytes]) -> None:
        """Add the distinct keys of one document or of several, each with its repeats."""
        if not digests:
            return
        at = _places(digests, self.bits)
        rows = np.frombuffer(b"".join(digests), "V16")
        _, first = np.unique(rows, return_index=True)
        again = np.ones(len(rows), bool)
        again[first] = False
        again |= _are_set(self.once, at)
        _set(self.twice, at[again].ravel())
        _set(self.once, at.ravel())

    def pieces(self):
        """(piece number, packed and compressed bits of both filters), for pieces that aren't empty."""
        once, twice = self.once, self.twice
        for i in range(0, len(once), _PIECE):
            if once[i : i + _PIECE].any():
                yield i // _PIECE, zlib.compress(once[i : i + _PIECE].tobytes(), 1), zlib.compress(twice[i : i + _PIECE].tobytes(), 1)


def fitting_bits(docs: DataFrame, text: str) -> int:
    """A filter's size, as a power of two: 16 bits a line, MOST_BITS at most, so that it can go to every task.

    Beyond 2^24 lines the filter fills up and lets more lines pass as suspects; at some 2^28 nearly all do. Each suspect
    is counted exactly, after summing up within tasks, so a full filter costs a shuffle of 16 bytes a line, never a result.
    """
    t = F.col(f"`{text}`")
    lines = docs.agg(F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, lines)))))


def repeat_filter(keys_of, df: DataFrame, column: str, bits: int) -> DataFrame:
    """Pieces of the filter of keys seen at least twice (with false positives, never a miss).

    Each task fills its own two filters; two tasks' filters meet as once = a | b and
    twice = a2 | b2 | (a & b), which holds every key that both have seen.
    """
    made = pa.schema([("piece", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def fill(batches):
        own = TwoFilters(bits)
        for batch in sliced(batches, 4096):
            waiting: list[bytes] = []
            for value in batch.column(0).to_pylist():
                waiting += keys_of(value)
                if len(waiting) > 200_000:
                    own.add(waiting)
                    waiting = []
            own.add(waiting)
        rows = list(own.pieces())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

    def merge(table: pa.Table) -> pa.Table:
        once = twice = None
        for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if once is None:
                once, twice = a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
        return pa.table({"piece": table["piece"].slice(0, 1), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})

    parts = df.select(column).mapInArrow(fill, "piece int, once binary, twice binary")
    return parts.groupBy("piece").applyInArrow(merge, "piece int, twice binary")


def collect_filter(pieces: DataFrame, bits: int) -> bytes:
    """The filter's 2^bits / 8 bytes at most, compressed: a size that the data can't change."""
    full = bytearray(max(1, (1 << bits) // 8))
    for row in pieces.toLocalIterator():
        part = zlib.decompress(row["twice"])
        full[row["piece"] * _PIECE : row["piece"] * _PIECE + len(part)] = part
    return zlib.compress(bytes(full), 1)


class Suspects:
    """Tests digests against a broadcast filter, which each task unpacks once."""

    def __init__(self, broadcast, bits: int):
        self.broadcast, self.bits = broadcast, bits
        self.packed: np.ndarray | None = None

    def __call__(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        if self.packed is None:
            self.packed = np.frombuffer(zlib.decompress(self.broadcast.value), np.uint8)
        at = _places(digests, self.bits)
        return _are_set(self.packed, at)


def _ids_repeat(docs: DataFrame, column: str) -> bool:
    """Whether a value of the column other than null stands in several rows: ids alone shuffle."""
    return not docs.select(column).filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").isEmpty()


def hot_keys(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, filter_bits: int | None = None, order: str | None = None, doc_id: str | None = None) -> DataFrame:
    """Digests of the keys that at least min_docs documents hold, counted exactly among the suspects.

    Rows of one doc_id are one document; rows of null doc_id, and all rows without doc_id given, are documents of their own. Where no
    doc_id repeats, keys are summed up within tasks; else (key, doc_id) pairs are told apart first, spread by both.
    Returns (key binary, n long), and with `order` also the key's first place: at (the least value of that
    column) and line. With min_docs 1 every key counts and no filter is needed.
    """
    spark = docs.sparkSession
    docs = only(docs, text=text, **({"at": order} if order else {}), **({"doc": doc_id} if doc_id else {}))
    suspects = None
    if min_docs > 1:
        filter_bits = filter_bits or fitting_bits(docs, "text")
        pieces = repeat_filter(lambda t: _document_digests(t, min_chars), docs, "text", filter_bits)
        suspects = Suspects(spark.sparkContext.broadcast(collect_filter(pieces, filter_bits)), filter_bits)
    by_doc = doc_id is not None and min_docs > 1 and _ids_repeat(docs, "doc")
    names = ["key", *(["at", "line"] if order else []), *(["doc"] if by_doc else [])]

    def emit(batch):
        ids = batch.column(batch.schema.get_field_index("doc")).to_pylist() if by_doc else [None] * batch.num_rows
        places = batch.column(batch.schema.get_field_index("at")).to_pylist() if order else [None] * batch.num_rows
        out = []
        for value, at, own in zip(batch.column(0).to_pylist(), places, ids, strict=True):
            found = _first_lines(value, min_chars) if order else [(d, 0) for d in _document_digests(value, min_chars)]
            yes = [True] * len(found) if suspects is None else suspects([d for d, _ in found])
            out += [(d, *((at, n) if order else ()), *((own,) if by_doc else ())) for (d, n), y in zip(found, yes, strict=True) if y]
        return dict(zip(names, zip(*out, strict=True), strict=True)) if out else None

    fields = [("key", pa.binary())] + ([("at", _arrow_type(docs, "at")), ("line", pa.int32())] if order else []) + ([("doc", _arrow_type(docs, "doc"))] if by_doc else [])
    listed = "key binary" + (f", at {docs.schema['at'].dataType.simpleString()}, line int" if order else "") + (f", doc {docs.schema['doc'].dataType.simpleString()}" if by_doc else "")
    found = docs.mapInArrow(by_batch(emit, pa.schema(fields)), listed)
    first = [F.min(F.struct("at", "line")).alias("first")] if order else []
    if by_doc:  # rows without an id count each
        pairs = found.groupBy("key", "doc").agg(F.count(F.lit(1)).alias("rows"), *first)
        first = [F.min("first").alias("first")] if order else []
        counted = pairs.groupBy("key").agg(F.sum(F.when(F.col("doc").isNull(), F.col("rows")).otherwise(1)).alias("n"), *first)
    else:
        counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *first)
    hot = counted.filter(F.col("n") >= min_docs)
    return hot.select("key", "n", "first.at", "first.line") if order else hot.select("key", "n")


def rewrite(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars", min_docs: int = 10, min_chars: int = 1, filter_bits: int | None = None, broadcast_keys: int = 1 << 19, first_by: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """The same rows and columns with the text that drop_lines() keeps and its number of characters; a null text stays null."""
    others = [c for c in docs.columns if c != text]
    row = F.struct(F.col(f"`{text}`").isNull().alias("empty"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), *([F.col(f"`{first_by}`").alias("at")] if first_by else []), *([F.col(f"`{doc_id}`").alias("doc")] if doc_id in docs.columns else []))
    kept = drop_lines(
        packed, doc_id="row", text="text", min_docs=min_docs, min_chars=min_chars, filter_bits=filter_bits, broadcast_keys=broadcast_keys, first_by="at" if first_by else None, count_by="doc" if doc_id in docs.columns else None
    )
    new = F.when(~F.col("doc_id.empty"), F.col("kept"))
    made = {text: new, n_chars: F.length(new).cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {text: new}
    return kept.select(*[(made[c] if c in made else F.col(f"doc_id.c{others.index(c)}")).alias(c) for c in docs.columns])


def drop_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, filter_bits: int | None = None, broadcast_keys: int = 1 << 19, first_by: str | None = None, count_by: str | None = None
) -> DataFrame:
    """Drop every line whose key at least `min_docs` documents hold, in all of them; with first_by, its first occurrence
    (least value of that column, then first line) stays, in each row of that value.

    Returns (doc_id, n_lines, n_dropped, kept) of every row. Documents are the different values of `count_by` (doc_id if not given);
    rows where that is null count each. A null text is one empty line and gives the kept text ''. Keys shorter than min_chars stay.
    Other columns play no part. The hot keys go out by broadcast if there are `broadcast_keys` at
    most (16 bytes each); else the lines' digests are joined with them, and each document's
    line numbers come back to it by a join.
    """
    spark = docs.sparkSession
    hot = checkpointed(hot_keys(docs, text=text, min_docs=min_docs, min_chars=min_chars, filter_bits=filter_bits, order=first_by, doc_id=count_by or (None if isinstance(docs.schema[doc_id].dataType, StructType) else doc_id)).drop("n"))
    base = only(docs, doc_id=doc_id, text=text, **({"at": first_by} if first_by else {}))
    id_type = base.schema["doc_id"].dataType.simpleString()
    some = hot.limit(broadcast_keys + 1).collect()
    schema = f"doc_id {id_type}, n_lines long, n_dropped long, kept string"
    arrow = pa.schema([("doc_id", _arrow_type(base)), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
    if len(some) <= broadcast_keys:
        known = spark.sparkContext.broadcast({bytes(r["key"]): (r["at"], r["line"]) if first_by else None for r in some})

        def cut(batch):
            hot_here = known.value
            rows = []
            for value, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist() if first_by else [None] * batch.num_rows, strict=True):
                lines, keys = line_keys(value)
                rows.append(_without(lines, [bool(k) and hot_here.get(digest(k), (at, n)) != (at, n) for n, k in enumerate(keys)]))
            return {"doc_id": batch.column(0), "n_lines": [r[0] for r in rows], "n_dropped": [r[1] for r in rows], "kept": [r[2] for r in rows]}

        return base.mapInArrow(by_batch(cut, arrow), schema)

    def number(batch):
        ids, keys, at, own = [], [], [], []
        for i, value, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist() if first_by else [None] * batch.num_rows, strict=True):
            for n, k in enumerate(line_keys(value)[1]):
                if k:
                    ids.append(i)
                    keys.append(digest(k))
                    at.append(n)
                    own.append(place)
        return {"doc_id": ids, "key": keys, "line": at, "own": own} if ids else None

    fields = [("doc_id", arrow.field("doc_id").type), ("key", pa.binary()), ("line", pa.int32())] + ([("own", _arrow_type(base, "at"))] if first_by else [])
    listed = f"doc_id {id_type}, key binary, line int" + (f", own {base.schema['at'].dataType.simpleString()}" if first_by else "")
    lines = base.mapInArrow(by_batch(number, pa.schema(fields)), listed)
    if first_by:
        met = lines.join(hot.withColumnRenamed("line", "first_line"), "key")
        dropped = met.filter(~(F.col("own").eqNullSafe(F.col("at")) & (F.col("line") == F.col("first_line"))))
        gone = dropped.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    else:
        gone = lines.join(hot, "key").groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    both = base.join(gone, base["doc_id"].eqNullSafe(gone["doc_id"]), "left").select(base["doc_id"], "text", "gone")

    def cut_listed(batch):
        rows = []
        for value, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines, keys = line_keys(value)
            listed = frozenset(gone or ())
            rows.append(_without(lines, [n in listed if first_by else bool(k) and digest(k) in listed for n, k in enumerate(keys)]))
        return {"doc_id": batch.column(0), "n_lines": [r[0] for r in rows], "n_dropped": [r[1] for r in rows], "kept": [r[2] for r in rows]}

    return both.mapInArrow(by_batch(cut_listed, arrow), schema)


def _without(lines: list[bytes], drop: list[bool]) -> tuple[int, int, str]:
    kept = [x for x, gone in zip(lines, drop, strict=True) if not gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")


def _arrow_type(df: DataFrame, column: str = "doc_id") -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1, filter_bits: int | None = None) -> DataFrame:
    """Keep only the first occurrence of each repeated key: smallest doc_id, then first line.

    Returns (doc_id, n_lines, n_dropped, kept). doc_id must be unique; ties within a document keep the earlier line. Rows
    without a doc_id keep all their lines.
    """
    base = only(docs, doc_id=doc_id, text=text)
    id_type = base.schema["doc_id"].dataType.simpleString()
    arrow_id = _arrow_type(base)

    def number(batch):
        ids, keys, at = [], [], []
        for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for n, k in enumerate(line_keys(value)[1]):
                if _long_enough(k, min_chars):
                    ids.append(i)
                    keys.append(digest(k))
                    at.append(n)
        return {"doc_id": ids, "key": keys, "line": at} if ids else None

    filter_bits = filter_bits or fitting_bits(base, "text")
    pieces = repeat_filter(lambda t: [digest(k) for k in line_keys(t)[1] if _long_enough(k, min_chars)], base, "text", filter_bits)
    suspects = Suspects(docs.sparkSession.sparkContext.broadcast(collect_filter(pieces, filter_bits)), filter_bits)

    def suspect(batch):
        found = number(batch)
        if found is None:
            return None
        yes = suspects(found["key"])
        return {k: [x for x, y in zip(v, yes, strict=True) if y] for k, v in found.items()}

    lines = base.mapInArrow(by_batch(suspect, pa.schema([("doc_id", arrow_id), ("key", pa.binary()), ("line", pa.int32())])), f"doc_id {id_type}, key binary, line int")
    first = lines.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    later = lines.join(first, "key").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line")))
    gone = later.groupBy("doc_id").agg(F.collect_list("line").alias("gone"))
    both = base.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    arrow = pa.schema([("doc_id", arrow_id), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def cut(batch):
        rows = []
        for value, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines, _ = line_keys(value)
            listed = frozenset(gone or ())
            rows.append(_without(lines, [i in listed for i in range(len(lines))]))
        return {"doc_id": batch.column(0), "n_lines": [r[0] for r in rows], "n_dropped": [r[1] for r in rows], "kept": [r[2] for r in rows]}

    return both.mapInArrow(by_batch(cut, arrow), f"doc_id {id_type}, n_lines long, n_dropped long, kept string")
