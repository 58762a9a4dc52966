"""Best-fit packing by sums of squares: each piece goes where the squared counts of open sequences per residual gap become smallest."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.llm._spark import only, sliced
from interlake.llm.tokens import encode

SHARD = 16384  # pieces that one packing task gets, about


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed longest first.

    With N[g] the number of open bins of gap g, an item of length s that goes into a gap g >= s
    changes the sum of squares by 1 - 2 N[g], and by 2 N[g - s] + 1 more unless it fills the bin;
    the smallest change wins, of equal ones the smallest gap. A bin is opened only if none has
    room: that takes fewer bins than letting a new one compete (README). Lengths are 1 to capacity.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        after = 2 * count[: capacity - s + 1] + 1  # by the gap that stays
        after[0] = 0
        change = np.where(count[s:] > 0, after + 1 - 2 * count[s:], np.iinfo(np.int64).max)
        gap = int(change.argmin()) + s
        if count[gap] == 0:
            gap, b = capacity, bins
            bins += 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        which[i], offset[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return which, offset


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `most`, but the first may be shorter."""
    first = n % most or most
    return [(0, min(first, n)), *((at, most) for at in range(first, n, most))]


def tokenized_pieces(docs: DataFrame, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", most: int = 1024, end_id: int | None = 2, id_bytes: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text; null is empty; a document without ids gives no piece.

    id_bytes: 2 or 4 adds the ids themselves, as little-endian numbers of so many bytes.
    """
    base = only(docs, doc_id=doc_id, text=text)
    kind = base.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * bool(id_bytes)
    arrow = pa.schema(fields)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches):
        for batch in sliced(batches):
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            ids, offsets = encode(texts, tokenizer, added=True)
            rows = []
            for i, key in enumerate(keys):
                own = np.concatenate([ids[offsets[i] : offsets[i + 1]], tail])
                for k, (start, length) in enumerate(cut(len(own), most) if len(own) else []):
                    part = own[start : start + length]
                    rows.append((key, k, start, length, zlib.crc32(part.astype("<u4").tobytes()), *([_as_bytes(part, id_bytes)] if id_bytes else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return base.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * bool(id_bytes))


def _as_bytes(ids: np.ndarray, id_bytes: int) -> bytes:
    if id_bytes == 2 and len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("an id needs more than two bytes: take id_bytes=4")
    return ids.astype(f"<u{id_bytes}").tobytes()


def expected_pieces(docs: DataFrame, *, text: str = "text", most: int = 1024) -> int:
    """About how many pieces the documents give: one each, and one more for every `most` * 4 bytes; exact to the byte, so the same on every run."""
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(f"`{text}`"))).alias("bytes")).first()
    return got["n"] + (got["bytes"] or 0) // (4 * most)


def pack(pieces: DataFrame, *, n_rows: int, capacity: int = 1024, shard: int = SHARD, number_copies: bool = False) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...).

    Pieces are dealt to ceil(n_rows / shard) tasks by a hash of document, piece and contents;
    each packs its own. n_rows is the number of pieces, or an estimate of it (expected_pieces()): it sets
    the tasks' size, not the result's wholeness. Sequence ids are the
    task's number * 2^32 + a count, so every sequence belongs to one task. The rows don't depend on
    the order in which they arrive. All columns of `pieces` stay. With number_copies equal pieces of a
    document that stands in the table several times get the numbers 0, 1, ... in a column `copy`.
    """
    shards = max(1, -(-n_rows // shard))
    columns = pieces.columns
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(shards)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long" + ", copy int" * number_copies

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        which, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = int(key[0]) * (1 << 32) + which, offset
        if number_copies:
            rows["copy"] = rows.groupby(["doc_id", "piece", "ids_crc32"], dropna=False).cumcount().astype("int32")
        return rows[[*columns, "sequence_id", "offset", *(["copy"] * number_copies)]]

    return dealt.groupBy("_shard").applyInPandas(fit, schema)
