"""Token-id files: independent zstandard frames, per-frame checksums and a trailing seek table.

Layout of a file: data frames, each with the ids of some whole documents; a skippable frame with
the document index; a skippable frame with the seek table, as in the published Zstandard seekable
format (compressed size, decompressed size and checksum of every frame, then a footer). A reader
takes the tail, finds a document's frame and decompresses that frame only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interlake.llm._spark import checkpointed, new_folder, only, sliced
from interlake.llm.tokens import encode

# Fixed values of the published formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

_HEAD = struct.Struct("<4sBxxxQQ")  # of the index: magic, bytes an id, documents, frames
_MAGIC = b"ILT1"


class Writer:
    """Writes one file. Documents come in order; a frame closes once it has frame_bytes."""

    def __init__(self, sink, *, id_bytes: int = 2, frame_bytes: int = 1 << 18, level: int = 3):
        self.sink, self.id_bytes, self.frame_bytes = sink, id_bytes, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []  # (doc_id, frame, ids)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if self.id_bytes == 2 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("an id needs more than two bytes: write with id_bytes=4")
        data = ids.astype(f"<u{self.id_bytes}").tobytes()
        self.docs.append((doc_id, len(self.frames), len(ids)))
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.held)
        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        docs = np.array(self.docs, "<i8").reshape(-1, 3)
        index = _HEAD.pack(_MAGIC, self.id_bytes, len(docs), len(self.frames)) + zstandard.ZstdCompressor(level=3).compress(docs.T.tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # The index frame is part of the table, so that offsets add up.
        table = [*self.frames, (len(index) + 8, 0, 0)]
        seek = b"".join(struct.pack("<III", *f) for f in table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class Reader:
    """Reads single documents of a file, or all, through its tail."""

    def __init__(self, source, size: int):
        self.source = source
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        rows = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.plain, self.sums = rows[:-1].T if count > 1 else (np.zeros(0, np.int64),) * 3
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self._at(int(self.offsets[-1]) + 8, int(rows[-1, 0]) - 8)
        mark, self.id_bytes, n, _ = _HEAD.unpack(index[: _HEAD.size])
        if mark != _MAGIC:
            raise ValueError("no document index before the seek table")
        docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(index[_HEAD.size :], max_output_size=max(1, n * 24)), "<i8").reshape(3, -1)
        self.doc_ids, self.frame, self.n_ids = docs
        self.start = np.concatenate([[0], np.cumsum(self.n_ids)])[:-1]
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(self.sizes[k])), max_output_size=max(1, int(self.plain[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"checksum of frame {k} is wrong")
            self.last = (k, data)
        return self.last[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        k = self.frame[i]
        first = np.searchsorted(self.frame, k, "left")
        before = int(self.start[i] - self.start[first]) * self.id_bytes
        return np.frombuffer(self._frame(int(k)), f"<u{self.id_bytes}", int(self.n_ids[i]), before)


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2, id_bytes: int = 2, partitions: int | None = None, level: int = 3) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest (file, part, n_docs, n_tokens).

    Null texts are empty and have the end id alone. Null doc_ids are written as the smallest long,
    first. A range of ids goes to each task, which writes one file under a temporary
    name and renames it, so an attempt that dies leaves nothing that counts and a repeated one
    replaces its own file. Rows of equal doc_id go by a hash of their text, within files and across them, equal hashes by text.
    """
    base = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ranged = base.repartitionByRange(partitions, *keys) if partitions else base.repartitionByRange(*keys)
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        system, root = _open(folder)
        writer = sink = None
        name, trial = f"{root}/part-{part:06d}.zst", f"{root}/.part-{part:06d}.{attempt}"
        n_docs = n_tokens = 0
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if texts and writer is None:
                system.create_dir(root, recursive=True)
                sink = system.open_output_stream(trial)
                writer = Writer(sink, id_bytes=id_bytes, level=level)
            ids, offsets = encode(texts, tokenizer, added=True)
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = np.concatenate([ids[offsets[i] : offsets[i + 1]], tail])
                writer.add(key, own)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(own)
        if writer is not None:
            writer.close()
            sink.close()
            system.move(trial, name)
            yield pa.RecordBatch.from_pydict({"file": [f"part-{part:06d}.zst"], "part": [part], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=schema)

    return ranged.sortWithinPartitions(*keys, F.col("text")).mapInArrow(run, "file string, part int, n_docs long, n_tokens long")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files that the manifest names.

    start counts the ids of all documents before, over all files in order; the manifest has a row
    per file (some hundred thousand at 100 TB), and that is all that one task sums up. Files are
    dealt out by ranges, one a task, so that reading is as wide as writing was.
    """
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).alias("base"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] * with_ids)]
    schema = pa.schema(fields)

    def run(batches):
        system, root = _open(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{file}"
                with system.open_input_file(path) as source:
                    reader = Reader(source, system.get_file_info(path).size)
                    for first in range(0, len(reader.doc_ids), 4096):
                        rows = range(first, min(first + 4096, len(reader.doc_ids)))
                        ids = [reader.ids(i).astype("<u4") for i in rows]
                        out = {"doc_id": reader.doc_ids[rows.start : rows.stop], "start": base + reader.start[rows.start : rows.stop], "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                        if with_ids:
                            out["ids"] = [x.astype(np.int32) for x in ids]
                        yield pa.RecordBatch.from_pydict(out, schema=schema)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.repartitionByRange(max(1, manifest.count()), "file").mapInArrow(run, ddl)


def round_trip(docs: DataFrame, *, tokenizer: str, **options) -> DataFrame:
    """Write all documents to a fresh shared folder and read them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    manifest = checkpointed(write_tokens(docs, folder, tokenizer=tokenizer, **options))
    return read_tokens(spark, folder, manifest)
