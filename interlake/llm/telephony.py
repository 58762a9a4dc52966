"""Telephony audio columns: mu-law and A-law by tables, block ADPCM across blocks, resampled PCM.

The stored form is a RIFF/WAVE file whose data chunk holds the code bytes as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from interlake.llm._spark import by_batch, only

# WAVE format tags, the published IMA ADPCM index changes, first and last step sizes.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17
INDEX_CHANGE = (-1, -1, -1, -1, 2, 4, 6, 8)
ADPCM_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
RATE, BLOCK = 8000, 288
NAMES = {A_LAW: "alaw", MU_LAW: "ulaw", IMA_ADPCM: "adpcm"}


@lru_cache(1)
def mu_law_table() -> np.ndarray:
    """16-bit sample of each mu-law code (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@lru_cache(1)
def a_law_table() -> np.ndarray:
    """16-bit sample of each A-law code (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


@lru_cache(1)
def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the prediction, and next step index, for every (step index, nibble)."""
    step = np.array(ADPCM_STEPS)[:, None]
    nibble = np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    change = np.where(nibble & 8, -size, size).astype(np.int32)
    after = np.clip(np.arange(len(ADPCM_STEPS))[:, None] + np.array(INDEX_CHANGE)[nibble & 7], 0, len(ADPCM_STEPS) - 1)
    return change.ravel(), (after * 16).astype(np.int16).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (n, bytes): one step at a time, all blocks at once.

    A block starts with its first sample, its step index and a spare byte; a step index
    beyond the table counts as its last. Nibbles follow, the low one of each byte first.
    """
    change, after = _adpcm_tables()
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    now = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], len(ADPCM_STEPS) - 1).astype(np.int16) * np.int16(16)
    out[0] = now
    body = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int16)
    for k, byte in enumerate(body):
        for j, nibble in enumerate((byte & 15, byte >> 4)):
            key = at + nibble
            now += change[key]
            np.clip(now, -32768, 32767, out=now)
            at = after[key]
            out[1 + 2 * k + j] = now
    return out.T


def resample(pcm: np.ndarray, up: int = 2) -> np.ndarray:
    """PCM at `up` times the rate, straight lines between samples; the last sample holds."""
    if not len(pcm):
        return pcm
    a = pcm.astype(np.int32)
    b = np.append(a[1:], a[-1])
    return np.stack([(a * (up - i) + b * i) // up for i in range(up)], 1).ravel().astype(np.int16)


def wave(data: bytes, tag: int, *, rate: int = RATE, block: int = BLOCK) -> bytes:
    """The stored form: a mono WAVE file with these code bytes as its data chunk."""
    if tag == IMA_ADPCM:
        per = 1 + 2 * (block - 4)
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    pad = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(media) and (fmt is None or data is None):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        chunk = media[at + 8 : at + 8 + size]
        if name == b"fmt ":
            fmt = chunk
        elif name == b"data":
            data = chunk
        at += 8 + size + (size & 1)
    if fmt is None or data is None:
        raise ValueError("no fmt or no data chunk")
    tag, channels, rate, _, block = struct.unpack_from("<HHIIH", fmt)
    if channels != 1:
        raise ValueError("only mono files are read")
    return tag, rate, block, data


def expand(files: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """PCM of (tag, block size, data): tables for the companded ones, all ADPCM blocks of one size together."""
    out: list = [None] * len(files)
    by_block: dict[int, list[int]] = {}
    for i, (tag, block, data) in enumerate(files):
        if tag == IMA_ADPCM:
            by_block.setdefault(block, []).append(i)
        elif tag in (A_LAW, MU_LAW):
            out[i] = (mu_law_table() if tag == MU_LAW else a_law_table())[np.frombuffer(data, np.uint8)]
        else:
            raise ValueError(f"unknown WAVE format {tag}")
    for block, rows in by_block.items():
        if block <= 4 or any(len(files[i][2]) % block for i in rows):
            raise ValueError(f"ADPCM data that aren't whole blocks of {block} bytes")
        counts = [len(files[i][2]) // block for i in rows]
        pcm = decode_adpcm(np.frombuffer(b"".join(files[i][2][: k * block] for i, k in zip(rows, counts, strict=True)), np.uint8).reshape(-1, block))
        at = 0
        for i, k in zip(rows, counts, strict=True):
            out[i] = pcm[at : at + k].ravel()
            at += k
    return out


def describe(pcm: np.ndarray, name: str, rate: int) -> str:
    """Duration in samples, mean square, peak and sign changes, from whole numbers only."""
    wide = pcm.astype(np.int64)
    square = int(wide @ wide) // max(1, len(pcm))
    peak = int(max(-wide.min(), wide.max())) if len(pcm) else 0
    return f"{name};rate={rate};n={len(pcm)};ms={square};peak={peak};zc={int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"


def store_payloads(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: int = 576, fill: int = 255) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 (null: empty), filled up to a positive multiple of `unit`, as a WAVE file.

    The codec goes by the payload, its CRC-32 modulo 3: mu-law, A-law or ADPCM blocks; so equal texts have equal files.
    """
    base = only(docs, doc_id=doc_id, text=text)
    kinds = (MU_LAW, A_LAW, IMA_ADPCM)

    def store(batch):
        sizes, media = [], []
        for value in batch.column(1).to_pylist():
            data = (value or "").encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            data += bytes([fill]) * (unit - len(data) % unit if len(data) % unit or not data else 0)
            media.append(wave(data, kinds[zlib.crc32(data) % 3]))
        return {"doc_id": batch.column(0), "n_bytes": sizes, "media": media}

    kind = base.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return base.mapInArrow(by_batch(store, schema), f"doc_id {kind.simpleString()}, n_bytes long, media binary")


def decode_media(df: DataFrame, *, key: str = "doc_id", media: str = "media", up: int = 2, with_pcm: bool = True, digests: bool = False) -> DataFrame:
    """(key, rate, pcm binary: 16-bit little-endian at `up` times the rate, feature) of every media file; with digests also those of file and payload.

    Null media give nulls. A file that isn't a mono WAVE file of a known format with whole blocks fails the job.
    """
    base = only(df, key=key, media=media)
    kind = base.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(key, to_arrow_type(kind)), ("rate", pa.int32()), ("feature", pa.string())]
    fields += [("pcm", pa.binary())] * with_pcm
    fields += [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())] * digests
    schema = pa.schema(fields)

    def decode(keys, files):
        parsed = [parse_wave(m) for m in files]
        pcm = [resample(x, up) for x in expand([(tag, block, data) for tag, _, block, data in parsed])]
        out = {key: keys, "rate": [p[1] * up for p in parsed], "feature": [describe(x, NAMES[p[0]], p[1] * up) for x, p in zip(pcm, parsed, strict=True)]}
        if with_pcm:
            out["pcm"] = [x.astype("<i2").tobytes() for x in pcm]
        if digests:
            data = [p[3] for p in parsed]
            out |= {"payload_bytes": [len(d) for d in data], "payload_sha256": [hashlib.sha256(d).hexdigest() for d in data], "tail_crc32": [zlib.crc32(d[-32:]) for d in data], "media_bytes": [len(m) for m in files], "media_sha256": [hashlib.sha256(m).hexdigest() for m in files]}
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    def run(batches):
        for batch in batches:
            keys, files = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            gone = [k for k, m in zip(keys, files, strict=True) if m is None]
            if gone:
                yield pa.RecordBatch.from_arrays([pa.array(gone if f.name == key else [None] * len(gone), type=f.type) for f in schema], schema=schema)
            held, size = [], 0
            for k, m in zip(keys, files, strict=True):
                if m is not None:
                    held.append((k, m))
                    size += len(m)
                if size > 1 << 22:
                    yield decode(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield decode(*map(list, zip(*held, strict=True)))

    ddl = f"`{key}` {kind.simpleString()}, rate int, feature string" + ", pcm binary" * with_pcm + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string" * digests
    return base.mapInArrow(run, ddl)
