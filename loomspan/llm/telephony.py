"""Media columns: telephony audio. WAV in, WAV out, with mu-law, A-law and IMA ADPCM expanded to 16-bit PCM.

`to_media` wraps bytes losslessly as one of the three telephony codings (8 kHz, mono). `decode` reads a WAV column back:
companded samples expand by a 256-entry lookup table, ADPCM blocks are decoded together, numpy working across blocks
with one step per sample position, so the step count is the block's length and not the audio's. `resample` changes the
rate by linear interpolation on an exact integer grid. `pcm_column` adds the resampled PCM, and `store` writes both columns
to a table in the shared folder. PCM is stored as one predict step of the reversible 5/3 lifting transform (`lifted`):
samples of even number, then what the others differ from the mean of their neighbours, which is little in smooth signals.

Null bytes count as empty. An empty payload has no samples. A column that is no WAV of these codings gives null. A
last partial ADPCM block is kept as bytes and decoded as far as it goes. Long values are worked on one at a time. Repeated
rows give the same value each; an empty table gives an empty result; further columns are not touched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import common as C

#: WAV format tags.
ALAW, MULAW, ADPCM = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "adpcm"}
RATE, BLOCK = 8000, 192

#: Fixed values of IMA ADPCM: index changes by nibble.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)


def _steps() -> np.ndarray:
    """The 89 quantiser steps of the public IMA ADPCM specification (fixed values)."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
        230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024,
        3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086,
        29794, 32767,
    ], np.int64)


STEPS = _steps()


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits; sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; sign (set: positive), 3-bit exponent, 4-bit mantissa."""
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, a & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: (n, block bytes) to (n, samples). All blocks advance together, one nibble at a time."""
    n, width = blocks.shape
    if width < 4:
        return np.zeros((n, 0), np.int16)
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    moves = _adpcm_moves()
    change = INDEX_CHANGE.astype(np.int32)
    for k in range(width - 4):
        for j, nibble in enumerate((body[k] & 15, body[k] >> 4)):
            value += moves[index * 16 + nibble]
            np.clip(value, -32768, 32767, out=value)
            index += change[nibble]
            np.clip(index, 0, 88, out=index)
            out[1 + 2 * k + j] = value
    return out.T


def _adpcm_moves() -> np.ndarray:
    """What a nibble adds to the predictor, for each of the 89 steps."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    move = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    return np.where(nibble & 8, -move, move).astype(np.int32).ravel()


def wav(payload: bytes, coding: int, block: int = BLOCK) -> bytes:
    """A RIFF file whose data chunk is exactly the payload (plus RIFF's pad byte for odd sizes)."""
    align = block if coding == ADPCM else 1
    per_block = 1 + 2 * (block - 4)
    rate = RATE * block // per_block if coding == ADPCM else RATE
    extra = struct.pack("<HH", 2, per_block) if coding == ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", coding, 1, RATE, rate, align, 4 if coding == ADPCM else 8) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview] | None:
    """(coding, rate, block size, data) of a WAV in a telephony coding, else None."""
    media = memoryview(media)
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, size = bytes(media[at : at + 4]), struct.unpack_from("<I", media, at + 4)[0]
        chunk = media[at + 8 : at + 8 + size]
        if kind == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", chunk)
        if kind == b"data" and fmt:
            return (fmt[0], fmt[2], fmt[4], chunk) if fmt[0] in NAMES and fmt[1] == 1 and len(chunk) == size else None
        at += 8 + size + (size & 1)
    return None


def decode(media: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """(rate, int16 samples) of each WAV. All ADPCM blocks of one size in the list are decoded in one go."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(media)
    waiting: dict[int, list[tuple[int, int, memoryview]]] = {}
    for i, m in enumerate(media):
        if m is None or (found := parse_wav(m)) is None:
            continue
        coding, rate, align, data = found
        if coding != ADPCM:
            out[i] = rate, TABLES[coding][np.frombuffer(data, np.uint8)]
        elif align >= 4:
            out[i] = rate, np.zeros(0, np.int16)
            whole = len(data) // align * align
            waiting.setdefault(align, []).append((i, rate, data[:whole]))
            if whole < len(data):
                waiting.setdefault(-(len(data) - whole), []).append((i, rate, data[whole:]))
    for align in sorted(waiting, reverse=True):
        parts = [p for p in waiting[align] if len(p[2])]
        if not parts:
            continue
        samples = decode_adpcm(np.concatenate([np.frombuffer(p[2], np.uint8) for p in parts]).reshape(-1, abs(align)))
        at = 0
        for i, rate, data in parts:
            n = len(data) // abs(align)
            out[i] = rate, np.concatenate([out[i][1], samples[at : at + n].ravel()])
            at += n
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the exact times k / to, rounded half up; integers throughout, so equal everywhere."""
    if not len(pcm) or rate == to:
        return pcm
    n = (len(pcm) * to + rate - 1) // rate
    time = np.arange(n, dtype=np.int64) * rate
    left, part = time // to, time % to
    right = np.minimum(left + 1, len(pcm) - 1)
    left = np.minimum(left, len(pcm) - 1)
    a = pcm[left].astype(np.int64)
    return ((2 * (a * to + (pcm[right].astype(np.int64) - a) * part) + to) // (2 * to)).astype(np.int16)


def lifted(pcm: np.ndarray) -> bytes:
    """Samples of even number, then the differences of the others to their neighbours' mean, as little-endian int16."""
    even = pcm[::2]
    return np.concatenate([even, pcm[1::2] - _between(even, len(pcm) // 2)]).astype("<i2").tobytes()


def unlifted(stored: bytes) -> np.ndarray:
    """The samples that `lifted` stored."""
    parts = np.frombuffer(stored, "<i2")
    even = parts[: (len(parts) + 1) // 2]
    out = np.empty(len(parts), np.int16)
    out[::2], out[1::2] = even, parts[len(even) :] + _between(even, len(parts) // 2)
    return out


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The means of n neighbours, rounded half up; the last sample is its own neighbour."""
    a, b = even[:n].astype(np.int32), np.append(even[1:], even[-1:])[:n].astype(np.int32)
    return ((a + b + 1) >> 1).astype(np.int16)


def pcm_column(df: DataFrame, media: str = "media", rate: int = 16000, out: str = "pcm") -> DataFrame:
    """df with the decoded, resampled and lifted PCM of its WAV column (null where that is no telephony WAV)."""
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(media)
            for a, b in C.slices(C.text_bytes(column)[0]):
                found = decode(column.slice(a, b - a).to_pylist())
                pcm = [None if f is None else lifted(resample(f[1], f[0], rate)) for f in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), pa.array(pcm, pa.binary())], [*names, out])

    return df.mapInArrow(C.trimmed(run), f"{C.ddl(df.drop(out))}, `{out}` binary")


def store(df: DataFrame, name: str = "media") -> DataFrame:
    """A table with media and PCM columns, written to the shared folder and read again. PCM is large: zstandard, level 12."""
    return C.materialise(df, name, **{"parquet.compression.codec.zstd.level": "12"})


def padded(text: bytes, unit: int = BLOCK) -> bytes:
    return text + b" " * (-len(text) % unit if text else unit)


def coding_of(payload: bytes) -> int:
    """The coding that a payload is stored in: chosen by its checksum, so that equal payloads agree."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def features(pcm: np.ndarray, coding: int, rate: int) -> str:
    """Integer features of stored PCM: samples, peak, energy, zero crossings, checksum."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{NAMES[coding]}@{rate}:n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};energy={int((wide * wide).sum())};crossings={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text padded and stored as a WAV."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = C.text_bytes(batch.column("text"))
            for a, b in C.slices(offsets, 8 << 20):
                media = []
                for i in range(a, b):
                    payload = padded(body[offsets[i] : offsets[i + 1]].tobytes())
                    media.append(wav(payload, coding_of(payload)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def media_digests(stored: DataFrame, rate: int = 16000) -> DataFrame:
    """What is read back from a stored (doc_id, n_bytes, media, pcm): digests of payload and file, and features of the PCM."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for m, p in zip(batch.column("media"), batch.column("pcm")):
                m, pcm = m.as_py(), unlifted(p.as_py())
                coding, _, _, data = parse_wav(m)
                for column, value in zip(rows, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(pcm, coding, rate))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(C.trimmed(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store(pcm_column(to_media(C.table(spark, sf_dir, "documents")))))
