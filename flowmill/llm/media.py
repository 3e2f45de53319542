"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, decoded to PCM and resampled."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, mapped, settle, slices, text_bytes, with_field

# WAV format tags, and the IMA ADPCM step and index tables.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

UNIT = 64  # bytes of ADPCM codes in a block, after its 4-byte header
HEADER = 4


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code (ITU-T G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, size + 8, (size + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, a row each: the header's sample, then two for each byte, low nibble first.

    All blocks take each step together, so the loop is as long as one block.
    """
    head = blocks[:, :HEADER].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32) if len(blocks) else np.zeros(0, np.int32)
    index = np.clip(head[:, 2], 0, 88)
    codes = blocks[:, HEADER:]
    out = np.empty((len(blocks), 1 + 2 * codes.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * codes.shape[1]):
        code = (codes[:, k // 2] >> (4 * (k % 2)) & 15).astype(np.int32)
        step = STEPS[index]
        move = step >> 3
        move += np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def to_wav(codec: str, payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file whose samples (or ADPCM codes, in blocks of UNIT bytes) are the payload's bytes."""
    bits, align, extra = 8, 1, b""
    if codec == "adpcm":
        bits, align, extra = 4, HEADER + UNIT, struct.pack("<HH", 2, 1 + 2 * UNIT)
        codes = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        payload = np.hstack([np.zeros((len(codes), HEADER), np.uint8), codes]).tobytes()
    per_second = rate * align // (1 + 2 * UNIT) if codec == "adpcm" else rate
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(stored: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and data of a WAV file; chunks other than fmt and data are passed over."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate, align = 12, "", 0, 1
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", stored, at + 8)
            codec = {v: k for k, v in TAGS.items()}[tag]
        elif kind == b"data":
            return codec, rate, align, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def payload_of(codec: str, align: int, data: bytes) -> bytes:
    """The codes alone, without ADPCM block headers."""
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, HEADER:].tobytes() if codec == "adpcm" else data


PIECE = 1 << 18  # samples resampled together


def resampled(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers, the same on every machine; the last sample is held."""
    if source == target or not len(pcm):
        return pcm
    out = np.empty(len(pcm) * target // source, np.int16)
    for first in range(0, len(out), PIECE):
        at = np.arange(first, min(first + PIECE, len(out)), dtype=np.int64) * source
        low = at // target
        high = np.minimum(low + 1, len(pcm) - 1)
        part = at - low * target
        out[first : first + PIECE] = (pcm[low].astype(np.int64) * (target - part) + pcm[high] * part) // target
    return out


def decoded(files: list[bytes]) -> list[tuple[str, int, bytes, np.ndarray]]:
    """Codec, rate, payload and PCM of each WAV file; the ADPCM blocks of all files are decoded together."""
    parsed = [from_wav(f) for f in files]
    at: dict[int, tuple[int, int]] = {}
    total, groups = {}, {}
    for k, (codec, _, align, data) in enumerate(parsed):
        if codec == "adpcm":
            groups.setdefault(align, []).append(np.frombuffer(data, np.uint8).reshape(-1, align))
            first = total.get(align, 0)
            total[align] = first + len(groups[align][-1])
            at[k] = (first, total[align])
    pcm = {align: adpcm_blocks(np.concatenate(b)) for align, b in groups.items()}
    out = []
    for k, (codec, rate, align, data) in enumerate(parsed):
        wave = pcm[align][at[k][0] : at[k][1]].reshape(-1) if codec == "adpcm" else TABLES[codec][np.frombuffer(data, np.uint8)]
        out.append((codec, rate, payload_of(codec, align, data), wave))
    return out


def encode(rows: DataFrame, payload: str, codec: str, out: str = "media", rate: int = 8000) -> DataFrame:
    """rows with a column out: the bytes of column payload stored as a WAV file by the codec column's name.

    Payloads of adpcm must be multiples of UNIT bytes. A null or empty payload gives a file without samples.
    """
    names = [n for n in rows.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, payload):
            data, at = text_bytes(part.column(names.index(payload)))
            whole, kinds = data.tobytes(), part.column(names.index(codec)).to_pylist()
            files = [to_wav(kinds[k], whole[at[k] : at[k + 1]], rate) for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())], [*names, out])

    rows = rows.select(*(F.col(f"`{n}`") for n in names))
    return mapped(rows, run, with_field(rows.schema, out, "binary"))


def transcode(rows: DataFrame, media: str = "media", rate: int = 16000, out: str = "pcm") -> DataFrame:
    """rows with a column out: 16-bit little-endian PCM of the WAV files in column media, at the given rate.

    A null file gives null; a file that is no WAV of the three codecs raises ValueError. Files are decoded in
    slices of about 2 MB, a longer one alone, in some 15 bytes of memory a byte of codes.
    """
    names = [n for n in rows.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media, 2 << 20):
            files = part.column(names.index(media)).to_pylist()
            waves = iter(decoded([f for f in files if f is not None]))
            pcm = []
            for f in files:
                if f is None:
                    pcm.append(None)
                else:
                    _, source, _, wave = next(waves)
                    pcm.append(resampled(wave, source, rate).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary())], [*names, out])

    rows = rows.select(*(F.col(f"`{n}`") for n in names))
    return mapped(rows, run, with_field(rows.schema, out, "binary"))


def padded(text: str, unit: int = UNIT):
    """The text's UTF-8 bytes, with zeros up to a positive multiple of unit; null as empty."""
    body = F.coalesce(field(text), F.lit("")).cast("binary")
    short = F.greatest(F.lit(unit), F.ceil(F.octet_length(body) / unit) * unit) - F.octet_length(body)
    return F.concat(body, F.expr(f"X'{'00' * unit}'").substr(F.lit(1), short.cast("int")))


def summary(pcm: np.ndarray) -> str:
    """Samples, root mean square, peak and changes of sign, added up in pieces."""
    squares, peak, turns = 0, 0, 0
    for first in range(0, len(pcm), PIECE):
        wide = pcm[max(0, first - 1) : first + PIECE].astype(np.int64)  # with the sample before
        turns += int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
        wide = wide[min(first, 1) :]
        squares += int((wide * wide).sum())
        peak = max(peak, int(np.abs(wide).max()))
    return f"samples={len(pcm)} rms={math.isqrt(squares // max(1, len(pcm)))} peak={peak} turns={turns} pcm_crc32={zlib.crc32(pcm)}"


def features(rows: DataFrame, key: str = "doc_id", media: str = "media", size: str = "n_bytes", pcm: str = "pcm", rate: int = 16000) -> DataFrame:
    """Digests of the stored files and of the payloads read back from them, and a line of features of their PCM.

    rows: of transcode(), with key and size, which stay. A row without a file has nulls for the rest;
    repeated rows each get a row; an empty table gives none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
        for part in slices(batches, "media", 2 << 20):
            got = []
            for stored, wave in zip(part.column(1), part.column(3), strict=True):
                if not stored.is_valid:
                    got.append((None,) * len(kinds))
                    continue
                stored, wave = stored.as_py(), np.frombuffer(wave.as_py(), "<i2")
                codec, _, align, data = from_wav(stored)
                payload = payload_of(codec, align, data)
                got.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), sha256(stored).hexdigest(), f"{codec} rate={rate} {summary(wave)}"))
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["key", "size", *kinds])

    chosen = rows.select(field(key).alias("key"), field(media).alias("media"), field(size).alias("size"), field(pcm).alias("pcm"))
    schema = f"key {rows.schema[key].dataType.simpleString()}, size long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return mapped(chosen, run, schema).withColumnsRenamed({"key": key, "size": size})


def stored_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's padded bytes as a WAV file; the codec follows from the payload, so equal texts are stored alike.

    Null texts count as empty and are stored as UNIT zero bytes; repeated rows are stored again; other columns
    are left out.
    """
    rows = docs.select(field(key), F.coalesce(F.octet_length(field(text)), F.lit(0)).cast("long").alias("n_bytes"), padded(text).alias("payload"))
    kind = F.element_at(F.array(*map(F.lit, TAGS)), (F.crc32("payload") % len(TAGS) + 1).cast("int"))
    return encode(rows.withColumn("codec", kind), "payload", "codec").drop("payload")


def round_trip(docs: DataFrame, rate: int = 16000) -> DataFrame:
    """Store each text's bytes as telephony audio, read the stored table, and describe the files and their PCM.

    What is stored are the files; their PCM at rate, which is several times as large, goes on as a column.
    """
    stored = settle(stored_documents(docs), "media")
    return features(transcode(stored, rate=rate), rate=rate)
