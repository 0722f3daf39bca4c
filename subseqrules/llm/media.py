"""Media columns: storing, sniffing and carving binary media.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value; the format's validator then walks
its structure and gives its exact length, or refuses. A valid hit at offset 0 corrects the declared type; others are
embedded media that can be carved out. Nothing is decided by magic bytes alone.

Defined results: null values are handled as empty; an empty value has no media, its type is application/octet-stream;
values may be of any length; equal values give equal results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, read_table, scratch_path, values

UNIT, RATE = 576, 8000
# Fixed values of the formats: magic bytes and media types.
SIGNATURES = {
    b"RIFF": "audio/wav", b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg", b"BM": "image/bmp", b"%PDF-": "application/pdf", b"PK\x03\x04": "application/zip",
    b"OggS": "audio/ogg", b"\x1f\x8b\x08": "application/gzip",
}
OTHER = "application/octet-stream"


def wav_layout(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(length, start of the samples, their length) of a PCM WAV file."""
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, p, data, fmt = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, None, False
    if end > len(b):
        return None
    while p + 8 <= end:
        kind, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        fmt |= kind == b"fmt " and n >= 16 and struct.unpack_from("<H", b, p + 8)[0] == 1
        data = (p + 8, n) if kind == b"data" else data
        p += 8 + n + n % 2
    return (end - at, *data) if fmt and data else None


def wav(b: bytes, at: int) -> int:
    return (wav_layout(b, at) or (0,))[0]


def png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def gif(b: bytes, at: int) -> int:
    if len(b) - at < 14:
        return 0
    flags, p = b[at + 10], at + 13
    p += 3 << (flags & 7) + 1 if flags & 128 else 0

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = blocks(p + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return 0
    return 0


def jpeg(b: bytes, at: int, after: Callable[[bytes, int], int]) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xDA:
            end = after(b"\xff\xd9", p)
            return end + 2 - at if end > 0 else 0
        if not 0xC0 <= b[p + 1] <= 0xFE:
            return 0
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    return 0


def bmp(b: bytes, at: int) -> int:
    if len(b) - at < 30:
        return 0
    n, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    ok = zero == 0 and head in (40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= start <= n <= len(b) - at
    return n if ok else 0


def pdf(b: bytes, at: int, after: Callable[[bytes, int], int]) -> int:
    end = after(b"%%EOF", at) if b[at + 5 : at + 6].isdigit() and after(b"startxref", at) > 0 else -1
    return end + 5 - at if end > 0 else 0


def zipped(b: bytes, at: int, after: Callable[[bytes, int], int]) -> int:
    end = after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b) or len(b) - at < 30:
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 + b[p + 26 : p + 27][0] <= len(b):
        n = 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        if p + n > len(b):
            return 0
        last, p = b[p + 5] & 4, p + n
        if last:
            return p - at
    return 0


def gzipped(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        for k in range(at, len(b), 1 << 16):
            d.decompress(b[k : k + (1 << 16)])
            if d.eof:
                return min(len(b), k + (1 << 16)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return 0


VALID = {"audio/wav": wav, "image/png": png, "image/gif": gif, "image/bmp": bmp, "audio/ogg": ogg, "application/gzip": gzipped}
#: These look for an end mark behind the magic bytes.
SEEKING = {"image/jpeg": jpeg, "application/pdf": pdf, "application/zip": zipped}


class Marks:
    """Where marks are in a value: each kind is looked for once, however many hits ask for it."""

    def __init__(self, value: bytes):
        self.value, self.known = value, {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place from `at` on, -1 if there is none."""
        if mark not in self.known:
            self.known[mark] = array("q", (m.start() for m in re.finditer(re.escape(mark), self.value)))
        places = self.known[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def media_in(value: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid medium in the value, by offset."""
    value = value or b""
    found, marks = [], Marks(value)
    for end, (size, kind) in automaton().iter(value.decode("latin-1")):
        at = end + 1 - size
        if n := VALID[kind](value, at) if kind in VALID else SEEKING[kind](value, at, marks.after):
            found.append((kind, at, n))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def sniff_media(df: DataFrame, key: str, value: str, declared: str | None = None) -> DataFrame:
    """key, declared, media_type, n_media, media (array of type, offset, length, bytes): the types found and what can be carved."""
    out = "media_type string, media array<struct<type: string, start: long, length: long, bytes: binary>>"

    def run(batches):
        for pdf in batches:
            rows = []
            for b in pdf["value"]:
                found = media_in(b)
                rows.append((found[0][0] if found and found[0][1] == 0 else OTHER, [{"type": k, "start": s, "length": n, "bytes": b[s : s + n]} for k, s, n in found]))
            yield pd.concat([pdf.drop(columns="value").reset_index(drop=True), pd.DataFrame(rows, columns=["media_type", "media"])], axis=1)

    said = F.col(declared) if declared else F.lit(None).cast("string")
    df = df.select(F.col(key).alias("key"), said.alias("declared"), F.col(value).alias("value"))
    kind = df.schema["key"].dataType.simpleString()
    return df.mapInPandas(run, f"key {kind}, declared string, {out}").withColumn("n_media", F.size("media")).withColumn("wrong_type", ~F.col("declared").eqNullSafe(F.col("media_type")))


def little(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def as_wav(payload: Column, n: Column) -> Column:
    """A WAV file with the n payload bytes as 8-bit samples."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), little(n + 36), F.lit(head), little(n), payload)


def store_texts(docs: DataFrame, folder: str) -> None:
    """A media table (doc_id, declared, n_bytes, media): each text's UTF-8, filled up with bytes 255, as WAV samples."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    n = F.octet_length(raw).cast("long")
    full = F.greatest(F.lit(1), F.ceil(n / UNIT)) * UNIT
    media = as_wav(F.concat(raw, F.substring(F.lit(b"\xff" * UNIT), F.lit(1), (full - n).cast("int"))), full)
    docs.select("doc_id", F.lit(OTHER).alias("declared"), n.alias("n_bytes"), media.alias("media")).write.option("compression", "zstd").parquet(folder)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, wrong_type boolean, n_embedded long"


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back through the sniffer and the validators: the type found beside the declared one, and how
    many media are embedded in what was stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, said, b in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["declared"].to_pylist(), values(batch["media"])):
                found = media_in(b)
                if not found or found[0][:2] != ("audio/wav", 0):
                    raise ValueError(f"the stored medium of document {i} is damaged")
                _, start, size = wav_layout(b, 0)
                payload = b[start : start + size]
                x = np.frombuffer(payload, np.uint8)
                crossings = int(np.count_nonzero(np.diff(x >= 128)))
                text = f"{found[0][0]};rate={RATE};samples={size};sum={int(x.sum(dtype=np.int64))};crossings={crossings};embedded={len(found) - 1}"
                rows.append((i, n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), text, said, found[0][0], said != found[0][0], len(found) - 1))
            names = [c.split()[0] for c in FEATURES.split(", ")][2:]
            yield beside(batch, ["doc_id", "n_bytes"], **dict(zip(names, zip(*[r[2:] for r in rows]))))

    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "declared", "media").mapInArrow(run, FEATURES)


def op3_media(spark, sf_dir):
    store_texts(read_table(spark, sf_dir, "documents"), folder := scratch_path(spark, "media"))
    return media_features(spark.read.parquet(folder))
