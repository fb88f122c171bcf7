"""Media columns: signatures found by one automaton, confirmed by the formats' own structure."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import with_struct
from ._common import spare

# Magic bytes of the formats and where they stand from the start of a file.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"BM": ("bmp", 0),
    b"RIFF": ("riff", 0),
    b"OggS": ("ogg", 0),
    b"fLaC": ("flac", 0),
    b"ftyp": ("mp4", 4),
    b"\x1f\x8b\x08": ("gzip", 0),
    b"%PDF-": ("pdf", 0),
}
# Media types that a declaration may use for a format.
DECLARED = {
    "png": ("image/png",), "jpeg": ("image/jpeg", "image/jpg"), "gif": ("image/gif",), "bmp": ("image/bmp", "image/x-ms-bmp"),
    "wav": ("audio/wav", "audio/x-wav", "audio/wave"), "webp": ("image/webp",), "avi": ("video/avi", "video/x-msvideo"), "ogg": ("audio/ogg", "video/ogg", "application/ogg"),
    "flac": ("audio/flac", "audio/x-flac"), "mp4": ("video/mp4", "audio/mp4"), "gzip": ("application/gzip",), "pdf": ("application/pdf",),
}


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int


def _png(data: bytes, at: int) -> tuple[str, int] | None:
    i, first = at + 8, True
    while i + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, i)
        end, tag = i + 12 + size, data[i + 4 : i + 8]
        if end > len(data) or first != (tag == b"IHDR") or zlib.crc32(data[i + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if tag == b"IEND":
            return "png", end
        i, first = end, False
    return None


def _jpeg(data: bytes, at: int) -> tuple[str, int] | None:
    i, scanned = at + 2, False
    while i + 4 <= len(data) and data[i] == 0xFF:
        mark = data[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if mark == 0xD9:
            return ("jpeg", i + 2) if scanned else None
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8:
            return None
        size = struct.unpack_from(">H", data, i + 2)[0]
        if size < 2:
            return None
        i += 2 + size
        if mark == 0xDA:  # entropy-coded data: to the next marker that is neither stuffing nor a restart
            scanned = True
            while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data) and (data[i + 1] == 0 or 0xD0 <= data[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return ("jpeg", i + 2) if scanned and data[i : i + 2] == b"\xff\xd9" else None


def _gif(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0

    def blocks(i: int) -> int:
        while i < len(data) and data[i]:
            i += 1 + data[i]
        return i + 1

    while i < len(data):
        if data[i] == 0x3B:
            return ("gif", i + 1) if images else None
        if data[i] == 0x21:
            i = blocks(i + 2)
        elif data[i] == 0x2C and i + 10 <= len(data):
            flags, images = data[i + 9], images + 1
            i = blocks(i + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
        else:
            return None
    return None


def _bmp(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(data):
        return None
    size, _, pixels, head = struct.unpack_from("<IIII", data, at + 2)
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    good = head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= pixels <= size
    return ("bmp", at + size) if good and at + size <= len(data) else None


def _riff(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(data):
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    kind, need = {b"WAVE": ("wav", b"fmt "), b"WEBP": ("webp", b"VP8"), b"AVI ": ("avi", b"LIST")}.get(data[at + 8 : at + 12], ("", b""))
    if not kind or end > len(data):
        return None
    i, tags = at + 12, []
    while i + 8 <= end:
        tags.append(data[i : i + 4])
        size = struct.unpack_from("<I", data, i + 4)[0]
        i += 8 + size + (size & 1)
    return (kind, end) if i in (end, end + 1) and any(t.startswith(need) for t in tags) else None


def _ogg(data: bytes, at: int) -> tuple[str, int] | None:
    i, pages = at, 0
    while data[i : i + 4] == b"OggS" and i + 27 <= len(data) and data[i + 4] == 0:
        n = data[i + 26]
        end = i + 27 + n + sum(data[i + 27 : i + 27 + n])
        if end > len(data) or (not pages and not data[i + 5] & 2):
            return None
        last = data[i + 5] & 4
        i, pages = end, pages + 1
        if last:
            break
    return ("ogg", i) if pages else None


def _flac(data: bytes, at: int) -> tuple[str, int] | None:
    """Frames carry no lengths: the stream is taken to go on to the end of the data."""
    i, first = at + 4, True
    while i + 4 <= len(data):
        kind, size = data[i] & 0x7F, int.from_bytes(data[i + 1 : i + 4])
        if first and (kind, size) != (0, 34) or kind > 6 or i + 4 + size > len(data):
            return None
        if data[i] & 0x80:
            return "flac", len(data)
        i, first = i + 4 + size, False
    return None


def _mp4(data: bytes, at: int) -> tuple[str, int] | None:
    i, tags = at, []
    while i + 8 <= len(data):
        size, tag = struct.unpack_from(">I4s", data, i)
        if size == 1 and i + 16 <= len(data):
            size = struct.unpack_from(">Q", data, i + 8)[0]
        if size < 8 or i + size > len(data) or not tag.isalnum():
            break
        tags.append(tag)
        i += size
    return ("mp4", i) if tags[:1] == [b"ftyp"] and b"moov" in tags else None


def _gzip(data: bytes, at: int) -> tuple[str, int] | None:
    if data[at + 3 : at + 4] > b"\x1f":
        return None
    unpack, i = zlib.decompressobj(31), at
    try:
        while i < len(data) and not unpack.eof:
            piece = unpack.unconsumed_tail or data[i : i + 65536]
            if not unpack.unconsumed_tail:
                i += len(piece)
            unpack.decompress(piece, 1 << 20)
    except zlib.error:
        return None
    return ("gzip", i - len(unpack.unused_data)) if unpack.eof else None


def _pdf(data: bytes, at: int) -> tuple[str, int] | None:
    if not data[at + 5 : at + 6].isdigit():
        return None
    following = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, following if following >= 0 else len(data))
    return ("pdf", end + 5) if end >= 0 and data.find(b"startxref", at, end) >= 0 else None


CHECKS = {"png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "riff": _riff, "ogg": _ogg, "flac": _flac, "mp4": _mp4, "gzip": _gzip, "pdf": _pdf}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, (kind, offset) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, offset, len(magic)))
    a.make_automaton()
    return a


def sniff(data: bytes) -> Iterator[Found]:
    """Every confirmed media file in data, by start; a file inside another one follows it."""
    seen: dict[str, int] = {}
    hits = sorted((end + 1 - size - offset, kind) for end, (kind, offset, size) in _automaton().iter(data.decode("latin-1")))
    for start, kind in hits:
        if start < 0 or (kind == "ogg" and start < seen.get(kind, 0)):  # later pages of one stream
            continue
        if got := CHECKS[kind](data, start):
            seen[kind] = got[1]
            yield Found(got[0], start, got[1])


def corrected(found: list[Found], declared: str | None) -> tuple[str | None, bool]:
    """The type to use, and whether it differs from the declared one: a file at byte 0 wins over the declaration."""
    own = next((f.kind for f in found if f.start == 0), None)
    if own is None:
        return declared, False
    kind = (declared or "").split(";")[0].strip().lower()
    return (kind, False) if kind in DECLARED[own] else (DECLARED[own][0], True)


def media_column(df: DataFrame, bytes_col: str, declared_col: str | None = None, out_col: str = "media") -> DataFrame:
    """df with out_col: struct<kind, media_type, corrected, found: array<struct<kind, start, end>>, carved: array<binary>>.

    found has every confirmed file in the value, carved the bytes of those that don't start at 0. Null or empty
    values have no kind and empty lists, and keep what was declared. A value of any length is read whole. Rows are
    independent: repeats get equal results, an empty df stays empty, and other columns pass through, whatever their
    names; an out_col already there is replaced.
    """
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    fields = pa.struct([("kind", pa.string()), ("media_type", pa.string()), ("corrected", pa.bool_()), ("found", pa.list_(kinds)), ("carved", pa.list_(pa.binary()))])
    (pair,) = spare(df, "media_in")
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")

    def of(column: pa.Array) -> list[dict]:
        out = []
        for row in column.to_pylist():
            data = bytes(row["data"] or b"")
            found = list(sniff(data))
            kind, changed = corrected(found, row["declared"])
            out.append({"kind": next((f.kind for f in found if f.start == 0), None), "media_type": kind, "corrected": changed, "found": [vars(f) for f in found], "carved": [data[f.start : f.end] for f in found if f.start]})
        return out

    return with_struct(df.withColumn(pair, F.struct(F.col(f"`{bytes_col}`").alias("data"), declared.alias("declared"))), pair, out_col, fields, of).drop(pair)


# The header of a RIFF/WAVE file of 8-bit mono PCM.
RATE = 8000
PAD = 192


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text with spaces up to a positive multiple of PAD."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // PAD)) * PAD, b" ")


def to_wav(samples: bytes) -> bytes:
    """8-bit unsigned PCM; a sample for each byte."""
    pad = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(data: bytes) -> bytes:
    """The samples that a RIFF/WAVE file stores."""
    i = 12
    while i + 8 <= len(data):
        tag, size = struct.unpack_from("<4sI", data, i)
        if tag == b"data":
            return data[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def as_media(text: str | None) -> dict:
    """What op10 returns of a text."""
    data = payload(text)
    n = len((text or "").encode("utf-8", "surrogatepass"))
    stored = to_wav(data)
    back = from_wav(stored)
    found = list(sniff(stored))
    kind, changed = corrected(found, "application/octet-stream")
    return {
        "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": f"{kind};{'corrected' if changed else 'declared'};" + "|".join(f"{f.kind}:{f.start}:{f.end}" for f in found),
    }


AS_MEDIA = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def text_as_media(df: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """df with out_col: each whole text stored as a sound file, read back and sniffed; a null text counts as empty.

    Rows are independent: repeats get equal results, an empty df stays empty, a text of any length is one file. An out_col
    already there is replaced; other columns pass through, whatever their names.
    """
    return with_struct(df, text_col, out_col, AS_MEDIA, lambda column: [as_media(t) for t in column.to_pylist()])
