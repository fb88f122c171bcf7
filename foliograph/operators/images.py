"""Images as rows: PNG to and from arrays, turned upright, for 8-bit grey and RGB without interlacing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def to_png(pixels: np.ndarray) -> bytes:
    """8-bit grey (rows, columns) or RGB (rows, columns, 3)."""
    high, wide = pixels.shape[:2]
    rows = np.zeros((high, 1 + pixels[0].size), np.uint8)
    rows[:, 1:].reshape(pixels.shape)[:] = pixels
    head = struct.pack(">IIBBBBB", wide, high, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The pixels of an image that to_png() or another writer of such images made; ValueError for all else."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape = 8, b"", None
    while at + 8 <= len(data):
        size, tag = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            wide, high, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or kind not in (0, 2) or laced:
                raise ValueError("only 8-bit grey or RGB without interlacing")
            shape = (high, wide, 3 if kind == 2 else 1)
        elif tag == b"IDAT":
            packed += body
        at += 12 + size
    if shape is None:
        raise ValueError("no header")
    high, wide, deep = shape
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(high, 1 + wide * deep)
    out = np.zeros((high, wide * deep), np.uint8)
    above = np.zeros(wide * deep, np.int64)
    for y, line in enumerate(lines):
        out[y] = above = _unfiltered(int(line[0]), line[1:].astype(np.int64), above, deep)
    return out.reshape(high, wide, deep).squeeze(axis=2) if deep == 1 else out.reshape(high, wide, deep)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, deep: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) % 256
    done = np.zeros(len(line), np.int64)
    for i in range(len(line)):
        a, c = (done[i - deep], above[i - deep]) if i >= deep else (0, 0)
        b = above[i]
        p = a + b - c
        near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
        done[i] = (line[i] + {1: a, 3: (a + b) // 2, 4: near}[kind]) % 256
    return done


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Turned and mirrored as a camera's orientation number, 1 to 8, says."""
    turned = np.transpose(pixels, (1, 0, *range(2, pixels.ndim))) if orientation >= 5 else pixels
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(orientation, ())
    return np.flip(turned, flips) if flips else turned


def normalised(df: DataFrame, kept: str = "page_id bigint") -> DataFrame:
    """Of rows with content and orientation: the image upright, in RGB and as PNG, with its width and height."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for content, turn in zip(rows["content"], rows["orientation"], strict=True):
                image = upright(from_png(bytes(content)), int(turn))
                colour = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
                made.append((to_png(colour), colour.shape[1], colour.shape[0]))
            out = rows[names].copy()
            out["png"], out["width"], out["height"] = zip(*made, strict=True) if made else ([], [], [])
            yield out

    return df.mapInPandas(run, f"{kept}, png binary, width int, height int")
