"""Token counts of the sections of a document, from one encoding of the whole document."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import with_struct
from ._common import here, ship

#: Ranks of a byte-level vocabulary, and the pattern that splits a text before its pieces are merged.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("start", "majority", "split")


def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file, each with its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(path: str):
    """(encoding, bytes of each token) of a vocabulary file."""
    import tiktoken

    by_piece = ranks(here(path))
    sizes = np.zeros(max(by_piece.values()) + 1, np.int64)
    for piece, rank in by_piece.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding(hashlib.sha256(path.encode()).hexdigest(), pat_str=PATTERN, mergeable_ranks=by_piece, special_tokens={}), sizes


def spans_of(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens. A token that holds part of a character's bytes starts, or ends, with that whole character."""
    ends = np.cumsum(sizes[ids])
    if text.isascii():
        return ends - sizes[ids], ends
    data = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte
    starts = ends - sizes[ids]
    begins = np.append((data & 0xC0) != 0x80, True)
    return chars[starts] - ~begins[starts], chars[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section k reaches from bounds[k] to bounds[k + 1].

    Tokens and sections are sorted, so the interval join is two searches for each token. A token that lies in
    several sections counts: "start", where its first character is; "majority", where most of its characters are,
    the earlier of equals; "split", in each by its share of characters.
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends, starts + 1), "left") - 1
    np.clip(first, 0, n - 1, out=first)
    np.clip(last, first, n - 1, out=last)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    whole = first == last
    out = np.bincount(first[whole], minlength=n).astype(float)
    for a, b, f, k in zip(starts[~whole], ends[~whole], first[~whole], last[~whole], strict=True):
        inside = np.minimum(b, bounds[f + 1 : k + 2]) - np.maximum(a, bounds[f : k + 1])
        if rule == "majority":
            out[f + int(np.argmax(inside))] += 1
        else:
            out[f : k + 1] += inside / max(1, b - a)
    return out


def line_bounds(text: str) -> np.ndarray:
    """Bounds of a text's lines; a line break belongs to the line that it ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(codes == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(codes)], [len(codes)]])


def counts(texts: Iterable[str | None], path: str = VOCABULARY, rule: str = "majority") -> list[dict]:
    encoding, sizes = encoder(path)
    out = []
    for text in texts:
        text = (text or "").encode("utf-8", "replace").decode()
        ids = np.asarray(encoding.encode_ordinary(text), np.int64)
        bounds = line_bounds(text)
        got = attribute(*spans_of(text, ids, sizes), bounds, rule) if len(ids) else np.zeros(len(bounds) - 1)
        out.append({"n_tokens": len(ids), "starts": bounds[:-1], "ends": bounds[1:], "tokens": got})
    return out


COUNTS = pa.struct([("n_tokens", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("tokens", pa.list_(pa.float64()))])


def token_counts(df: DataFrame, text_col: str = "text", out_col: str = "token_counts", path: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """df with out_col: struct<n_tokens, starts, ends, tokens>: of the whole text, and of each line by `rule`.

    The text is encoded once, so the sections' tokens add up to n_tokens. A null or empty text has no tokens and one
    empty section; a text of any length is encoded whole. Rows are independent: repeats get equal results, an empty df
    stays empty. An out_col already there is replaced; other columns pass through, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(df.sparkSession, path)
    return with_struct(df, text_col, out_col, COUNTS, lambda column: counts(column.to_pylist(), path, rule))
