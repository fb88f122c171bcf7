"""SentencePiece encoding and decoding: a numpy Viterbi over all new words of equal length at once.

A model's pieces are keyed by a polynomial hash of their characters, sorted; hashes of all substrings of up to the
longest piece's length probe them. For a unigram model the best score of each prefix is the maximum over the pieces
that end there. A BPE model's answer isn't the best sum of scores. There a piece may only follow the last piece of the
prefix before it if encoding the two together keeps them apart; exactly one piece can end each prefix, and the same
recursion finds it. Words are encoded once for many occurrences, in a bounded store that each worker keeps.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import with_struct
from ._common import here, ship, spare
from ._hash import BASE, INVERSE, MIX, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: What a worker keeps: words (16 bytes and 4 for each piece) and pairs of pieces (9 bytes). At these numbers a store starts anew.
STORE_WORDS, STORE_PAIRS = 300_000, 500_000
#: Bytes of text that are encoded at a time; about forty times as many are held while it lasts.
SLICE_BYTES = 1 << 20
#: Units above this length are also split where no piece spans two neighbouring characters.
LONG = 48


def coded(chars: np.ndarray) -> np.ndarray:
    """A 64-bit value for each character."""
    x = (chars.astype(np.uint64) + np.uint64(1)) * MIX
    return x ^ (x >> np.uint64(31))


class Pairs:
    """Whether piece b may follow piece a in a BPE encoding; answers are kept, sorted by pair."""

    def __init__(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray, merges: dict[tuple[int, int], int]) -> None:
        self.rank, self.left, self.right, self.n = rank, left, right, len(rank)
        keys = np.array([a * self.n + b for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], rank[np.array(list(merges.values()), np.int64)[order]]
        self.keys, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the last merges on both sides of the boundary, latest first, and looks for a merge across it that would have come before."""
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        rows = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(rows):
            x, y = a[rows], b[rows]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            crossed = (self.merge_keys[at] == key) & (self.merge_ranks[at] < limit[rows])
            good[rows[crossed]] = False
            on_left = self.rank[x] > self.rank[y]
            taken = np.where(on_left, x, y)
            going = ~crossed & (self.left[taken] >= 0)  # else both are single characters
            rows, on_left, taken = rows[going], on_left[going], taken[going]
            # of equal ranks the leftmost merges first: the boundary's before one on its right, after one on its left
            limit[rows] = self.rank[taken] + ~on_left
            a[rows[on_left]] = self.right[taken[on_left]]
            b[rows[~on_left]] = self.left[taken[~on_left]]
        return good

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        if not known.all():
            new = np.unique(key[~known])
            if len(self.keys) > STORE_PAIRS:
                self.keys, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(key)
            where = np.searchsorted(self.keys, new)
            self.good = np.insert(self.good, where, self._stable(new // self.n, new % self.n))
            self.keys = np.insert(self.keys, where, new)
            at = np.searchsorted(self.keys, key)
        return self.good[at]


def _splits(pieces: dict[str, int], rank: np.ndarray) -> dict[int, tuple[int, int]]:
    """The last merge of every piece that merging its own characters arrives at."""
    out: dict[int, tuple[int, int]] = {}
    for piece, k in pieces.items():
        parts = list(piece)
        if len(parts) < 2 or any(c not in pieces for c in parts):
            continue
        last = (-1, -1)
        while len(parts) > 1:
            options = [(rank[m], i) for i in range(len(parts) - 1) if (m := pieces.get(parts[i] + parts[i + 1])) is not None]
            if not options:
                break
            _, i = min(options)
            last = pieces[parts[i]], pieces[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 1:
            out[k] = last
    return out


class Codec:
    """Encodes and decodes by one model file."""

    def __init__(self, path: str, unigram: bool | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(here(path), "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that take texts as they are can be used")
        self.prefix = META if norm.add_dummy_prefix else ""
        self.unigram = model.trainer_spec.model_type == 1 if unigram is None else unigram
        n = len(model.pieces)
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == 2)
        self.bytes_of = [p.piece.replace(META, " ").encode() if p.type in (1, 4) else b"" for p in model.pieces]
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for k, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = k
                self.bytes_of[k] = bytes([int(p.piece[1:-1], 16)])
        self.fallback = bool((self.byte_ids != self.unknown).all())
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined symbols aren't supported")
        pieces = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
        self.scores = np.array([p.score for p in model.pieces], np.float32)
        if not self.unigram:
            # ranks: characters first, then the others in the order in which they merge
            rank = np.zeros(n, np.int64)
            order = sorted(pieces.items(), key=lambda x: (len(x[0]) > 1, -self.scores[x[1]] if len(x[0]) > 1 else 0, x[1]))
            for r, (_, k) in enumerate(order, 1):
                rank[k] = r
            splits = _splits(pieces, rank)
            pieces = {p: k for p, k in pieces.items() if len(p) == 1 or k in splits}
            left, right = np.full(n, -1), np.full(n, -1)
            for k, (a, b) in splits.items():
                left[k], right[k] = a, b
            self.pairs = Pairs(rank, left, right, {ab: k for k, ab in splits.items()})
        self.longest = max(map(len, pieces))
        # by length, sorted keys and their ids
        by: dict[int, list[tuple[str, int]]] = {}
        for p, k in pieces.items():
            by.setdefault(len(p), []).append((p, k))
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, items in by.items():
            codes = coded(np.frombuffer("".join(p for p, _ in items).encode("utf-32-le"), np.uint32)).reshape(-1, size)
            h = np.zeros(len(items), np.uint64)
            for c in range(size):
                h = h * BASE + codes[:, c]
            o = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces have one key")
            self.keys[size] = h[o], np.array([k for _, k in items], np.int64)[o]
        self.known_char = np.zeros(0x110000, bool)
        self.known_char[[ord(p) for p in pieces if len(p) == 1]] = True
        inside = np.unique(np.array([(ord(a) << 21) | ord(b) for p in pieces for a, b in zip(p, p[1:])], np.int64))
        self.joined = inside
        #: No piece goes from a word into the next one's mark.
        self.by_mark = not any(a != META and b == META for p in pieces for a, b in zip(p, p[1:]))
        self.piece_sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_at, self.seen_n = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.pool_n = 0

    def _probe(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Ids of the pieces of `size` characters with these keys, -1 for none."""
        known, ids = self.keys[size]
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return np.where(known[at] == keys, ids[at], -1)

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, number of each row) for words of equal length, whose characters are all known."""
        n, size = codes.shape
        values, prefix = coded(codes), np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * BASE + values[:, j]
        up = powers(int(BASE), self.longest + 1)
        found = {}
        for k in sorted(self.keys):
            if k <= size:
                keys = prefix[:, k:] - prefix[:, : size + 1 - k] * up[k]
                found[k] = self._probe(keys.ravel(), k).reshape(keys.shape)
        last, back = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
        best = np.zeros((n, size + 1), np.float32)
        for j in range(1, size + 1):
            if self.unigram:
                best[:, j] = -np.inf
                for k in (k for k in found if k <= j):
                    ids = found[k][:, j - k]
                    total = np.where(ids >= 0, best[:, j - k] + self.scores[ids], -np.inf)
                    better = total > best[:, j]
                    best[better, j], last[better, j], back[better, j] = total[better], ids[better], k
            else:
                open_rows = np.arange(n)
                for k in sorted((k for k in found if k <= j), reverse=True):
                    ids = found[k][open_rows, j - k]
                    some = ids >= 0
                    rows, ids = open_rows[some], ids[some]
                    if len(rows):
                        good = np.ones(len(rows), bool) if j == k else self.pairs.allowed(last[rows, j - k], ids)
                        last[rows[good], j], back[rows[good], j] = ids[good], k
                        some[np.flatnonzero(some)[~good]] = False
                        open_rows = open_rows[~some]
                    if not len(open_rows):
                        break
                assert not len(open_rows)
        out, counts = np.zeros((n, size), np.int32), np.zeros(n, np.int64)
        at, rows = np.full(n, size), np.arange(n)
        while len(rows):
            out[rows, size - 1 - counts[rows]] = last[rows, at[rows]]
            counts[rows] += 1
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return out[np.arange(size) >= size - counts[:, None]], counts

    def _learn(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes words that the store doesn't have; hashes are sorted."""
        at, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        made: list[np.ndarray] = []
        total = self.pool_n

        def add(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal total
            n[rows], at[rows] = counts, total + np.cumsum(counts) - counts
            total += len(ids)
            made.append(ids)

        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:]):
            size = int(sizes[order[a]])
            step = max(1, 100_000 // size)
            for c in range(a, b, step):
                rows = order[c : min(b, c + step)]
                codes = chars[starts[rows][:, None] + np.arange(size)]
                fine = self.known_char[codes[:, 0]]
                if fine.any():
                    add(rows[fine], *self._viterbi(codes[fine]))
                for row, code in zip(rows[~fine], codes[~fine, 0]):
                    data = np.frombuffer(chr(code).encode("utf-8", "replace"), np.uint8)
                    ids = self.byte_ids[data] if self.fallback else np.array([self.unknown], np.int32)
                    add(np.array([row]), ids, np.array([len(ids)]))
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.pool_n], np.zeros(total + total // 2 - self.pool_n, np.int32)])
        self.pool[self.pool_n : total] = np.concatenate(made)
        self.pool_n = total
        where = np.searchsorted(self.seen, hashes)
        self.seen, self.seen_at, self.seen_n = np.insert(self.seen, where, hashes), np.insert(self.seen_at, where, at), np.insert(self.seen_n, where, n)

    def _bounds(self, chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where units begin: no piece reaches over such a place."""
        known = self.known_char[chars]
        cut = ~known
        cut[1:] |= ~known[:-1]
        if self.by_mark:
            mark = chars == ord(META)
            cut[1:] |= mark[1:] & ~mark[:-1]
        cut[text_starts] = True
        at = np.flatnonzero(cut)
        long = np.flatnonzero(np.diff(at, append=len(chars)) > LONG)
        if len(long):
            ends = np.append(at, len(chars))
            inner = np.concatenate([np.arange(at[k] + 1, ends[k + 1]) for k in long])
            key = (chars[inner - 1].astype(np.int64) << 21) | chars[inner]
            where = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
            at = np.union1d(at, inner[self.joined[where] != key])
        return at

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts; null and empty ones have no ids."""
        marked = [self.prefix + t.replace(" ", META) if t else "" for t in texts]
        text_sizes = np.array([len(t) for t in marked], np.int64)
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            return np.zeros(len(marked) + 1, np.int64), np.zeros(0, np.int32)
        text_ends = np.cumsum(text_sizes)
        starts = self._bounds(chars, (text_ends - text_sizes)[text_sizes > 0])
        sizes = np.diff(starts, append=len(chars))
        sums = np.cumsum(coded(chars) * powers(int(BASE), len(chars)))
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        hashes = (sums[starts + sizes - 1] - before) * powers(int(INVERSE), len(chars))[starts]
        hashes ^= sizes.astype(np.uint64) * MIX
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.seen) > STORE_WORDS:
            self._forget()
        at = np.searchsorted(self.seen, own)
        new = np.ones(len(own), bool)
        inside = at < len(self.seen)
        new[inside] = self.seen[at[inside]] != own[inside]
        if new.any():
            self._learn(chars, starts[first[new]], sizes[first[new]], own[new])
            at = np.searchsorted(self.seen, own)
        unit_at, unit_n = self.seen_at[at][inverse].astype(np.int64), self.seen_n[at][inverse].astype(np.int64)
        ends = np.cumsum(unit_n)
        ids = self.pool[np.repeat(unit_at - (ends - unit_n), unit_n) + np.arange(ends[-1])]
        return np.concatenate([[0], np.append(0, ends)[np.searchsorted(starts, text_ends)]]), ids

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of ids; bytes that aren't UTF-8 become U+FFFD."""
        sizes = self.piece_sizes[ids]
        ends = np.cumsum(sizes)
        data = self.piece_bytes[np.repeat(self.piece_starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.append(0, ends)[offsets]
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:]))
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


ENCODED = pa.struct([("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def encode_column(df: DataFrame, text_col: str = "text", out_col: str = "pieces", path: str = MODEL) -> DataFrame:
    """df with out_col: struct<n_pieces, ids, round_trip> of each whole text; round_trip: decoding gives the text back.

    A null or empty text has no ids, a text of any length is encoded whole. A text that holds U+2581 or a lone surrogate
    can't come back as it was. Rows are independent: repeats get equal results, an empty df stays empty; an out_col
    already there is replaced, other columns pass through, whatever their names.
    """

    def of(column: pa.Array) -> pa.Array:
        own, texts = codec(path), column.to_pylist()
        offsets, ids = own.encode(texts)
        back = own.decode(offsets, ids)
        return pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array([a == (b or "") for a, b in zip(back, texts)])], fields=list(ENCODED))

    ship(df.sparkSession, path)
    return with_struct(df, text_col, out_col, ENCODED, of, SLICE_BYTES)


def decode_column(df: DataFrame, ids_col: str = "ids", out_col: str = "text", path: str = MODEL) -> DataFrame:
    """df with out_col, the text of the ids in ids_col; null and empty lists give "".

    Lists of any length are decoded whole. Rows are independent: repeats get equal results, an empty df stays empty.
    An out_col already there is replaced; other columns pass through, whatever their names.
    """
    pair, made_col = spare(df, "ids_in", "ids_out")

    def of(column: pa.Array) -> list[dict]:
        lists = [x or [] for x in column.field(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return [{"text": t} for t in codec(path).decode(offsets, np.array([k for x in lists for k in x], np.int64))]

    ship(df.sparkSession, path)
    ids = F.col(f"`{ids_col}`")
    size = F.lpad(F.lit(""), 4 * F.greatest(F.size(ids), F.lit(0)), " ")  # rows are sliced by the first field's bytes
    made = with_struct(df.withColumn(pair, F.struct(size.alias("size"), ids.alias("ids"))), pair, made_col, pa.struct([("text", pa.string())]), of)
    return made.withColumn(out_col, F.col(made_col)["text"]).drop(pair, made_col)
