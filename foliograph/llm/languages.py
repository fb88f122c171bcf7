"""Language identification by interpolated Kneser-Ney models of characters."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import with_struct
from ._common import stored
from ._hash import BASE, MIX, mixed

#: Characters of a gram at most.
ORDER = 5
#: A language is learned from so many rows at most, the same number from each of BUCKETS ranges of a hash of the id ...
FIT_ROWS, BUCKETS = 4000, 16
#: ... and from so many characters at most, in the order of that hash; texts are taken whole or not at all.
FIT_CHARS = 1 << 20
#: One of so many of the rows taken is kept from the counts, for the calibration.
HOLD = 5
#: Symbols that a language may have: what is left over for unseen ones is shared by so many.
ALPHABET = 1000
#: Positions that are scored at a time.
BLOCK = 1 << 20
#: A row is accepted if its entropy is at most this quantile of the language's own calibration rows, times SLACK, and its score at least MIN_SCORE.
QUANTILE, SLACK, MIN_SCORE = 0.99, 1.1, 0.5
UNKNOWN = "und"
RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("accepted", pa.bool_()), ("n_symbols", pa.int64())])


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, row of each, which are padding) of whole texts.

    Letters in lower case stand for themselves, what is between them for one blank; ORDER - 1 blanks are put before
    each text, so no gram reaches over two.
    """
    lower = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(lower).to_numpy(zero_copy_only=False))]).astype(np.int64)
    _, offsets, data = lower.buffers()
    at = np.frombuffer(offsets, np.int64)[lower.offset : lower.offset + len(lower) + 1] if len(lower) else np.zeros(1, np.int64)
    points = np.frombuffer(bytes(memoryview(data)[at[0] : at[-1]]).decode().encode("utf-32-le"), np.uint32) if at[-1] > at[0] else np.zeros(0, np.uint32)
    letter = _letters()[points]
    after = np.zeros(len(points), bool)
    after[1:] = letter[:-1]
    after[ends[:-1][ends[:-1] < len(points)]] = False
    keep = letter | after
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    row, pad = np.repeat(np.arange(len(column)), np.diff(kept)), ORDER - 1
    out = np.full(kept[-1] + pad * len(column), 32, np.uint32)
    padding, rows = np.ones(len(out), bool), np.repeat(np.arange(len(column)), np.diff(kept) + pad)
    place = np.arange(kept[-1]) + pad * (row + 1)
    out[place] = np.where(letter, points, 32)[keep]
    padding[place] = False
    return out, rows, padding


def grams(part: np.ndarray) -> list[np.ndarray]:
    """For each length up to ORDER a hash of the gram of that length that ends at each position."""
    one = mixed((part.astype(np.uint64) + np.uint64(1)) * MIX)
    out = [one]
    for _ in range(ORDER - 1):
        before = np.zeros_like(one)
        before[1:] = out[-1][:-1]
        out.append(before * BASE + one)
    return out


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted keys, whether it is there) of each."""
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return at, (keys[at] == asked if len(keys) else np.zeros(len(asked), bool))


@dataclass(frozen=True)
class CharModel:
    """One language: for each order sorted hashes of grams with log probabilities, and of contexts with log back-off weights."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float

    @classmethod
    def fit(cls, part: np.ndarray, padding: np.ndarray) -> CharModel:
        """Counts of whole grams for the longest, of different left neighbours for all shorter ones."""
        hashes, scored = grams(part), np.flatnonzero(~padding)
        places, counts = {}, {}
        _, first, counts[ORDER] = np.unique(hashes[-1][scored], return_index=True, return_counts=True)
        places[ORDER] = scored[first]
        for k in range(ORDER - 1, 0, -1):
            longer = places[k + 1]
            _, first, counts[k] = np.unique(hashes[k - 1][longer], return_index=True, return_counts=True)
            places[k] = longer[first]
        keys, logp, contexts, backoff = [], [], [], []
        below, unseen = None, 0.0
        for k in range(1, ORDER + 1):
            at, c = places[k], counts[k].astype(float)
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
            context = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
            kinds, which = np.unique(context, return_inverse=True)
            total, types = np.bincount(which, c), np.bincount(which)
            rest = discount * types / total
            if k == 1:
                lower = 1 / ALPHABET
                unseen = float(np.log(rest[0] * lower)) if len(rest) else float(np.log(lower))
            else:
                lower = below[1][_found(below[0], hashes[k - 2][at])[0]]
                contexts.append(kinds)
                backoff.append(np.log(rest).astype(np.float32))
            p = np.maximum(c - discount, 0) / total[which] + rest[which] * lower
            below = (hashes[k - 1][at], p)  # np.unique has sorted them
            keys.append(below[0])
            logp.append(np.log(p).astype(np.float32))
        return cls(keys, logp, contexts, backoff, unseen)

    def scores(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log probability of the symbol at each place after those before it."""
        out = np.full(len(at), self.unseen)
        for k in range(ORDER):
            if k:
                place, there = _found(self.contexts[k - 1], hashes[k - 1][at - 1])
                out += np.where(there, self.backoff[k - 1][place], 0) if len(self.backoff[k - 1]) else 0
            place, there = _found(self.keys[k], hashes[k][at])
            if len(self.keys[k]):
                out = np.where(there, self.logp[k][place], out)
        return out


@dataclass(frozen=True)
class Languages:
    """Models by language, in the order of their names; how sure a difference of entropies makes, and each one's limit."""

    names: list[str]
    models: list[CharModel]
    sharpness: float = 1.0
    limits: tuple[float, ...] = ()

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of each text, bits a symbol of each text for each language); texts without a letter have no symbol."""
        out, rows, padding = symbols(column)
        sums = np.zeros((len(self.models), len(column)))
        for begin in range(0, len(out), BLOCK):
            back = min(begin, ORDER - 1)
            part = out[begin - back : begin + BLOCK]
            hashes, scored = grams(part), np.flatnonzero(~padding[begin : begin + BLOCK]) + back
            if not len(scored):
                continue
            kind, whole = pd.factorize(hashes[-1][scored])  # each different gram is looked up once
            first = np.empty(len(whole), np.int64)
            first[kind[::-1]] = scored[::-1]
            row = rows[begin - back :][scored]
            for i, model in enumerate(self.models):
                sums[i] -= np.bincount(row, model.scores(hashes, first)[kind], len(column))
        n = np.bincount(rows[~padding], minlength=len(column))
        return n, (sums / np.log(2) / np.maximum(n, 1)).T

    def posteriors(self, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return posteriors(n, bits, self.sharpness)

    def __call__(self, column: pa.Array) -> pa.Array:
        n, bits = self.entropies(column)
        if not self.models:
            return pa.array([{"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": None, "accepted": False, "n_symbols": int(k)} for k in n], type=RESULT)
        best = bits.argmin(1)
        score, own = self.posteriors(n, bits)[np.arange(len(n)), best], bits[np.arange(len(n)), best]
        known = n > 0
        accepted = known & (score >= MIN_SCORE) & (own <= np.asarray(self.limits)[best])
        names = [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(own, mask=~known), pa.array(accepted), pa.array(n.astype(np.int64))], fields=list(RESULT))


def posteriors(n: np.ndarray, bits: np.ndarray, sharpness: float) -> np.ndarray:
    """Of each language by its entropy, which counts the more the longer a text is: by the root of its symbols."""
    x = -sharpness * np.sqrt(n)[:, None] * (bits - bits.min(1, keepdims=True))
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


def calibrated(names: list[str], models: list[CharModel], truth: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Languages:
    """Sharpness of least log loss over rows kept from the counts, and limits from each language's own."""
    have = n > 0
    truth, n, bits = truth[have], n[have], bits[have]
    grid = np.geomspace(0.01, 100, 41)
    loss = [-np.log(np.maximum(posteriors(n, bits, s)[np.arange(len(n)), truth], 1e-12)).sum() for s in grid]
    limits = [float(np.quantile(bits[truth == i, i], QUANTILE)) * SLACK if (truth == i).any() else float("inf") for i in range(len(names))]
    return Languages(names, models, float(grid[int(np.argmin(loss))]) if len(n) else 1.0, tuple(limits))


def sample(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """(lang, text, hold) of at most fit_rows rows and fit_chars characters of each language; labelled: id, text, lang.

    Only ids and lengths are ranked. Of each range of hashes fit_rows / BUCKETS rows are taken at most, so no window
    has all of a language's rows.
    """
    ranked = labelled.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("id", "lang", F.length("text").alias("chars"), F.xxhash64("id", F.lit(3)).alias("h"))
    bucket = F.pmod("h", F.lit(BUCKETS))
    few = ranked.withColumn("bucket", bucket).selectExpr("*", "row_number() OVER (PARTITION BY lang, bucket ORDER BY h, id) AS r").where(F.col("r") <= -(-fit_rows // BUCKETS))
    upto = stored(few.selectExpr("id", "lang", "h", "sum(chars) OVER (PARTITION BY lang ORDER BY h, id) AS upto").where(F.col("upto") <= fit_chars).select("id", "lang", (F.pmod(F.shiftright("h", 8), F.lit(HOLD)) == 0).alias("hold")).distinct())
    # at most fit_rows ids a language, so they may be broadcast to where the texts are
    return stored(labelled.select("id", "text", "lang").join(F.broadcast(upto), ["id", "lang"]).select("lang", "text", "hold"))


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Languages:
    """Models of the languages in lang_col, each counted in one task from its bounded sample.

    Rows with a null id, text or language teach nothing. The arrays of a language have an entry for each different gram
    of its fit_chars characters at most, so the driver may gather and broadcast them.
    """
    rows = sample(labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")), fit_rows, fit_chars)

    def counted(table: pa.Table) -> pa.Table:
        text = table.column("text").combine_chunks()
        part, _, padding = symbols(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
        m = CharModel.fit(part, padding)
        blobs = {n: [[x.tobytes() for x in getattr(m, n)]] for n in ("keys", "logp", "contexts", "backoff")}
        return pa.table({"lang": table.column("lang").slice(0, 1), **{n: pa.array(b, pa.list_(pa.binary())) for n, b in blobs.items()}, "unseen": [m.unseen]})

    made = rows.where("NOT hold").groupBy("lang").applyInArrow(counted, "lang string, keys array<binary>, logp array<binary>, contexts array<binary>, backoff array<binary>, unseen double").collect()
    kinds = {"keys": np.uint64, "logp": np.float32, "contexts": np.uint64, "backoff": np.float32}
    by_name = {r["lang"]: CharModel(**{n: [np.frombuffer(b, t) for b in r[n]] for n, t in kinds.items()}, unseen=r["unseen"]) for r in made}
    names = sorted(by_name)
    models = [by_name[n] for n in names]
    if not models:
        return Languages([], [])
    held = rows.sparkSession.sparkContext.broadcast(Languages(names, models))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bits = held.value.entropies(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(bits.tolist(), pa.list_(pa.float64()))], names=["lang", "n", "bits"])

    seen = rows.where("hold").select("lang", "text").where(F.col("lang").isin(names)).mapInArrow(weighed, "lang string, n bigint, bits array<double>").collect()
    truth = np.array([names.index(r["lang"]) for r in seen], np.int64)
    return calibrated(names, models, truth, np.array([r["n"] for r in seen], np.int64), np.array([r["bits"] for r in seen], float).reshape(len(seen), len(names)))


def detect_language(df: DataFrame, languages: Languages, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """df with out_col: struct<lang_pred, score, cross_entropy, accepted, n_symbols>.

    lang_pred is the language of the least bits a symbol, of equals the first by name; UNKNOWN where the text is null
    or has no letter, with score 0. score is the calibrated probability of that language among those learned;
    accepted is false where the text is less like its language than nearly all of that language's own texts are, or the
    score is low. Whole texts of any length are read, in blocks. Repeated rows get equal results, an empty table stays
    empty; without any model every row is UNKNOWN. A column out_col that is there is replaced, all others pass through.
    """
    held = df.sparkSession.sparkContext.broadcast(languages)
    return with_struct(df, text_col, out_col, RESULT, lambda column: held.value(column))


def held_out(id_col: Column) -> Column:
    """Rows to test on: those whose id's CRC-32 leaves 2 by 4. Null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2
