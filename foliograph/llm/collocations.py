"""Phrases whose words stand together more often than their parts would by chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, small_batches
from ._common import stored
from ._hash import mixed
from ._hot import BITMAP_WORDS, by_key

#: Phrases have so many words at most and occur so often at least; of each language so many are returned.
LONGEST, LEAST, MOST = 5, 100, 2000
#: A candidate goes if a longer one around it occurs at least in so many of a hundred of its places.
ABSORBED = 100
#: Frequent words, and characters of them, up to which the dictionary is sent to the tasks; a larger one meets the words by joins.
DICT_WORDS, DICT_CHARS = 1_000_000, 16_000_000
#: Bytes of text that are tokenized, and ids whose windows are sorted, at a time.
TEXT_BYTES, WINDOW_IDS = 4 << 20, 1 << 21
UNKNOWN = "und"
WIDTH = 4  # bytes of an id in a key

ENDS = ".,;:!?\n\v\f\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS.encode(), b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS))


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row of each, whether a piece begins with it) of whole texts; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    plain = bytes(memoryview(data)[ends[0] : ends[-1]]).translate(_PLAIN) if ends[-1] > ends[0] else b""
    raw, ends = np.frombuffer(plain, np.uint8), ends - ends[0]
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, bool)
    black, edge = (raw != 0x20) & (raw != 0x0A), np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    begins = np.flatnonzero(black & (edge[:-1] | ~np.concatenate([[False], black[:-1]])))
    stops = np.flatnonzero(black & (edge[1:] | ~np.append(black[1:], False))) + 1
    # words and what is between them in turn, of which the words are taken
    bounds = np.stack([begins, stops], 1).ravel().astype(np.int64)
    both = pa.LargeStringArray.from_buffers(max(len(bounds) - 1, 0), pa.py_buffer(bounds), pa.py_buffer(plain))
    row = np.searchsorted(ends, begins, side="right") - 1
    apart = np.concatenate([[0], np.cumsum(raw == 0x0A)])
    first = np.ones(len(begins), bool)
    first[1:] = (row[1:] != row[:-1]) | (apart[begins[1:]] != apart[stops[:-1]])
    return both.take(pa.array(np.arange(0, len(bounds), 2))), row, first


def _by_language(words: pa.Array, row: np.ndarray, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(index of each word among the different (language, word), their counts, their languages, their words)."""
    word, lang = words.dictionary_encode(), langs.dictionary_encode()
    code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * max(len(word.dictionary), 1) + word.indices.to_numpy(zero_copy_only=False)
    kinds, which, counts = np.unique(code, return_inverse=True, return_counts=True)
    size = max(len(word.dictionary), 1)
    return which, counts, lang.dictionary.take(pa.array(kinds // size)), word.dictionary.take(pa.array(kinds % size))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) from (lang, text); a task sends one row for each different word of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                words, row, _ = tokens(batch.column(1).slice(a, b - a))
                _, counts, langs, kinds = _by_language(words, row, batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), kinds.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """words (lang, word, n) with a dense id from 1 in the order of language and word."""
    split = stored(words.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    sizes = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}  # a row for each partition
    before, start = [], 1
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(start)]
        start += sizes[part]
    at = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(1)
    return stored(split.select("lang", "word", "n", (at + F.col("k")).cast("int").alias("id")))


def _runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ids of one slice with 0 before each piece and in place of other words; words without a neighbour go."""
    out = np.zeros(len(ids) + first.sum() + 1, np.int32)
    out[np.arange(len(ids)) + np.cumsum(first)] = ids
    before, after = np.concatenate([[0], out[:-1]]), np.append(out[1:], 0)
    out = np.where((before == 0) & (after == 0), 0, out)
    return out[(out != 0) | (np.concatenate([[1], out[:-1]]) != 0)]


def encoded(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(ids array<int>) of many texts each: ids of words in the dictionary, 0 between pieces and for all other words."""
    table = dictionary.select("lang", "word", "id").toArrow()  # callers have checked its size
    by_lang: dict[str, dict[str, int]] = {}
    for lang, word, i in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
        by_lang.setdefault(lang, {})[word] = i
    held = texts.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                words, row, first = tokens(batch.column(1).slice(a, b - a))
                which, _, langs, kinds = _by_language(words, row, batch.column(0).slice(a, b - a))
                known = np.fromiter((held.value.get(x, {}).get(w, 0) for x, w in zip(langs.to_pylist(), kinds.to_pylist(), strict=True)), np.int32, len(kinds))
                ids = _runs(known[which] if len(words) else np.zeros(0, np.int32), first)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["ids"])

    return texts.mapInArrow(run, "ids array<int>")


def encoded_by_joins(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """As encoded(), a row for each text, for dictionaries of any size: words with their places are joined to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                words, row, first = tokens(batch.column(1).slice(a, b - a))
                place = np.arange(len(words)) + np.cumsum(first)  # a piece leaves a place free
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(row)), part.column(0).take(pa.array(row)), pa.array(place.astype(np.int64)), words.cast(pa.string())], names=["r", "lang", "place", "word"])

    rows = texts.select("lang", "text", F.monotonically_increasing_id().alias("r")).mapInArrow(run, "r bigint, lang string, place bigint, word string")
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    known = by_key(rows, dictionary, ["lang", "word"], "n", total).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("x"))  # a text is the group
    joined = F.transform("x", lambda w, i: F.when((i > 0) & (F.get("x", i - 1)["place"] + 1 == w["place"]), F.array(w["id"])).otherwise(F.array(F.lit(0), w["id"])))
    return known.select(F.flatten(joined).alias("ids"))


def _slots(left: np.ndarray, right: np.ndarray, words: int) -> np.ndarray:
    return mixed((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) & np.uint64(64 * words - 1)


def bitmap(pairs: DataFrame, n_pairs: int) -> np.ndarray:
    """Words of 64 bits in which those of all pairs (key) are set: at most BITMAP_WORDS of them, so they may go to the driver and to tasks."""
    words = 64
    while words < BITMAP_WORDS and words * 8 < n_pairs:
        words *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(0))
            slots = _slots(ids[:, 0], ids[:, 1], words)
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    out = np.zeros(words, np.uint64)
    made = pairs.select("key").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return out


def _ids(keys: pa.Array) -> np.ndarray:
    """The ids (n, LONGEST) of packed keys, 0 after the last."""
    if pa.types.is_integer(keys.type):
        both = keys.to_numpy(zero_copy_only=False)
        return np.stack([both >> 32, both & 0xFFFFFFFF, *[np.zeros_like(both)] * (LONGEST - 2)], 1).astype(np.uint32)
    _, _, data = keys.buffers()
    width = WIDTH * LONGEST
    raw = np.frombuffer(data, np.uint8)[keys.offset * width : (keys.offset + len(keys)) * width] if len(keys) else np.zeros(0, np.uint8)
    return raw.view(">u4").reshape(-1, LONGEST).astype(np.uint32)


def _keys(ids: np.ndarray) -> pa.Array:
    """Fixed-width binary keys of ids (n, m): big-endian, so that they sort as the ids do."""
    wide = np.zeros((len(ids), LONGEST), ">u4")
    wide[:, : ids.shape[1]] = ids
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * (WIDTH * LONGEST)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(wide.tobytes())])


def _short_keys(ids: np.ndarray) -> pa.Array:
    """The same for pairs, as whole numbers: less than half as long in a shuffle."""
    return pa.array(ids[:, 0].astype(np.int64) << 32 | ids[:, 1].astype(np.int64))


def _sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(different rows (n, m) in order, how often each occurs) by a radix sort over 16-bit digits, which is what numpy's stable sort of them is."""
    order = None
    for column in reversed(columns):
        for digit in ((column & 0xFFFF).astype(np.uint16), (column >> 16).astype(np.uint16)):
            if order is None:
                order = np.argsort(digit, kind="stable")
            elif digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    rows = np.stack([c[order] for c in columns], 1)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def counted(ids: DataFrame, sizes: tuple[int, ...], least: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(key, size, a): windows of sizes[0], ... ids without a 0, occurring `least` times or more; with pairs only those whose pairs are all in it.

    A task sorts and counts the windows of WINDOW_IDS ids, so each different one is a row. Those are dealt by ranges of
    keys, sorted, and the runs of equal keys summed.
    """
    held = ids.sparkSession.sparkContext.broadcast(pairs)
    packed, kind = (_short_keys, "bigint") if sizes == (2,) else (_keys, "binary")

    def windows(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        there = x != 0
        fits = there[:-1] & there[1:]
        if held.value is not None:
            slots = _slots(x[:-1], x[1:], len(held.value))
            fits &= (held.value[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)
        now = fits
        for m in range(2, max(sizes) + 1):
            if m > 2:
                now = now[:-1] & fits[m - 2 :]
            at = np.flatnonzero(now)
            if m in sizes and len(at):
                kinds, counts = _sorted_runs([x[at + k] for k in range(m)])
                yield pa.RecordBatch.from_arrays([packed(kinds), pa.array(counts.astype(np.int64))], names=["key", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, n = [], 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            held_ids += [x, np.zeros(1, np.int32)]  # no window reaches over two rows
            n += len(x)
            if n >= WINDOW_IDS:
                yield from windows(np.concatenate(held_ids))
                held_ids, n = [], 0
        if n:
            yield from windows(np.concatenate(held_ids))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = _ids(batch.column(0)), batch.column(1).to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(1)
            at = np.flatnonzero(new)
            sums, kinds = np.add.reduceat(n, at), keys[at]
            if last is not None:
                if (last == kinds[0]).all():
                    sums[0] += total
                else:
                    yield told(last[None], np.array([total]))
            last, total = kinds[-1], int(sums[-1])  # its run may go on in the next batch
            yield told(kinds[:-1], sums[:-1])
        if last is not None:
            yield told(last[None], np.array([total]))

    def told(kinds: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        often = np.flatnonzero(sums >= least)
        kinds = kinds[often]
        return pa.RecordBatch.from_arrays([_keys(kinds), pa.array((kinds != 0).sum(1).astype(np.int32)), pa.array(sums[often].astype(np.int64))], names=["key", "size", "a"])

    found = stored(ids.mapInArrow(runs, f"key {kind}, n bigint"))  # read twice: for the ranges, and to be dealt
    return stored(found.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(summed, "key binary, size int, a bigint"))


def _part(key: Column, begin: Column, size: Column) -> Column:
    """The key of `size` ids of a key, from the one at `begin` (from 0)."""
    ids = F.substring(key, begin * WIDTH + 1, size * WIDTH)
    return F.concat(ids, F.substring(F.lit(bytes(WIDTH * LONGEST)), F.lit(1), (F.lit(LONGEST) - size) * WIDTH))


def _looked_up(asked: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """asked joined to table, where many rows may ask for the same key."""
    asked = stored(asked)
    sizes = asked.groupBy(on).agg(F.count("*").alias("asked_for"))
    return by_key(asked, stored(sizes.join(table, on)), [on], "asked_for", asked.count())


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly; the products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = MOST, dict_words: int = DICT_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `most` phrases.

    Texts are lower-cased (A-Z) and split at ENDS into pieces, those at blanks and tabs into words. Phrases of two to
    LONGEST words that occur `least` times or more are scored by their worst cut. A phrase goes if a longer one around
    it occurs in ABSORBED of a hundred of its places. A null text is empty, a null language UNKNOWN; whole texts of any
    length are read, repeated rows count each, an empty table gives no rows, other columns aren't read. Equal scores
    are ranked by a, then by the phrase's bytes.

    Each phrase of frequent words only can be frequent, so all others end a piece, and of longer phrases only those are
    counted whose pairs may all be frequent: by a bitmap of bounded size, whose false bits cost time but change nothing.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    words = stored(word_counts(texts))
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    dictionary = numbered(words.where(F.col("n") >= least))
    n_words, n_chars = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    in_tasks = n_words <= dict_words and n_chars <= DICT_CHARS
    ids = stored((encoded if in_tasks else encoded_by_joins)(texts, dictionary))

    pairs = counted(ids, (2,), least)
    longer = counted(ids, tuple(range(3, LONGEST + 1)), least, bitmap(pairs, pairs.count()))
    phrases = stored(pairs.unionByName(longer))
    id_key = F.concat(F.unhex(F.lpad(F.hex("id"), 2 * WIDTH, "0")), F.lit(bytes(WIDTH * (LONGEST - 1))))
    all_counts = phrases.select(F.col("key").alias("part"), "a").unionByName(dictionary.select(id_key.alias("part"), F.col("n").alias("a")))

    # the counts of both sides of each cut
    cuts = phrases.select("key", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit(True).alias("is_left"), _part(F.col("key"), F.lit(0), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("is_left"), _part(F.col("key"), F.col("cut"), F.col("size") - F.col("cut")).alias("part")))
    met = _looked_up(cuts.select("key", "cut", F.explode(sides).alias("s")).select("key", "cut", "s.*"), all_counts, "part")
    of_cut = met.groupBy("key", "cut").agg(F.max(F.when(F.col("is_left"), F.col("a"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("a"))).alias("r"))
    by_phrase = of_cut.groupBy("key").agg(F.collect_list(F.struct("cut", "l", "r")).alias("cuts"))

    # the most places that a longer phrase around it takes
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("size") - m), lambda b: _part(F.col("key"), b, m))))
    around = phrases.where("size > 2").select("a", F.explode(spans).alias("key")).groupBy("key").agg(F.max("a").alias("around"))

    # the words, in their places
    places = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(i.alias("place"), F.conv(F.hex(F.substring("key", i * WIDTH + 1, F.lit(WIDTH))), 16, 10).cast("int").alias("id")))
    spelled = _looked_up(phrases.select("key", F.explode(places).alias("p")).select("key", "p.*"), dictionary.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    spelled = spelled.select("key", "lang", F.array_join(F.col("w.word"), " ").alias("phrase"))

    kept = phrases.join(around, "key", "left").where(F.col("around").isNull() | (100 * F.col("around") < ABSORBED * F.col("a"))).select("key", "a")
    rows = kept.join(by_phrase, "key").join(spelled, "key").join(totals, "lang")
    worst = F.array_min(F.transform("cuts", lambda c: F.struct(score(F.col("a"), F.col("n"), c["l"], c["r"]).alias("score"), c["cut"].alias("cut"), c["l"].alias("l"), c["r"].alias("r"))))
    rows = stored(rows.select("lang", "phrase", "a", "n", worst.alias("worst")).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score"))
    # the best of each of some parts first, so no task ranks all of a language
    by = "ORDER BY score DESC, a DESC, phrase"
    few = rows.selectExpr("*", f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), 64) {by}) AS k").where(F.col("k") <= most)
    ranked = few.selectExpr("lang", f"CAST(row_number() OVER (PARTITION BY lang {by}) AS BIGINT) AS rank", "phrase", "a", "l", "r", "n", "score")
    return ranked.where(F.col("rank") <= most)
