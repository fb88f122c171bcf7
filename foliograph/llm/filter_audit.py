"""What each of several filters removes, for every order in which they may be applied."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, stored, words_of
from ._hot import by_key, in_bitmap

#: Letter of a filter -> whether a text fails it, of (text, struct<words, distinct: int>).
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, w: w["words"] < 50,
    "B": lambda text, w: 100 * w["distinct"] < 65 * w["words"],
    "C": lambda text, w: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
    "D": lambda text, w: text.rlike("[#$%&*|]"),
}
#: The filter that equal texts fail.
DUPLICATE = "E"
#: Blocks of a text, in code points: bounds between those whose hashes refine the classes one after the other. The last has all the rest.
BOUNDS = (256, 4096)


def block_hashes(text: Column, bounds: tuple[int, ...] = BOUNDS, hashed: Callable[[Column], Column] = F.xxhash64) -> dict[str, Column]:
    """Columns h0, h1, ...: a hash of each block of a text."""
    ends = [0, *bounds, None]
    # substring's length is an int; the last block takes as many as there can be
    return {f"h{k}": hashed(F.substring(text, a + 1, (b - a) if b is not None else 2**31 - 1 - a)) for k, (a, b) in enumerate(itertools.pairwise(ends))}


def duplicates(rows: DataFrame, texts: DataFrame, levels: list[str]) -> DataFrame:
    """The rows (id, part, mask, levels) whose text a row with a smaller id has; texts are the same rows with their text.

    Classes of rows with the same levels so far are refined by one more level each time, and rows that are alone in
    their class are dropped. Whole texts of what is left are grouped; equal ones become one row in the task that reads
    them, before the shuffle.
    """
    total, live, keys = rows.count(), rows, []
    for level in levels:
        keys = [*keys, level]
        shared = stored(live.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"))
        live = stored(by_key(live, shared, keys, "size", total))
    asked = in_bitmap(texts, shared, keys, shared.count())
    by_text = stored(asked.groupBy(*keys, "text").agg(F.min("id").alias("least")))
    exact = stored(by_text.groupBy(*keys).agg(F.count("*").alias("texts"), F.min("least").alias("least")).join(shared, keys))
    same = by_key(live, exact.where("texts = 1").drop("texts"), keys, "size", total)
    # different texts with the same length and hashes: their rows meet by the text itself
    clash = exact.where("texts > 1").select(*keys)
    split = by_text.join(clash, keys, "left_semi")
    apart = in_bitmap(texts, clash, keys, clash.count()).join(split, [*keys, "text"])
    return same.select(*rows.columns, "least").unionByName(apart.select(*rows.columns, "least")).where("id > least").drop("least")


def orders(letters: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it)."""
    bit = {c: 1 << k for k, c in enumerate(letters)}
    return [("".join(p), k + 1, bit[c], sum(bit[x] for x in p[:k])) for p in itertools.permutations(letters) for k, c in enumerate(p)]


def interactions(masks: DataFrame, letters: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, from rows (part, mask, n, good, toxic).

    Bit k of a mask says that a document fails letters[k]; each mask comes once a part at most. Numbers of a part are
    one array over the masks, so parts don't meet.
    """
    size, names = 1 << len(letters), ("n", "good", "toxic")
    at = F.collect_list(F.struct("mask", *names))
    filled = let(F.col("at"), lambda have: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: let(F.filter(have, lambda x: x["mask"] == m), lambda x: F.struct(*(F.coalesce(F.get(x, F.lit(0))[c], F.lit(0).cast("long")).alias(c) for c in names)))))
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("before")) for o, s, b, e in orders(letters)))

    def total(which: Callable[[Column], Column], what: str = "n") -> Column:
        chosen = F.transform(F.col("by_mask"), lambda x, m: F.when(which(m), x[what]).otherwise(F.lit(0).cast("long")))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x)

    bit, before = F.col("s")["bit"], F.col("s")["before"]
    fails, earlier = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~earlier(m)
    # a filter removes a document in those orders in which it comes before all others that the document fails
    shares = F.transform(F.col("by_mask"), lambda x, m: F.when(fails(m), x["n"] * (F.lit(math.factorial(len(letters))) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = masks.groupBy("part").agg(at.alias("at")).select("part", filled.alias("by_mask")).select("part", "by_mask", F.explode(steps).alias("s"))
    return rows.select(
        "part", F.col("s")["filter_order"].alias("filter_order"), F.col("s")["step"].alias("step"),
        total(lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total(here).alias("removed"), total(lambda m: fails(m) & earlier(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part.

    The filters and DUPLICATE, which a row fails whose whole text some row with a smaller id has, are audited in all
    their orders. labels: id_col, quality, toxic; a document is good (toxic) if a row of it says so. A null text is
    empty and a null part the empty string. A row with a null id is no duplicate and makes none; rows that repeat with
    the same id don't either, and each counts. Texts of any length are read whole. An empty table has no parts. Other
    columns, whatever their names, aren't read. Texts move only where length and hashes of all blocks agree, and one
    for each different text and task; the rest are counts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    letters = [*filters, DUPLICATE]
    read = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))

    def mask(x: Column) -> Column:
        fails = [F.when(F.coalesce(f(x["text"], x["w"]), F.lit(False)), 1 << k).otherwise(0) for k, f in enumerate(filters.values())]
        return reduce(lambda a, b: a.bitwiseOR(b), fails)

    levels = {"n_points": F.length("text"), **block_hashes(F.col("text"), hashed=hashed)}
    masked = let(F.struct(F.col("text").alias("text"), words.alias("w")), mask).alias("mask")
    texts = read.select("id", "part", masked, *(c.alias(n) for n, c in levels.items()), "text")
    rows = stored(texts.drop("text"))
    twice = duplicates(rows, texts, [*levels]).select("id", "part", "mask")

    # each row counts without the duplicates' bit; a duplicate moves from its mask to the one with that bit
    moved = F.array(F.struct(F.col("mask"), F.lit(-1).alias("by")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask"), F.lit(1).alias("by")))
    counted = rows.select("id", "part", "mask", F.lit(1).alias("by")).unionByName(twice.select("id", "part", F.explode(moved).alias("x")).select("id", "part", "x.mask", "x.by"))
    good, toxic = (F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic"))
    said = labels.select(F.col(f"`{id_col}`").alias("id"), "quality", "toxic").where("id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("id").agg(good, toxic)
    by = F.col("by").cast("long")
    sums = counted.join(said, "id", "left").groupBy("part", "mask").agg(F.sum(by).alias("n"), F.coalesce(F.sum(by * F.col("quality")), F.lit(0)).alias("good"), F.coalesce(F.sum(by * F.col("toxic")), F.lit(0)).alias("toxic"))
    return interactions(sums, letters)
