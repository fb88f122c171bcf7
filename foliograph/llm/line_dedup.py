"""Line dedup over content-defined chunks of lines, in built-in functions only.

Lines are the \\n-split lines of a text, wrapped after every tenth word: a paragraph on one physical line is several
lines here. A physical line that makes LEAST lines or more is a stretch, and so is a run of shorter ones. Chunks end
with their stretch, and inside it where a rolling hash over three line hashes says so, LEAST lines apart at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, spare

#: A boundary may stand before a line if the rolling hash of it and the two lines before is 0 modulo this.
MODULUS = 3
#: Lines that a chunk has, if its stretch has as many.
LEAST = 3
#: The rolling hash of lines a, b, c is (a * BASE^2 + b * BASE + c) mod PRIME, so each of them counts.
BASE, PRIME = 31, 1_000_003
#: Ten words and the spaces after them, or what of that is left at a line's end.
WRAPPED = "[^ ]+(?: +[^ ]+){0,9} *| +"


def _lines(text: Column) -> Column:
    """array<struct<row, text, hash, opens>>: the lines of a text, with the number of the physical line that each is in and whether it is its first."""

    def wrapped(x: Column, row: Column) -> Column:
        parts = F.when(x == "", F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(WRAPPED), F.lit(0)))
        return F.transform(parts, lambda u, i: F.struct(row.alias("row"), u.alias("text"), F.conv(F.substring(F.md5(u), 1, 7), 16, 10).cast("long").alias("hash"), (i == 0).alias("opens")))

    return F.flatten(F.transform(F.split(text, "\n"), wrapped))


def chunks(text: Column, modulus: int = MODULUS) -> Column:
    """array<struct<text, lines, first, last>>: the chunks of a text in order; first and last are physical lines' numbers.

    Whether a boundary stands before a line depends on itself, the four lines before it and on whether the two after it
    are in the same stretch; lines put in or taken out elsewhere don't move it. Chunks of fewer than LEAST lines are
    whole stretches. A null text has no chunks.
    """

    def marked(lines: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            before = F.get(lines, i - 1)
            long_line, after_long = F.get(lines, i + LEAST - 1)["row"].eqNullSafe(x["row"]), F.get(lines, i - LEAST)["row"].eqNullSafe(before["row"])
            starts = (i == 0) | (x["opens"] & (long_line | after_long))
            rolled = F.get(lines, i - 2)["hash"] * BASE * BASE + before["hash"] * BASE + x["hash"]
            return F.struct(starts.alias("starts"), (F.pmod(F.pmod(rolled, F.lit(PRIME)), F.lit(modulus)) == 0).alias("hit"))

        return let(F.transform(lines, mark), lambda marks: cut(lines, marks))

    def cut(lines: Column, marks: Column) -> Column:
        def inside(i: Column) -> Column:
            """The hash of the line and the two before it hits, and all three are in one stretch."""
            return F.get(marks, i)["hit"] & ~F.get(marks, i)["starts"] & ~F.get(marks, i - 1)["starts"]

        def begins(m: Column, i: Column) -> Column:
            room = inside(i)
            for d in range(1, LEAST):
                room = room & ~F.get(marks, i - d)["starts"] & ~F.coalesce(F.get(marks, i + d)["starts"], F.lit(True)) & ~inside(i - d)
            return F.when(m["starts"], True).otherwise(m["hit"] & F.coalesce(room, F.lit(False)))

        at = F.filter(F.transform(marks, lambda m, i: F.when(begins(m, i), i)), lambda i: i.isNotNull())
        return let(F.concat(at, F.array(F.size(lines))), lambda at: spans(lines, at))

    def spans(lines: Column, at: Column) -> Column:
        def joined(x: Column) -> Column:
            text = F.array_join(F.transform(x, lambda u, i: F.when(u["opens"] & (i > 0), F.concat(F.lit("\n"), u["text"])).otherwise(u["text"])), "")
            return F.struct(text.alias("text"), F.size(x).alias("lines"), F.get(x, F.lit(0))["row"].alias("first"), F.element_at(x, -1)["row"].alias("last"))

        return F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, k: let(F.slice(lines, a + 1, F.get(at, k + 1) - a), joined))

    nothing = F.array().cast("array<struct<text:string,lines:int,first:int,last:int>>")
    return F.when(text.isNull(), nothing).otherwise(let(_lines(text), marked))


def _key(c: Column) -> Column:
    """What a chunk is looked up by; null if it isn't: it has fewer than LEAST lines, or no word."""
    asked = (c["lines"] >= LEAST) & c["text"].rlike("[^ \\t-\\r]")
    return F.when(asked, F.struct(F.xxhash64(F.lit(1), c["text"]).alias("k1"), F.xxhash64(F.lit(2), c["text"]).alias("k2"), F.octet_length(c["text"]).alias("n")))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, modulus: int = MODULUS) -> DataFrame:
    """df with the repeated chunks of lines taken out of text_col, and their number in count_col if that is given.

    A chunk of several lines that occurs more than once in the table stays only in the row with the least id among
    those that have it (a null id comes first), and there at its first place. Rows with that same id all keep it.
    Chunks meet by two 64-bit hashes and their length; they go only if the bytes of all that meet are equal. What
    stays keeps its line breaks and spaces; a physical line of which nothing stays goes.
    Rows are never dropped: a text of nothing but repeats becomes empty, a null text stays null, an empty df stays
    empty. Ids of any type that can be ordered will do, and a text of any length is one row. Other columns pass
    through, whatever their names; a count_col already there is replaced.
    """
    text = F.col(f"`{text_col}`")
    # rows alike in id and text are treated alike, so these three name what is done to a row
    own_id, h1, h2, gone = names = spare(df, "own_id", "h1", "h2", "gone")
    keyed = {own_id: F.col(f"`{id_col}`"), h1: F.xxhash64(F.lit(3), text), h2: F.xxhash64(F.lit(4), text)}
    rank = F.struct(F.col("id").isNotNull().alias("some"), F.col("id").alias("id"))  # a null id before all others
    rows = df.where(text.isNotNull()).select(keyed[own_id].alias("id"), keyed[h1].alias("h1"), keyed[h2].alias("h2"), text.alias("text"))

    # with bytes: equal chunks are counted before the shuffle, so a chunk that many rows share is one row of each task
    each = rows.select(rank.alias("own"), F.explode(chunks(F.col("text"), modulus)).alias("c")).select("own", _key(F.col("c")).alias("k"), F.col("c")["text"].alias("text")).where("k IS NOT NULL")
    same = each.groupBy("k.k1", "k.k2", "k.n", "text").agg(F.count("*").alias("times"), F.min("own").alias("first"))
    repeated = same.groupBy("k1", "k2", "n").agg(F.count("*").alias("texts"), F.sum("times").alias("times"), F.min("first").alias("first")).where("texts = 1 AND times > 1")

    def placed(keys: Column) -> Column:
        return F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("pos"), (F.array_position(keys, k) == i + 1).alias("fresh")))

    places = rows.select("id", "h1", "h2", F.explode(let(F.transform(chunks(F.col("text"), modulus), _key), placed)).alias("x")).where("x.k IS NOT NULL").select("id", "h1", "h2", "x.k.*", "x.pos", "x.fresh")
    hits = places.join(repeated, ["k1", "k2", "n"]).where(~F.col("fresh") | (rank != F.col("first")))
    out_of = hits.groupBy("id", "h1", "h2").agg(F.collect_set("pos").alias(gone))

    def rest(parts: Column) -> Column:
        def put(done: Column, c: Column) -> Column:
            apart = F.when(done["text"].isNull() | (done["last"] == c["first"]), "").otherwise("\n")
            return F.struct(F.concat(F.coalesce(done["text"], F.lit("")), apart, c["text"]).alias("text"), c["last"].alias("last"))

        stay = F.filter(parts, lambda _, i: ~F.array_contains(F.col(gone), i))
        start = F.lit(None).cast("struct<text:string,last:int>")
        return F.coalesce(F.aggregate(stay, start, put, lambda done: done["text"]), F.lit(""))

    told = out_of.select(*(F.col(n).alias(to) for n, to in zip(("id", "h1", "h2", gone), names, strict=True)))
    left, right = df.withColumns(keyed).alias("l"), told.alias("r")
    on = F.col(f"l.{own_id}").eqNullSafe(F.col(f"r.{own_id}")) & (F.col(f"l.{h1}") == F.col(f"r.{h1}")) & (F.col(f"l.{h2}") == F.col(f"r.{h2}"))
    out = left.join(right, on, "left").select("l.*", f"r.{gone}").withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(rest(chunks(text, modulus))))
    if count_col:
        out = out.withColumn(count_col, F.greatest(F.size(gone), F.lit(0)).cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in [*df.columns, *([count_col] if count_col and count_col not in df.columns else [])]))
