"""N-gram Jaccard join of a table with itself: a MinHash LSH forest, then exact verification.

Texts become sets of word shingles. Each tree of the forest is a sorted trie over its own MinHash values; texts that
share a prefix of a given length in some tree are candidates. The prefix is so short that a pair at the threshold is found
with the target's probability, whatever else the table holds. Candidates are gathered to groups by a union of similar ones, and within a
group all pairs of texts are verified on their whole shingle sets. Nothing is made for each pair: tasks return, for
each text, its number of links and one edge, so a group of m texts makes a number of rows that grows with m alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._arrow import slices, small_batches
from ._common import cut, spare
from ._hash import shingles

TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
#: Two texts are put into one group if their signatures agree by this much less than the threshold: 4 standard deviations at 0.8.
MARGIN = 0.15
#: Texts compared with each other in a task, and the shingles of those; larger groups are dealt out in blocks, each pair of blocks to a task.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
_seeds = np.random.default_rng(20240229)
FACTORS = _seeds.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
FLIPS = _seeds.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles with repeats, MinHash values) of each text."""
    h, bounds = shingles(column)
    n = np.diff(bounds)
    out = np.full((len(n), HASHES), 0xFFFFFFFF, np.uint32)
    some = n > 0
    if some.any():
        x, starts = (h >> np.uint64(32)).astype(np.uint32), bounds[:-1][some]
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((x ^ FLIPS[k]) * FACTORS[k], starts)
    return n, out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for a, b in slices(batch.column(at)):
            part = batch.slice(a, b - a)
            n, values = signatures(part.column(at))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), _binary(values), _binary(values.astype(np.uint8))], names=["uid", "id", "n", "signature", "low"])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal key, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for links a-b among n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _across(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare with rows: those of the first block with those of the second, or all with all if there is one."""
    block = table["block"].to_numpy()
    first = block == block.min()
    return (np.flatnonzero(first), np.flatnonzero(~first)) if table["two"][0].as_py() else (np.arange(len(block)), np.arange(len(block)))


def prefix(threshold: float, target_recall: float, start_depth: int) -> int:
    """The longest prefix, start_depth at most, at which one pair with a similarity of threshold is found with the target's probability.

    Similar pairs are found more often, so the rarest link counts and no number of easy ones can outvote it.
    """
    reach = (d for d in range(start_depth, 1, -1) if 1 - (1 - threshold**d) ** TREES >= target_recall)
    return next(reach, 1)


def _similar(threshold: float):
    """For each trie node: edges between texts with similar signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, roots = [], []
        for table in grouped(batches, "gid"):
            left, right = _across(table)
            two = table["two"][0].as_py()
            if not len(left) or not len(right) or len(table) < 2:
                continue
            low, own = _fixed(table["low"], HASHES), table["uid"].to_pylist()
            some_a, some_b = [], []
            for i in left:
                same = (low[right] == low[i]).sum(1)
                likeness = (same / HASHES - 1 / 256) / (1 - 1 / 256)
                near = (likeness >= threshold - MARGIN) & (two | (right > i))
                hit = right[near]
                some_a.append(np.full(len(hit), i))
                some_b.append(hit)
            a, b = np.concatenate(some_a), np.concatenate(some_b)
            if len(a):
                root = _roots(len(own), a, b)
                for k in np.flatnonzero(root != np.arange(len(own))):
                    uids.append(own[k])
                    roots.append(own[root[k]])
            if len(uids) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), pa.array(roots, pa.binary())], names=["uid", "root"])
                uids, roots = [], []
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), pa.array(roots, pa.binary())], names=["uid", "root"])

    return run


def _verified(threshold: Fraction):
    """For each pair of blocks: how many rows each text links to, and edges of the links' components."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "gid"):
            own, copies = table["uid"].to_pylist(), table["copies"].to_numpy()
            _, once = np.unique(np.array([u.hex() for u in own]), return_index=True)
            if len(once) < len(own):  # repeated rows of a text
                table = table.take(pa.array(np.sort(once)))
                own, copies = table["uid"].to_pylist(), table["copies"].to_numpy()
            left, right = _across(table)
            if not len(left) or not len(right) or len(own) < 2:
                continue
            h, bounds = shingles(table["text"].combine_chunks())
            rows = np.repeat(np.arange(len(own)), np.diff(bounds))
            order = np.lexsort((rows, h))
            h, rows = h[order], rows[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            h, rows = h[fresh], rows[fresh]
            sizes = np.bincount(rows, minlength=len(own))
            starts = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
            column = np.cumsum(np.bincount(starts, minlength=len(h)))[: len(h)] - 1
            shared = np.bincount(column)[column] > 1
            rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
            common = np.zeros((len(left), len(right)), np.int64)
            at_left, at_right = np.full(len(own), -1), np.full(len(own), -1)
            at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
            edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 4096, 4096))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                width = int(column[b - 1]) - 4096 * k + 1 if b > a else 0
                inside = np.zeros((len(own), width), np.float32)
                inside[rows[a:b], column[a:b] - 4096 * k] = 1
                common += (inside[left] @ inside[right].T).astype(np.int64)
            linked = common * (up + down) >= up * (sizes[left][:, None] + sizes[right])
            linked &= common > 0
            linked &= left[:, None] != right
            counts = np.zeros(len(own), np.int64)
            counts[left] += linked @ copies[right]
            if table["two"][0].as_py():
                counts[right] += copies[left] @ linked
            a, b = np.nonzero(linked)
            root = _roots(len(own), left[a], right[b])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([own[k] for k in root], pa.binary()), pa.array(counts)], names=["uid", "root", "links"])

    return run


def _dealt(members: DataFrame, key: str, blocks) -> DataFrame:
    """members with gid, block, two: a row for each task that needs it, of `blocks` blocks of its key."""
    own = members.withColumn("blocks", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    each = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    gid = F.xxhash64(key, F.least("block", "with"), F.greatest("block", "with"))
    dealt = each.select("*", gid.alias("gid"), (F.col("block") != F.col("with")).alias("two"))
    return dealt.repartition("gid").sortWithinPartitions("gid")


def fingerprinted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, text); uid is the text's MD5, null counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.unhex(F.md5(text)).alias("uid"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))


def text_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, target_recall: float = 0.9995, start_depth: int = 6) -> DataFrame:
    """(uid, id, copies, root, class_id, n_links), a row for each different text of df.

    id: the least id of its rows; copies: their number; root: names the class, the texts that a chain of links joins;
    class_id: the least id of the class; n_links: the other rows of df that a row of this text links to, copies of
    it included. Equal texts link; others do if the Jaccard similarity of their five-word shingle sets is at least
    threshold. Texts without words link to their copies only. An empty df gives no rows.
    """
    small_batches(df.sparkSession)
    docs = fingerprinted(df, id_col, text_col)
    kind = docs.schema["id"].dataType.simpleString()
    signed = docs.mapInArrow(_sign, f"uid binary, id {kind}, n bigint, signature binary, low binary")
    texts = cut(signed.groupBy("uid").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("low").alias("low")))

    depth = prefix(threshold, target_recall, start_depth)
    trees = F.array(*(F.xxhash64(F.lit(t), F.substring("signature", 4 * DEPTH * t + 1, 4 * depth)) for t in range(TREES)))
    nodes = texts.where("n > 0").select("uid", F.explode(trees).alias("node"))
    shared = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    members = nodes.join(shared, "node").join(texts.select("uid", "low"), "uid")
    tasks = _dealt(members, "node", F.ceil(F.col("size") / BLOCK)).select("gid", "block", "two", "uid", "low")
    edges = cut(tasks.mapInArrow(_similar(threshold), "uid binary, root binary"))

    groups = cut(components(edges, "uid", "root").withColumnRenamed("root", "grp"))
    members = groups.withColumnRenamed("node", "uid").join(texts.select("uid", "id", "copies", "n"), "uid")
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("all"))
    own = docs.select(F.col("uid").alias("row_uid"), F.col("id").alias("row_id"), "text")
    with_text = members.join(sizes, "grp").join(own, (F.col("uid") == F.col("row_uid")) & F.col("id").eqNullSafe(F.col("row_id")))  # by both, so the copies of a text don't meet
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("all") / BLOCK_SHINGLES))
    tasks = _dealt(with_text, "grp", blocks).select("gid", "block", "two", "uid", "copies", "text")
    found = cut(tasks.mapInArrow(_verified(Fraction(str(threshold))), "uid binary, root binary, links bigint"))

    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = cut(components(found, "uid", "root"))
    joined = texts.select("uid", "id", "copies").join(links, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    all_texts = joined.select("uid", "id", "copies", F.coalesce("root", "uid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = all_texts.groupBy("root").agg(F.min("id").alias("class_id"))
    return all_texts.join(classes, "root").select("uid", "id", "copies", "root", "class_id", "n_links")


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, target_recall: float = 0.9995) -> DataFrame:
    """(id_col, class_id, n_links), a row for each row of df; see text_classes() for what they hold.

    Rows with a null id keep their place and share classes like others; repeated rows give repeated results, an empty df
    gives none, and null and empty texts are equal. Other columns of df don't matter. A text of any length is compared whole.
    """
    classes = text_classes(df, id_col, text_col, threshold, target_recall).select("uid", "class_id", "n_links")
    return fingerprinted(df, id_col, text_col).select("uid", "id").join(classes, "uid").select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, target_recall: float = 0.9995) -> DataFrame:
    """The row with the least id of every class, with df's own columns, whatever their names; of rows alike in id and text one stays.

    Null and empty texts are one class, a null id comes first, an empty df gives no rows, and a text of any length is compared whole.
    """
    own, first_id, first_uid = spare(df, "own", "first_id", "first_uid")
    classes = text_classes(df, id_col, text_col, threshold, target_recall)
    first = classes.groupBy("root").agg(F.min(F.struct("id", "uid")).alias("first")).select(F.col("first.id").alias(first_id), F.col("first.uid").alias(first_uid))
    uid, row_id = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))), F.col(f"`{id_col}`")
    rows = df.withColumn(own, uid).join(first, (F.col(own) == F.col(first_uid)) & row_id.eqNullSafe(F.col(first_id)))
    return rows.dropDuplicates([first_uid]).select(*(F.col(f"`{c}`") for c in df.columns))
