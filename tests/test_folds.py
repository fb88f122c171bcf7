"""Folds against plain loops."""

import random
from statistics import median

from pyspark.sql import functions as F

from foliograph.operators import folds as K
from foliograph.operators import raster as P
from foliograph.operators.graph import components


def lines(seed):
    rnd, out = random.Random(seed), []
    for page in range(6):
        y = 0
        for pos in range(14):
            y += rnd.choice([0, 4, 12, 30])
            x = rnd.choice([0, 10, 200])
            out.append((page, pos, float(x), float(y), float(x + rnd.randrange(20, 120)), float(y + 10), rnd.choice(["a", "b"]), 0.5, "text"))
    return out


COLS = "page_id int, pos int, x1 double, y1 double, x2 double, y2 double, role string, confidence double, type string"


def test_merged_lines(spark):
    rows = lines(1)
    want, blocks = {}, {}
    for p, pos, x1, y1, x2, y2, role, *_ in rows:
        bs, h = blocks.setdefault(p, []), y2 - y1
        for k in range(len(bs) - 1, max(-1, len(bs) - 9), -1):
            b = bs[k]
            if b[4] == role and -0.25 * h <= y1 - b[3] <= max(10, 0.9 * h) and (min(x2, b[2]) - max(x1, b[0]) > 0.2 * min(x2 - x1, b[2] - b[0]) or abs(x1 - b[0]) <= max(18, 1.4 * h)):
                bs[k] = [min(b[0], x1), min(b[1], y1), max(b[2], x2), max(b[3], y2), role]
                break
        else:
            k = len(bs)
            bs.append([x1, y1, x2, y2, role])
        want[(p, pos)] = k
    got = {(r["page_id"], r["pos"]): r["block"] for r in K.merged_lines(spark.createDataFrame(rows, COLS)).collect()}
    assert got == want


def test_row_clusters(spark):
    rows = lines(2)
    want, found = {}, {}
    for p, pos, _, y1, _, y2, *_ in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        rs, cy = found.setdefault(p, []), (y1 + y2) / 2
        k = next((k for k, r in enumerate(rs) if abs(median(r) - cy) <= 15), len(rs))
        if k == len(rs):
            rs.append([])
        rs[k].append(cy)
        want[(p, pos)] = k
    got = {(r["page_id"], r["pos"]): r["row_no"] for r in K.row_clusters(spark.createDataFrame(rows, COLS), 15.0).collect()}
    assert got == want


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_run_components(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(p, x, y, rnd.randrange(2)) for p in range(3) for x in range(9) for y in range(9)], "page_id int, px int, py int, v int")
    small = {(r["page_id"], r["px"], r["py"]): r["label"] for r in P.components(df, F.col("v") > 0).collect()}
    wide = {(r["page_id"], x, r["py"]): r["label"] for r in P.run_components(df, F.col("v") > 0).collect() for x in range(r["first"], r["last"] + 1)}
    assert wide == small
