"""Palettes, stroke weights and nearest rows in rings against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.operators import palette as C
from foliograph.operators import relations as R
from foliograph.operators import strokes as S
from foliograph.sources.pictures import lettered


def plain_clusters(rows, chances):
    """rows: (rgb, n) of a page; chances[attempt, k]. The same rule with lists."""
    rows = sorted(rows)
    at = [((c >> 16), c >> 8 & 255, c & 255) for c, _ in rows]
    n = [w for _, w in rows]
    k = min(6, max(2, sum(n) // 1000), len(rows))
    d2 = lambda a, b: float(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    best = None
    for attempt in (1, 2, 3):
        centres = []
        for step in range(k):
            w = [x * (min(d2(p, c) for c in centres) if centres else 1) for x, p in zip(n, at, strict=True)]
            upto, goal = 0.0, chances[attempt, step] * sum(w)
            for x, p in zip(w, at, strict=True):
                upto += x
                if x > 0 and upto > goal:
                    centres.append(tuple(map(float, p)))
                    break
        for _ in range(30):
            near = [min(range(len(centres)), key=lambda i: (d2(p, centres[i]), i)) for p in at]
            means = []
            for i, c in enumerate(centres):
                mine = [j for j, x in enumerate(near) if x == i]
                total = sum(n[j] for j in mine)
                means.append(tuple(sum(n[j] * at[j][ch] for j in mine) / total for ch in range(3)) if mine else c)
            still = all(d2(a, b) <= 0.04 for a, b in zip(centres, means, strict=True))
            centres = means
            if still:
                break
        near = [min((d2(p, c), i) for i, c in enumerate(centres)) for p in at]
        sizes = [sum(x for x, (_, i) in zip(n, near, strict=True) if i == c) for c in range(len(centres))]
        off = sum(x * d for x, (d, _) in zip(n, near, strict=True))
        if best is None or round(off, 2) < round(best[0], 2):
            best = (off, sorted(((-s, i, *c) for i, (s, c) in enumerate(zip(sizes, centres, strict=True)) if s)))
    return [(*c[2:], -c[0]) for c in best[1]]


def test_clusters_as_plain_loops(spark):
    rnd = random.Random(4)
    pages = {}
    for p in range(6):
        spots = [tuple(rnd.randrange(256) for _ in range(3)) for _ in range(rnd.choice([1, 2, 5, 8]))]
        mixed = [tuple(min(255, max(0, c + rnd.randrange(-9, 10))) for c in rnd.choice(spots)) for _ in range(120)]
        pages[p] = {r << 16 | g << 8 | b: rnd.randrange(1, 90) for r, g, b in (mixed if p else spots[:1])}
    rows = [(p, c, n) for p, held in pages.items() for c, n in held.items()]
    got = {}
    for r in C.clusters(spark.createDataFrame(rows, "page_id bigint, rgb bigint, n bigint")).orderBy("page_id", "nth").collect():
        got.setdefault(r.page_id, []).append((r.r, r.g, r.b, r.n))
    asked = spark.range(6).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("a"))
    chances = {(r.id, r.a): [r[f"c{k}"] for k in range(6)] for r in asked.select("*", *(C.chance(F.col("id"), F.col("a"), k).alias(f"c{k}") for k in range(6))).collect()}
    for p, held in pages.items():
        want = plain_clusters(list(held.items()), {(a, k): chances[p, a][k] for a in (1, 2, 3) for k in range(6)})
        assert np.allclose(got[p], want), p


def test_palette_of_an_image(spark):
    image = np.full((100, 100, 3), 255, np.uint8)
    image[:30], image[30:40] = (200, 30, 30), (10, 10, 20)
    df = spark.createDataFrame([(3, 100, 100, image.tobytes())], "page_id bigint, width int, height int, data binary")
    found = C.colours(df)
    assert {r.rgb: r.n for r in found.collect()} == {0xFFFFFF: 6000, 0xC81E1E: 3000, 0x0A0A14: 1000}
    (r,) = C.palette(C.clusters(found)).collect()
    assert (r.primary, r.secondary, r.accent, r.dark, r.last, r.clusters) == ("#FFFFFF", "#C81E1E", "#C81E1E", "#0A0A14", "#0A0A14", 3)
    assert C.clusters(found.where("false")).count() == 0
    assert sum(r.n for r in C.colours(df, 1000).collect()) == 1000


def test_distance_to_ground():
    rng = np.random.default_rng(7)
    for h, w, p in ((12, 19, 0.8), (20, 6, 0.95), (1, 9, 0.5), (5, 1, 0.5)):
        m = rng.random((h, w)) < p
        m[0, 0] = False
        ground = np.argwhere(~m)
        want = [[np.sqrt(((ground - (y, x)) ** 2).sum(1).min()) if m[y, x] else 0 for x in range(w)] for y in range(h)]
        assert np.allclose(S.to_ground(m), want)
    assert np.isinf(S.to_ground(np.ones((3, 3), bool))).all()


def test_long_strokes():
    rng = np.random.default_rng(3)
    m = rng.random((15, 40)) < 0.85
    for axis in (0, 1):
        want = np.zeros_like(m)
        for y in range(15):
            for x in range(40):
                at = [(y, x + k) if axis else (y + k, x) for k in range(5)]
                if all(a < 15 and b < 40 and m[a, b] for a, b in at):
                    for a, b in at:
                        want[a, b] = True
        assert (S.along(m, 5, axis) == want).all()
    assert not S.along(m, 99, 1).any()


def test_bold_and_regular():
    ink = (30, 30, 60)
    heavy, light = S.weight(lettered("Heading", 5), ink), S.weight(lettered("Heading in two", 2), ink)
    assert heavy[2] and min(heavy[:2]) >= 1.6 and not light[2] and max(light[:2]) < 1.6
    assert S.weight(lettered("I", 5), ink) == (None, None, False) and S.weight(np.full((40, 100, 3), 255, np.uint8), ink) == (None, None, False)


def test_rings_as_all_pairs(spark):
    rnd = random.Random(6)
    rows = []
    for page in range(4):
        for pos in range((1, 3, 60, 200)[page]):
            x, y = (rnd.choice([0, 900]), rnd.choice([0, 500])) if page == 1 else (rnd.gauss(300, 120), rnd.gauss(200, 90))
            x, y = float(round(x)), float(round(y))
            rows.append((page, pos, rnd.choice("abc"), x, y, x + rnd.randrange(9), y + rnd.randrange(9)))
    df = spark.createDataFrame(rows, "page_id bigint, pos int, kind string, x1 double, y1 double, x2 double, y2 double")
    got = R.nearest_in_rings(df, df, "kind", 20.0).collect()
    want = {}
    mid = lambda r: ((r[3] + r[5]) / 2, (r[4] + r[6]) / 2)
    for a in rows:
        near = [((mid(a)[0] - mid(b)[0]) ** 2 + (mid(a)[1] - mid(b)[1]) ** 2, b[1]) for b in rows if b[0] == a[0] and b[2] == a[2] and b[1] != a[1]]
        if near:
            want[a[0], a[1]] = min(near)
    assert {(r.page_id, r.a_pos): (r.distance2, r.b_pos) for r in got} == want and len(got) == len(want)
    pairs = sum(1 for a in rows for b in rows if a[0] == b[0] == 3 and a[2] == b[2] and a[1] != b[1])
    assert sum(r.looked for r in got if r.page_id == 3) < pairs / 2


def test_palette_of_tiles_as_plain_loops(spark):
    from foliograph.plans import QUERIES
    from foliograph.sources.views import pixels

    sf, tiles = "/root/testdata/sf0.001", {}
    for r in pixels(spark, sf).collect():
        tiles.setdefault(r.page_id, []).append(float(r.v))
    got = {r.page_id: r for r in QUERIES["agg17_palette"](spark, sf).collect()}
    assert set(got) == set(tiles)
    for p, values in tiles.items():
        v = sorted(values)
        k = max(2, min(6, len(set(v)) // 8))
        means = [v[int(i * (len(v) - 1) / (k - 1))] for i in range(k)]
        for _ in range(30):
            near = [min(range(k), key=lambda i: (abs(x - means[i]), i)) for x in v]  # noqa: B023
            again = [float(np.mean([x for x, i in zip(v, near, strict=True) if i == c])) if c in near else means[c] for c in range(k)]
            if again == means:
                break
            means = again
        main = means[max(range(k), key=lambda c: (near.count(c), -c))]  # noqa: B023
        accent = means[max(range(k), key=lambda c: (abs(means[c] - main), -c))]  # noqa: B023
        assert (got[p].clusters, got[p].dominant, got[p].dark, got[p].accent) == (k, *(pytest.approx(x) for x in (main, min(means), accent)))
