"""Operators that relate rows to each other, against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograph.llm import _hash
from foliograph.llm import licenses as L
from foliograph.llm import line_dedup as D
from foliograph.llm import mixing as M
from foliograph.llm import near_duplicates as N


def shingle_set(text):
    w = [x for x in (text or "").split() if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(docs):
    """{(id, class, links)} counts of documents, from all pairs."""
    sets, parent, links = [shingle_set(t) for _, t in docs], list(range(len(docs))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            both = len(sets[a] & sets[b])
            if (docs[a][1] or "") == (docs[b][1] or "") or (both and 9 * both >= 4 * (len(sets[a]) + len(sets[b]))):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)].append(i)
    return Counter((docs[k][0], min(least[root(k)], default=None), links[k]) for k in range(len(docs)))


def near_documents(seed, n):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(30))
    docs = []
    for i in range(n):
        if docs and rnd.random() < 0.6:
            w = (rnd.choice(docs)[1] or "").split()
            for _ in range(rnd.randrange(4)):
                if w:
                    w[rnd.randrange(len(w))] = word()
            docs.append((i, " ".join(w)))
        else:
            docs.append((i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 4, 5, 60, 120, 200])))))
    return docs


def test_near_duplicates_as_brute_force(spark):
    docs = near_documents(1, 220)
    got = N.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute_classes(docs)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group larger than a block: each pair of blocks in a task of its own, every link counted once."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(w)))
    got = N.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute_classes(docs)


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = odd.select("id", "text").collect()
    got = Counter(tuple(r) for r in N.ngram_jaccard_join(odd, "id").collect())
    assert got == brute_classes([(r["id"], r["text"]) for r in rows])
    assert N.ngram_jaccard_join(nothing, "id").count() == 0
    one = N.keep_one(odd, "id")
    assert one.columns == odd.columns and one.count() == len({c for c in brute_texts(rows)})
    assert N.keep_one(nothing, "id").count() == 0


def brute_texts(rows):
    return {r["text"] or "" for r in rows}  # no two of the odd texts are near each other


def test_shingle_hashes():
    texts = ["a b c d e f", "a b c d e", "  f\tg ", "", None, "a b c d e f", "é ü 版 b c d"]
    h, bounds = _hash.shingles(pa.array(texts))
    sets = [set(h[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 2, 2]
    assert sets[0] == sets[5] and sets[1] < sets[0]
    part = pa.array(texts)[2:6]
    again, other = _hash.shingles(part)
    assert np.array_equal(again, h[bounds[2] : bounds[6]]) and np.array_equal(other, bounds[2:7] - bounds[2])


def brute_lines(text):
    """(number of the physical line, text) of ten-word lines, cut by hand."""
    out = []
    for row, line in enumerate(text.split("\n")):
        held, words = "", 0
        for piece in re.findall(r" +|[^ ]+", line):
            if piece[0] != " ":
                if words == 10:
                    out.append((row, held))
                    held, words = "", 0
                words += 1
            held += piece
            if words == 0:  # spaces before the first word
                out.append((row, held))
                held = ""
        if held or not line:
            out.append((row, held))
    return out


def brute_chunks(text):
    """(text, whether it is looked up, first row, last row) of the chunks: stretches first, then boundaries inside each."""
    import hashlib

    lines = brute_lines(text)
    size = Counter(row for row, _ in lines)
    stretches = []
    for row in range(len(text.split("\n"))):
        own = [x for x in lines if x[0] == row]
        if not stretches or size[row] >= D.LEAST or size[row - 1] >= D.LEAST:
            stretches.append([])
        stretches[-1] += own
    out = []
    for s in stretches:
        code = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for _, x in s]
        rolls = [j >= 2 and (code[j - 2] * D.BASE**2 + code[j - 1] * D.BASE + code[j]) % D.PRIME % D.MODULUS == 0 for j in range(len(s))]
        cuts = [j for j in range(len(s)) if rolls[j] and j >= D.LEAST and len(s) - j >= D.LEAST and not any(rolls[j - d] for d in range(1, D.LEAST))]
        for a, b in zip([0, *cuts], [*cuts, len(s)]):
            joined = "".join(("\n" if k > a and s[k][0] != s[k - 1][0] else "") + s[k][1] for k in range(a, b))
            out.append((joined, b - a >= D.LEAST and bool(joined.strip(" \t\x0b\x0c\r\n")), s[a][0], s[b - 1][0]))
    return out


def brute_dedup(rows):
    found, times = {}, Counter()
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for c, asked, _, _ in brute_chunks(t) if t is not None else []:
            if asked:
                times[c] += 1
                found[c] = min(found.get(c, 1 << 63), order(i))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        kept, seen, last = "", set(), None
        for c, asked, first, end in brute_chunks(t):
            if asked and times[c] > 1 and (found[c] != order(i) or c in seen):
                continue
            seen.add(c)
            kept += c if last in (None, first) else "\n" + c
            last = end
        out.append((i, kept))
    return Counter(out)


def test_line_dedup_as_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"line {i} of the pool" for i in range(30)] + [" ".join(f"w{j}" for j in range(60)), ""]
    passage = [f"passage line {i}" for i in range(40)]
    rows = []
    for i in range(80):
        lines = [rnd.choice(pool) if rnd.random() < 0.3 else f"own {i} {j}" for j in range(rnd.randrange(1, 20))]
        if i % 3 == 0:
            k = rnd.randrange(len(lines) + 1)
            lines[k:k] = passage
        rows.append((i, "\n".join(lines)))
    got = D.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), count_col="n")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == brute_dedup(rows)
    inner = "\n".join(passage[16:26])
    assert sum(inner in r["text"] for r in got.collect()) == 1


def test_line_dedup_of_passages(spark):
    """A passage of over 50 words goes whole but for its first place, on a line of its own or on several; what is around it stays."""
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(5000))
    own = lambda n: " ".join(word() for _ in range(n))
    passages = [own(51), own(75), own(140), f"{own(30)}\n{own(35)}\n{own(41)}"]
    rows = []
    for i in range(60):
        parts = [own(rnd.randrange(1, 70)) for _ in range(4)]
        rows.append((i, "\n".join([parts[0], parts[1], passages[i % 4], parts[2], parts[3]]), "\n".join(parts)))
    got = {r["doc_id"]: r["text"] for r in D.line_dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()}
    for i, text, rest in rows:
        assert got[i] == (text if i < 4 else rest)


def test_line_boundaries_roll(spark):
    """Every line of the window counts: other lines before one make other boundaries; lines put in at the front shift all but the first."""
    lines = [f"line number {i}" for i in range(400)]
    other = [x + "!" if i % 2 == 0 else x for i, x in enumerate(lines)]
    texts = ["\n".join(x) for x in (lines, other, ["new", "lines"] + lines)]
    cuts = [[c["text"].split("\n")[0] for c in r[0]] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.chunks(F.col("t"))).collect()]
    at = [{int(re.search(r"\d+", x)[0]) for x in c[1:]} for c in cuts]
    assert at[0] != at[1] and len(at[0] & at[1]) < 0.6 * len(at[0])
    assert {x for x in at[0] if x > 8} == {x for x in at[2] if x > 8}


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,0)"])
def test_line_dedup_of_any_id(spark, kind):
    text = " ".join(f"w{i}" for i in range(60))
    ids = {"string": ["b", "a", None], "date": ["2024-01-02", "2024-01-01", None], "decimal(20,0)": ["2", "1", None]}[kind]
    for some, kept in ((ids[:2], ids[1]), (ids, None)):
        df = spark.createDataFrame([(i, text) for i in some], "own_id string, text string").withColumn("own_id", F.col("own_id").cast(kind))
        got = D.line_dedup(df.withColumn("gone", F.lit(1)).withColumn("h1", F.lit("x")), "own_id").where("text <> ''").select(F.col("own_id").cast("string")).collect()
        assert [r[0] for r in got] == [kept]


def test_line_dedup_of_odd_rows(odd, nothing):
    rows = [(r["id"], r["text"]) for r in odd.collect()]
    got = D.line_dedup(odd, "id", count_col="s")
    assert sorted(got.columns) == sorted(odd.columns)
    assert Counter((r["id"], r["text"]) for r in got.collect()) == brute_dedup(rows)
    assert D.line_dedup(nothing, "id").count() == 0


def labelled_documents(spark, seed=5, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "bad" if i % 5 == 0 else "good"
        words = [rnd.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit"]) for _ in range(rnd.randrange(20, 80))]
        if kind == "bad":
            words[rnd.randrange(len(words))] = rnd.choice(["foul", "nasty"])
            words[rnd.randrange(len(words))] = "vile"
        rows.append((i, " ".join(words), kind))
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string")


def brute_rates(n, p, targets, scale=None):
    """Least squares by many small projected steps in numpy."""
    mass = (n[:, None] * p).sum(0)
    aim = np.array(targets) / sum(targets) * mass.sum()
    aim *= (mass / aim).min() if scale is None else scale
    r = np.ones(len(n))
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * p @ (((r * n)[:, None] * p).sum(0) - aim) / mass.sum() * 1)
    return r, aim


def test_mixing(spark):
    df = labelled_documents(spark)
    labels = df.select("doc_id", F.col("kind").alias("domain")).where("doc_id % 2 = 0")
    rows = M.mix(df, labels, {"good": 0.95, "bad": 0.05}).collect()
    held_out = [r for r in rows if r["doc_id"] % 2]
    right = sum((r["mix"]["posterior"]["bad"] > 0.5) == (r["kind"] == "bad") for r in held_out)
    assert right >= 0.97 * len(held_out)
    n = np.array([r["mix"]["n_tokens"] for r in rows], float)
    p = np.array([[r["mix"]["posterior"][d] for d in ("good", "bad")] for r in rows])
    assert np.allclose(p.sum(1), 1)
    rate = np.array([r["mix"]["rate"] for r in rows])
    _, aim = brute_rates(n, p, (0.95, 0.05))
    assert (rate >= 0).all() and np.allclose(((rate * n)[:, None] * p).sum(0), aim, rtol=0.01)
    copies = np.array([r["mix"]["copies"] for r in rows])
    assert ((copies == np.floor(rate)) | (copies == np.floor(rate) + 1)).all()


def test_mixing_solver(spark):
    rnd = np.random.default_rng(6)
    n = rnd.integers(1, 100, 60).astype(float)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 60)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens bigint, p array<double>")
    for targets, scale in (((0.5, 0.3, 0.2), None), ((0.9, 0.1, 0.0), 1.0), ((1.0, 1.0, 1.0), 2.0)):
        steps = M.solve(df, targets, scale).steps
        r = np.array([x[0] for x in df.select(M._rate(F.col("p"), steps)).collect()])
        _, aim = brute_rates(n, p, targets, scale)
        mass = (n[:, None] * p).sum(0)
        loss = lambda r: ((((r * n)[:, None] * p).sum(0) - aim) ** 2 / mass).sum() / mass.sum()
        assert (r >= 0).all() and loss(r) <= 0.02 * loss(np.ones(60)) + 1e-6


def test_mixing_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, "x"), (4, "y"), (4, None), (None, "x"), (99, "y")], "id bigint, domain string")
    out = M.mix(odd, labels, {"x": 0.5, "y": 0.5}, "id", out_col="s")
    rows = out.collect()
    assert sorted(out.columns) == sorted(odd.columns) and len(rows) == odd.count()
    assert all(sum(r["s"]["posterior"].values()) == pytest.approx(1) for r in rows)
    assert all(r["s"]["n_tokens"] == len((r["text"] or "").split()) for r in rows)
    assert M.mix(nothing, labels, {"x": 0.5, "y": 0.5}, "id").count() == 0
    bare = M.mix(odd, labels.where("false"), {"x": 0.5, "y": 0.5}, "id", with_text=False).collect()
    assert all(r["mix"]["posterior"] == {"x": 0.5, "y": 0.5} for r in bare)


FILES = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (2, "a/b/x.txt", "nothing said here"),
    (3, "a/b/c/LICENSE", "Released under the MIT License."),
    (4, "a/b/c/y.txt", "plain words of no kind"),
    (5, "a/b/c/d/z.txt", "intro\nThis work is licensed under the GNU General Public License, version 3.\n" + "other words follow and follow " * 30),
    (6, "q/z.txt", "the license of the work is not stated under the terms of the of the"),
    (7, None, "words"),
    (8, "q/n.txt", None),
    (8, "q/n.txt", None),
    (None, "top.txt", ""),
]


def test_licenses(spark):
    got = {(r["doc_id"], r["path"]): r for r in L.license_scan(spark.createDataFrame(FILES, "doc_id bigint, path string, text string")).collect()}
    said = {k[0]: r["license"] for k, r in got.items()}
    assert said == {1: "Apache-2.0", 2: "Apache-2.0", 3: "MIT", 4: "MIT", 5: "GPL-3.0", 6: None, 7: None, 8: None, None: None}
    r = got[(5, "a/b/c/d/z.txt")]
    assert (r["header"], r["header_line"], r["file"], r["inherited"], r["inherited_from"]) == ("GPL-3.0", 1, None, "MIT", "a/b/c")
    assert got[(2, "a/b/x.txt")]["inherited_from"] == "a"


def test_licenses_without_ids_or_paths(spark):
    """Null ids and paths lose nothing, and null isn't the other's value."""
    said = "Released under the MIT License."
    rows = [(None, "d/COPYING.txt", said), (None, "d/COPYING.txt", said), (7, None, said), (None, None, said), (8, "d/y", "words"), (9, None, "words")]
    got = Counter((r["doc_id"], r["path"], r["header"], r["file"], r["inherited"], r["license"]) for r in L.license_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect())
    assert got == Counter({(None, "d/COPYING.txt", "MIT", "MIT", "MIT", "MIT"): 2, (7, None, "MIT", None, None, "MIT"): 1, (None, None, "MIT", None, None, "MIT"): 1, (8, "d/y", None, None, "MIT", "MIT"): 1, (9, None, None, None, None, None): 1})


def test_licence_texts_and_blocks(spark):
    """Whole licence texts, wrapped and with names filled in, are licence files that hand down; a notice may go over several comment lines."""
    import textwrap

    mit, bsd = (textwrap.fill(L.TEXTS[k][0].replace("Copyright (c)", "Copyright (c) 2024 Some Body and Others"), 70) for k in ("MIT", "BSD-3-Clause"))
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Everyone is permitted to copy and distribute verbatim copies of this document.\n" * 40
    apache = "\n".join("# " + x for x in ["Licensed under the Apache License, Version 2.0 (the License);", "you may not use this file except in compliance", "with the License."]) + "\n\nimport os\n" + "x = f(y)\n" * 50
    rows = [(1, "m/LICENSE", mit), (2, "m/src/a.py", "import os"), (3, "b/LICENSE", bsd), (4, "b/c.py", "x"), (5, "g/COPYING", gpl), (6, "g/deep/er/f.c", "int x;"), (7, "m/src/b.py", apache)] + [(k, f"z/{k}", " ".join(f"w{k}x{j}" for j in range(40))) for k in range(10, 60)]
    got = {r["doc_id"]: r for r in L.license_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert {k: got[k]["file"] for k in (1, 3, 5, 7)} == {1: "MIT", 3: "BSD-3-Clause", 5: "GPL-3.0", 7: None}
    assert {k: (got[k]["inherited"], got[k]["inherited_from"]) for k in (2, 4, 6)} == {2: ("MIT", "m"), 4: ("BSD-3-Clause", "b"), 6: ("GPL-3.0", "g")}
    assert (got[7]["header"], got[7]["header_line"], got[7]["license"]) == ("Apache-2.0", 0, "Apache-2.0") and got[20]["license"] is None


def test_notices_speak_for_their_own_file(spark):
    """A headed source file gives nothing to its folder; SPDX lines name licences that no template has."""
    header = "Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance with the License."
    rows = [(1, "p/a.py", "# SPDX-License-Identifier: MIT"), (2, "p/b.py", "import os"), (3, "q/n.txt", "All rights reserved."), (4, "q/m.txt", "my own notes"), (5, "s/a.c", header), (6, "s/b.c", "int x;")]
    rows += [(7, "t/a", "x\n/* SPDX-License-Identifier: GPL-2.0-or-later */"), (8, "t/b", "// SPDX-License-Identifier: (LGPL-2.1-only OR MIT)"), (9, "t/c", "SPDX-License-Identifier: Unlicense\nAll rights reserved.")]
    rows += [(k, f"z/{k}", " ".join(f"w{k}x{j}" for j in range(40))) for k in range(10, 60)]
    got = {r["doc_id"]: r for r in L.license_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert {k: got[k]["license"] for k in range(1, 10)} == {1: "MIT", 2: None, 3: "proprietary", 4: None, 5: "Apache-2.0", 6: None, 7: "GPL-2.0", 8: "LGPL-2.1", 9: "Unlicense"}
    assert all(got[k]["file"] is None and got[k]["inherited"] is None for k in range(1, 10)) and got[7]["header_line"] == 1


def test_licenses_as_brute_force(spark):
    """Cosines of every line to every template by dictionaries."""
    import math

    rnd = random.Random(7)
    words = "the of and license licensed under work version released terms copy software apache mit public general 2.0 other plain".split()
    rows = [(i, f"d{i % 7}/f{i}", "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 5)))) for i in range(150)]
    whole = {k: L.TEMPLATES.get(k, ()) + L.TEXTS.get(k, ()) for k in [*L.TEMPLATES, *(x for x in L.TEXTS if x not in L.TEMPLATES)]}
    vocabulary = {t for group in (whole, L.TITLES) for forms in group.values() for f in forms for t in L.tokens_of(f)}
    seen = Counter(t for _, _, x in rows for t in set(L.tokens_of(x)) & vocabulary)
    idf = {t: math.log((1 + len(rows)) / (1 + seen[t])) + 1 for t in vocabulary}

    def best(text, group=L.TEMPLATES):
        made = L.vectors(group, idf)
        tf = Counter(L.tokens_of(text))
        norm = math.sqrt(sum((n * idf.get(t, math.log(1 + len(rows)) + 1)) ** 2 for t, n in tf.items()))
        scores = [round(sum(n * idf[t] * v["weights"].get(t, 0) for t, n in tf.items() if t in idf) / norm, 9) if norm else 0 for v in made]
        return max((s for s in scores), default=0), made[scores.index(max(scores))]["license"]

    for r in L.license_scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect():
        text = rows[r["doc_id"]][2]
        parts = text.split("\n") + [text] * ("\n" in text)  # no line is empty, so all of them are one block
        said = [x for x in [best(text, L.TEXTS)] if x[0] >= L.THRESHOLD] + [x for x in (best(p, L.TITLES) for p in parts) if x[0] >= L.TITLE_THRESHOLD]
        top = max((x[0] for x in said), default=None)
        assert (r["file"], r["file_score"]) == (min((x[1] for x in said if x[0] == top), default=None), top and pytest.approx(top))
        lines = [best(x) for x in parts]
        top = max(x[0] for x in lines)
        assert r["header"] == (lines[[x[0] for x in lines].index(top)][1] if top >= L.THRESHOLD else None)


def test_licenses_of_odd_rows(odd, nothing):
    out = L.license_scan(odd.withColumn("header", F.lit(1)), "id", path_col="parts")
    assert out.count() == odd.count()
    assert L.license_scan(nothing, "id", path_col="parts").count() == 0
