"""Filter audit, language models and collocations against brute force on small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograph.llm import collocations as C
from foliograph.llm import filter_audit as A
from foliograph.llm import languages as L
from foliograph.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


# filter audit


def brute_audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((s or "", {k for k, v in fails.items() if v}, any(j == i and i is not None and q == 1 for j, q, _ in labels), any(j == i and i is not None and x == 1 for j, _, x in labels)))
    out = set()
    for part in {r[0] for r in rows}:
        mine, made, shapley = [r for r in rows if r[0] == part], [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = [r for r in mine if f in r[1] and r[1] & set(order[: step - 1])]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                made.append((order, step, f, len(left), len(gone), len(before), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(part, o, s, *rest, shapley[f]) for o, s, f, *rest in made}
    return out


def audit_documents():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["red", "Blue", "GREEN", "a$b", "sun", "moon", "star", "ä", "x"]) + str(rnd.randrange(40))
    docs = []
    for i in range(120):
        text = rnd.choice(docs)[1] if docs and rnd.random() < 0.4 else rnd.choice([None, "", " ", " ".join(word() for _ in range(rnd.choice([1, 3, 49, 50, 51, 80])))])
        docs.append((rnd.choice([i, i, i, None, 7]), text, rnd.choice(["s", "s", "t", None, ""])))
    docs += [(200, "x" * 9000, "t"), (201, "x" * 9000, "t"), (202, "x" * 8999 + "y", "t"), (203, "y" + "x" * 8999, "t")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 1, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.lit(1)], ids=["hash", "all hashes equal"])
def test_audit_as_brute_force(spark, hashed):
    docs, labels = audit_documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("part", F.lit("p")).withColumn("mask", F.lit(1)).withColumn("size", F.lit(1)).withColumn("id", F.lit(0))
    got = A.filter_audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), hashed=hashed).collect()
    assert {tuple(r) for r in got} == brute_audit(docs, labels) and len(got) == 600 * len({s or "" for _, _, s in docs})


def test_audit_of_nothing_and_of_one_text(spark):
    schema, labels = "doc_id bigint, text string, source string", spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert A.filter_audit(spark.createDataFrame([], schema), labels).count() == 0
    same = spark.createDataFrame([(i, "w " * 60, "s") for i in range(300)], schema)
    (row,) = A.filter_audit(same, labels).where("filter_order = 'EABCD' AND step = 1").collect()
    assert (row.kept, row.removed, row.unique_fails, row.shapley) == (1, 299, 0, 299 * 60)


# languages


def brute_model(texts):
    """probability(history, symbol) by plain dictionaries."""
    joined = [" " * (L.ORDER - 1) + re.sub(r"[^a-zäöü]+", " ", t.lower()).lstrip() for t in texts]
    grams = {k: Counter() for k in range(1, L.ORDER + 1)}
    for t in joined:
        for i in range(L.ORDER - 1, len(t)):
            grams[L.ORDER][t[i - L.ORDER + 1 : i + 1]] += 1
    for k in range(L.ORDER - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    discount, context = {}, {}
    for k, c in grams.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        context[k] = defaultdict(list)
        for g, v in c.items():
            context[k][g[:-1]].append(v)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / L.ALPHABET
        seen = context[k].get(gram[:-1])
        if not seen:
            return lower
        return max(grams[k][gram] - discount[k], 0) / sum(seen) + discount[k] * len(seen) / sum(seen) * lower

    return p


def test_probabilities_as_brute_force():
    texts = ["Der schnelle Fuchs, der schöne Fuchs.", "  3 Äpfel und Birnen; und der Fuchs", "und"]
    p = brute_model(texts)
    part, _, padding = L.symbols(pa.array(texts))
    model = L.Languages(["de"], [L.CharModel.fit(part, padding)], 1.0, (9.0,))
    for text in (*texts, "Der Wolf und der Fuchs", "zzz!zzz", "q"):
        padded = " " * (L.ORDER - 1) + re.sub(r"[^a-zäöü]+", " ", text.lower()).lstrip()
        want = -np.mean([math.log2(p(padded[i - L.ORDER + 1 : i + 1])) for i in range(L.ORDER - 1, len(padded))])
        n, bits = model.entropies(pa.array([text]))
        assert n[0] == len(padded) - L.ORDER + 1 and bits[0, 0] == pytest.approx(want, rel=1e-5)


def test_blocks_and_slices_change_nothing(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc d.é") for _ in range(rnd.randrange(60))) for _ in range(40)] + [None, "", "123"]
    part, _, padding = L.symbols(pa.array(texts[:20]))
    model = L.Languages(["x"], [L.CharModel.fit(part, padding)])
    n, bits = model.entropies(pa.array(texts))
    monkeypatch.setattr(L, "BLOCK", 7)
    n2, bits2 = model.entropies(pa.array(["cut", *texts]).slice(1))
    assert (n == n2).all() and np.allclose(bits, bits2) and list(n[-3:]) == [0, 0, 0]


def test_rows_that_predict_nothing(spark, odd, nothing):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind auf der matte", "de")] * 12)]
    labelled = spark.createDataFrame([*rows, (None, "le chat", "fr"), (90, None, "fr"), (91, "le chat", None)], "doc_id bigint, text string, lang string")
    languages = L.fit_languages(labelled)
    assert languages.names == ["de", "en"]
    got = L.detect_language(odd, languages, out_col="lang").select("id", "text", "lang.*", "class_id").collect()
    assert len(got) == odd.count()
    for r in got:
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == blank and 0 <= r.score <= 1 and (not blank or (r.score == 0 and not r.accepted)) and r.class_id == "k"
    assert L.detect_language(nothing, languages).count() == 0
    unknown = L.fit_languages(labelled.where("lang = 'fr'"))
    assert {tuple(r) for r in L.detect_language(odd, unknown).select("language.lang_pred", "language.score").collect()} == {("und", 0.0)}
    told = L.detect_language(spark.createDataFrame([("the dog sat",), ("die hunde und katzen",), ("漢字" * 40,)], "text string"), languages).select("language.*").collect()
    assert [r.lang_pred for r in told[:2]] == ["en", "de"] and not told[2].accepted


def test_held_out_accuracy(spark):
    got = QUERIES["op12_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(out) > 20 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_fit_is_bounded(spark):
    rows = [(i, "word " * 20, "en") for i in range(400)]
    got = L.sample(spark.createDataFrame(rows, "id bigint, text string, lang string"), fit_rows=64, fit_chars=2000).collect()
    assert 0 < len(got) <= 20


# collocations


def brute_phrases(docs, least, most):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 100 * a for q, b in found.items())
            if not inside:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i, p.decode(), -a, x, r, n[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(rows)[:most], 1)}
    return out


def phrase_documents():
    rnd = random.Random(9)
    words = ["of", "The", "new", "YORK", "times", "a", "é", "z\x01", "a,b", "tea pot", "z"]
    docs = [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rnd.randrange(60))), rnd.choice(["en", "en", "de", None, ""])) for _ in range(60)]
    docs += [("new york times of the", "en")] * 9 + [("a a a a a a a", "de")] * 3 + [(None, "en"), ("", "fr"), (" \t", None), ("rare " * 40, "en")]
    return docs


@pytest.mark.parametrize("dict_words", [C.DICT_WORDS, 0], ids=["sent", "joined"])
def test_phrases_as_brute_force(spark, dict_words, monkeypatch):
    monkeypatch.setattr(C, "TEXT_BYTES", 400)
    monkeypatch.setattr(C, "WINDOW_IDS", 50)
    docs = phrase_documents()
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("word", F.lit("w")).withColumn("key", F.lit(1)).withColumn("n", F.lit(1)).repartition(5)
    for least, most in ((4, 2000), (2, 7)):
        got = [tuple(r) for r in C.collocations(df, least=least, most=most, dict_words=dict_words).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_phrases(docs, least, most)


def test_phrases_of_odd_rows(odd, nothing):
    assert C.collocations(nothing).count() == 0
    got = {r.phrase: r.a for r in C.collocations(odd, least=2).collect()}
    assert got["a b c"] == 3 and all(len(p.split(" ")) <= 5 for p in got)


def test_scores_are_exact(spark):
    rnd = random.Random(3)
    rows = [(a, rnd.randrange(a, 10**13), rnd.randrange(a, a * 50), rnd.randrange(a, a * 90)) for a in (rnd.randrange(100, 10**12) for _ in range(200))]
    got = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint").select("*", C.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)


def test_bitmap_holds_all_pairs(spark):
    ids = np.random.default_rng(1).integers(1, 10**9, (500, 2))
    keys = spark.createDataFrame([(k,) for k in C._keys(ids).to_pylist()], "key binary")
    bits = C.bitmap(keys, 500)
    slots = C._slots(ids[:, 0], ids[:, 1], len(bits))
    assert (bits[(slots >> np.uint64(6)).astype(int)] >> (slots & np.uint64(63)) & np.uint64(1)).all() and np.bitwise_count(bits).sum() <= 500


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_collocations"])
def test_queries_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())
