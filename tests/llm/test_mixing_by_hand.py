"""Posteriors, copies and the residual of the mixing, recomputed from the weights and the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import mixing as M


def documents(spark):
    rows = [(i, " ".join(("foul vile" if i % 5 == 0 else "fine mild", *(f"w{(i * 7 + j * j) % 23}" for j in range(20 + i % 30)))), "bad" if i % 5 == 0 else "good") for i in range(300)]
    return spark.createDataFrame([*rows, (900, "", None), (901, None, None)], "doc_id bigint, text string, kind string")


def test_posteriors_copies_and_residual(spark):
    df = documents(spark)
    labels = df.where("doc_id < 200").select("doc_id", F.col("kind").alias("domain"))
    targets = {"good": 0.7, "bad": 0.3}
    model = M.fit(df, labels, domains=tuple(targets))
    assert model.told == (0, 1) and model.shares == (161 / 202, 41 / 202)
    weights, constant = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    hashing = M._hashing("found", "hashed")
    found = {r.doc_id: r.f for r in df.select("doc_id", M.features(F.col("text")).alias("f")).collect()}
    rows = M.mix(df, labels, targets).collect()
    for r in rows:
        logs = weights[:, sorted({hashing.indexOf(f) for f in found[r.doc_id]})].sum(1) + constant
        want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum() * sum(model.shares)
        assert [r.mix["posterior"][d] for d in targets] == pytest.approx(list(want), abs=1e-6)
    n, p, rate = np.array([r.mix["n_tokens"] for r in rows], float), np.array([[r.mix["posterior"][d] for d in targets] for r in rows]), np.array([r.mix["rate"] for r in rows])
    mass = (n[:, None] * p).sum(0)
    aim = np.array(list(targets.values())) * mass.sum()
    aim *= (mass / aim).min()
    left = np.abs(((rate * n)[:, None] * p).sum(0) - aim).sum() / aim.sum()
    assert {r.mix["residual"] for r in rows} == {rows[0].mix["residual"]} and rows[0].mix["residual"] == pytest.approx(left, abs=1e-5) and left < M.TOLERANCE
    u = {r.doc_id: r.u for r in df.select("doc_id", (F.pmod(F.xxhash64(F.lit(M.SEED), "doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)).alias("u")).collect()}
    assert all(r.mix["copies"] == int(np.floor(r.mix["rate"] + u[r.doc_id])) for r in rows)


def test_a_domain_with_few_rows_has_its_share(spark):
    df = documents(spark)
    few = df.where("doc_id < 30 OR doc_id = 35").select("doc_id", F.when(F.col("doc_id") < 30, "good").otherwise("bad").alias("domain"))
    model = M.fit(df, few, domains=("good", "bad"))
    assert model.model is None and model.shares == (31 / 33, 2 / 33)
    assert {tuple(r.p) for r in model.with_posterior(df, "text", "p").collect()} == {model.shares}
    three = few.unionByName(df.where("doc_id BETWEEN 100 AND 120").select("doc_id", F.lit("odd").alias("domain")))
    model = M.fit(df, three, domains=("good", "bad", "odd"))
    assert model.told == (0, 2)
    rows = model.with_posterior(df, "text", "p").collect()
    assert all(r.p[1] == model.shares[1] and sum(r.p) == pytest.approx(1) for r in rows)
