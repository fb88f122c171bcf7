"""Mixing to target weights with soft domain membership, in built-in functions and Spark's own regression only: no row leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, let, spare, stored, words_of

#: The classifier is fitted on so many labelled rows at most, chosen by a hash of the row.
FIT_ROWS = 20_000
#: Features are told apart by a hash of so many values; the penalty of large weights against all rows together, so that few rows make small weights; the steps of a fit at most.
HASHED, PENALTY, FIT_STEPS = 1 << 14, 1.0, 50
#: A domain with fewer labelled rows than this isn't told by words: its probability is its share of all labelled rows.
LEAST_ROWS = 10
#: Steps for the rates at most; they end before at this residual.
STEPS, TOLERANCE = 25, 1e-3
SEED = 11


def features(text: Column) -> Column:
    """The different features of a text: its words in lower case without marks, and its shape in coarse steps."""
    text = F.coalesce(text, F.lit(""))

    def share(name: str, part: Column, whole: Column) -> Column:
        return F.concat(F.lit(f"<{name} "), F.floor(10 * part / F.greatest(whole, F.lit(1))).cast("string"), F.lit(">"))

    # capitals and symbols are few, so what is left of one pass over the text is short
    marks = F.regexp_replace(text, "[^\\p{Lu}#*$%&|<>!]+", "")

    def of(words: Column) -> Column:
        def both(distinct: Column) -> Column:
            shapes = F.array(
                F.concat(F.lit("<words "), F.floor(F.log2(1.0 + F.size(words))).cast("string"), F.lit(">")),
                share("distinct", F.size(distinct), F.size(words)),
            )
            return F.concat(distinct, shapes, let(marks, told))

        def told(found: Column) -> Column:
            return let(F.length(F.regexp_replace(found, "\\p{Lu}+", "")), lambda n: F.array(share("upper", F.length(found) - n, F.length(text)), share("symbols", n, F.length(text))))

        return let(F.array_distinct(words), both)

    return let(F.split(F.lower(text), "[ \\t-\\r.,;:]+"), of)


@dataclass(frozen=True)
class Classifier:
    """The share of each domain in the labelled rows, and a regression over the domains (their numbers are in told) that have enough of them."""

    domains: tuple[str, ...]
    shares: tuple[float, ...]
    told: tuple[int, ...] = ()
    model: LogisticRegressionModel | None = None

    def with_posterior(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """df with out_col, array<double>: the probability of each domain."""
        if self.model is None:
            return df.withColumn(out_col, F.array(*map(F.lit, self.shares)))
        found, hashed, p = spare(df.withColumn(out_col, F.lit(None)), "found", "hashed", "p")
        model = self.model.copy().setFeaturesCol(hashed).setProbabilityCol(p).setRawPredictionCol("").setPredictionCol("")
        judged = model.transform(_hashing(found, hashed).transform(df.withColumn(found, features(F.col(f"`{text_col}`")))))
        at, left = {d: k for k, d in enumerate(self.told)}, sum(self.shares[d] for d in self.told)
        each = F.array(*(left * F.get(F.col(p), F.lit(at[d])) if d in at else F.lit(self.shares[d]) for d in range(len(self.domains))))
        return judged.withColumn(p, vector_to_array(p)).withColumn(out_col, each).drop(found, hashed, p)


def _hashing(found: str, hashed: str) -> HashingTF:
    return HashingTF(numFeatures=HASHED, binary=True, inputCol=found, outputCol=hashed)


def fit(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", domains: Sequence[str] | None = None, fit_rows: int = FIT_ROWS) -> Classifier:
    """A multinomial logistic regression over all features, by a quasi-Newton method until it converges.

    labelled has id_col and domain_col; rows of it without a domain or without a text don't count. At most about
    fit_rows rows are used. A step is one aggregate over them; what reaches the driver are the weights' slopes and a
    count for each domain.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain")).where("domain IS NOT NULL"), "id").where("text IS NOT NULL")
    if domains is not None:
        rows = rows.where(F.col("domain").isin(*domains))
    share = min(1.0, fit_rows / max(1, labelled.count()))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    parts = df.sparkSession.sparkContext.defaultParallelism
    known = cut(sample.repartition(parts).select("domain", features(F.col("text")).alias("found")))
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    names = tuple(domains) if domains is not None else tuple(sorted(sizes))
    n = sum(sizes.values())
    shares = tuple((sizes.get(d, 0) + 1) / (n + len(names)) for d in names)
    told = tuple(i for i, d in enumerate(names) if sizes.get(d, 0) >= LEAST_ROWS)
    if len(told) < 2:
        return Classifier(names, shares)
    label = F.element_at(F.create_map(*(x for k, i in enumerate(told) for x in (F.lit(names[i]), F.lit(float(k))))), F.col("domain"))
    rows = known.where(F.col("domain").isin(*(names[i] for i in told))).withColumn("label", label)
    regression = LogisticRegression(featuresCol="hashed", labelCol="label", family="multinomial", regParam=PENALTY / n, maxIter=FIT_STEPS, standardization=False)
    return Classifier(names, shares, told, regression.fit(_hashing("found", "hashed").transform(rows).select("label", "hashed")))


def _rate(p: Column, steps: Sequence[Sequence[float]], once: int | None = None) -> Column:
    """The rate of a document after projected steps from 1; each step is a vector over the domains and the momentum before it.

    once: the number of a domain. Documents for which no other is likelier keep rate 1, and no rate goes above 1. A fold over a constant, so that the plan and its compiled code stay the same size for any number of steps.
    """
    if not steps:
        return F.lit(1.0)
    k = len(steps[0]) - 1
    said = F.expr("array(" + ", ".join("array(" + ", ".join(f"double('{x!r}')" for x in step) + ")" for step in steps) + ")")
    most = F.lit(math.inf if once is None else 1.0)

    def moved(at: Column, s: Column) -> Column:
        ahead = at["r"] + F.get(s, F.lit(k)) * (at["r"] - at["q"])
        along = sum((F.get(p, F.lit(i)) * F.get(s, F.lit(i)) for i in range(k)), F.lit(0.0))
        return F.struct(F.least(most, F.greatest(F.lit(0.0), ahead - along)).alias("r"), at["r"].alias("q"))

    rate = F.aggregate(said, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q")), moved, lambda at: at["r"])
    return rate if once is None else F.when(F.get(p, F.lit(once)) >= F.array_max(p), F.lit(1.0)).otherwise(rate)


@dataclass(frozen=True)
class Rates:
    """The steps that make a document's rate, and how far the totals then are from their aims: the sum of differences as a share of the aims."""

    steps: list[list[float]]
    residual: float


def _exact(x: Column) -> Column:
    """A sum that doesn't depend on the order of rows: of whole numbers of 1e-4."""
    return F.sum(F.round(1e4 * x).cast("long")) / 1e4


def solve(posteriors: DataFrame, targets: Sequence[float], scale: float | None = None, whole: int | None = None, once: bool = False) -> Rates:
    """Steps of projected-gradient least squares for rates r >= 0 of documents; posteriors has n_tokens and p.

    With c[k] = sum of n * p[k], the expected tokens of domain k, it lessens the sum over k of (S[k] - T[k])^2 / c[k], where
    S[k] = sum of r * n * p[k] and T[k] = scale * weight[k] * (all tokens). All documents move at once, each by p . (S - T) / c
    with the momentum of accelerated projected gradients, so a step is a vector over the domains and one aggregate gives the next. scale None: the most for which no domain
    needs more tokens than it has. A domain without tokens is left out. Where the targets can't be met (a domain's tokens
    all stand in documents of another), the residual says so.

    whole: the number of a domain, whose T is all its tokens; T of the others is their share next to it, or all that they
    have if that is less, so a scarce domain doesn't shrink the rest. once: as in _rate, for that domain.
    """
    k = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    n = F.col("n_tokens").cast("double")
    row = posteriors.agg(*(_exact(n * x).alias(f"c{i}") for i, x in enumerate(p)), *(_exact(n * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    mass = [row[f"c{i}"] or 0.0 for i in range(k)]
    total = sum(mass)
    live = [i for i in range(k) if mass[i] > 0 and total > 0]
    if not live:
        return Rates([], 0.0)
    weight = sum(targets[i] for i in live) or 1.0
    aim = [targets[i] / weight * total if i in live else 0.0 for i in range(k)]
    anchored = whole is not None and aim[whole] > 0
    if scale is None:
        scale = mass[whole] / aim[whole] if anchored else min(mass[i] / aim[i] for i in live if aim[i] > 0)
    aim = [min(scale * x, mass[i]) if anchored else scale * x for i, x in enumerate(aim)]
    # the largest row sum of the scaled moment matrix bounds its largest eigenvalue
    bound = max(sum((row[f"m{min(i, j)}_{max(i, j)}"] or 0.0) / mass[j] for j in live) for i in live)
    steps: list[list[float]] = []
    off = lambda now: sum(abs(now[i] - aim[i]) for i in live) / (sum(aim) or total)
    now, last, residual, pace = list(mass), list(mass), off(mass), 1.0
    while len(steps) < STEPS and residual >= TOLERANCE:
        quicker = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = round((pace - 1) / quicker, 12), quicker
        ahead = [x + momentum * (x - y) for x, y in zip(now, last, strict=True)]  # totals are linear in the rates
        steps.append([*(round((ahead[i] - aim[i]) / mass[i] / bound, 12) if i in live else 0.0 for i in range(k)), momentum])
        moved = posteriors.select("p", (n * _rate(F.col("p"), steps, whole if once else None)).alias("kept"))
        got = moved.agg(*(_exact(F.col("kept") * x).alias(f"s{i}") for i, x in enumerate(p))).first()
        last, now = now, [got[f"s{i}"] or 0.0 for i in range(k)]
        residual = off(now)
    return Rates(steps, residual)


def mix(df: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", out_col: str = "mix", scale: float | None = None, fit_rows: int = FIT_ROWS, with_text: bool = True, whole: str | None = None, once: bool = False) -> DataFrame:
    """df with out_col: struct<n_tokens, posterior: map<domain, double>, rate, copies, residual>; without text_col unless with_text.

    Tokens are words. copies is rate rounded up or down by a hash of id and text, with an expectation of rate. residual,
    the same in every row, is how far the expected totals are from the targets, as a share of them. A null or empty text
    has no tokens and is judged like a text with no words. Repeated rows get equal results. An empty df gives no
    rows; with no labelled rows the domains are equally likely, and a domain with few has its share as its probability. An out_col already there is replaced, other columns pass
    through, whatever their names. Posteriors are computed once and stored by columns next to the row in the shared
    folder; the sums that fit the rates read those columns alone. A text of any length is one row.

    whole: a domain that keeps all its tokens; the targets of the others are upper bounds next to it, and none needs
    more than it has. once: documents for which no domain is likelier than whole have rate 1 and one copy, the others one at most.
    """
    domains = tuple(targets)
    kept = None if whole is None else domains.index(whole)
    model = fit(df, labelled, id_col, text_col, domain_col, domains, fit_rows)
    text = F.col(f"`{text_col}`")
    chance = F.pmod(F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`"), text), F.lit(1 << 52)) / float(1 << 52)
    (posterior_col,) = spare(df, "posterior")
    p = F.transform(posterior_col, lambda x: F.round(x, 9))
    judged = model.with_posterior(df, text_col, posterior_col).withColumn(out_col, F.struct(F.size(words_of(text)).cast("long").alias("n_tokens"), p.alias("p"), chance.alias("u"))).drop(posterior_col)
    judged = stored(judged if with_text else judged.drop(text_col))
    rates = solve(judged.select(f"{out_col}.*"), [targets[d] for d in domains], scale, kept, once)

    def of(x: Column) -> Column:
        posterior = F.map_from_arrays(F.array(*(F.lit(d) for d in domains)), x["p"])
        return let(_rate(x["p"], rates.steps, kept if once else None), lambda rate: F.struct(x["n_tokens"], posterior.alias("posterior"), rate.alias("rate"), F.floor(rate + x["u"]).cast("long").alias("copies"), F.lit(rates.residual).alias("residual")))

    return judged.withColumn(out_col, let(F.col(out_col), of))
