"""Quality rules as a short-circuit cascade, in built-in functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, words_of

#: Rows, about, on which a rule's cost and selectivity are estimated. They decide the order of rules, never a verdict.
SAMPLE_ROWS = 1000
#: A rule is timed on so many copies of the sample in one job, and so often; the shortest time counts.
COPIES, TIMES = 16, 2


@dataclass(frozen=True)
class Rule:
    """A text fails if fails(text, s) holds; s is the struct of base_stats()."""

    name: str
    fails: Callable[[Column, Column], Column]


def _only(text: Column, kind: str) -> Column:
    """How many characters of a Unicode category a text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


RULES = (
    Rule("symbols", lambda text, s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("dup_lines", lambda text, s: 10 * (s["n_dup_lines"] - 1) > 3 * s["n_lines"]),
    Rule("word_length", lambda text, s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 14 * s["n_words"])),
    Rule("shouting", lambda text, s: 2 * _only(text, "\\p{Lu}") > _only(text, "\\p{L}")),
    Rule("letters", lambda text, s: 2 * _only(text, "\\p{L}") < s["word_chars"]),
    Rule("exclaims", lambda text, s: 4 * _only(text, "!") > s["n_words"]),
)


def _repeated(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more; windows are compared by a 64-bit hash."""

    def counted(windows: Column) -> Column:
        def flagged(order: Column) -> Column:
            same = F.filter(order, lambda x, i: (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"]))
            return let(F.transform(same, lambda x: x["i"]), lambda at: F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))))

        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(order, flagged))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, counted))


def base_stats(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words: bigint> of a whole text; null counts as empty.

    Lines are the \\n-split parts that hold a word.
    """
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), _repeated(words).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    parts = F.struct(let(words_of(text), of).alias("w"), by_line.alias("l"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("n_symbols"))
    fields = {"n_words": "w", "word_chars": "w", "n_symbols": None, "n_lines": "l", "n_dup_lines": "l", "n_repeat_words": "w"}
    return let(parts, lambda p: F.struct(*((p[k][n] if k else p[n]).cast("long").alias(n) for n, k in fields.items())))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def costs(sample: DataFrame, rules: Sequence[Rule]) -> dict[str, float]:
    """Seconds that each rule takes for one pass over sample (text, s), without what any job takes.

    A job evaluates the rule on COPIES of every row; the time of the same job without a rule is taken off.
    """
    rows = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))

    def seconds(fails: Column) -> float:
        def once() -> float:
            began = time.perf_counter()
            rows.agg(F.count_if(fails)).first()
            return time.perf_counter() - began

        return min(once() for _ in range(TIMES))

    empty = seconds(F.length("text") < 0)
    return {rule.name: max(seconds(rule.fails(F.col("text"), F.col("s"))) - empty, 1e-6) / COPIES for rule in rules}


def ranked(rules: Sequence[Rule], failed: Sequence[tuple[frozenset[str], int]], cost: Mapping[str, float]) -> list[Rule]:
    """Rules so that each next one rejects most per cost of what the ones before it let pass.

    failed: how many rows fail just this set of rules. Of equals the earlier rule comes first.
    """
    left, out = list(rules), []
    while left:
        rows = [(names, n) for names, n in failed if not names & {r.name for r in out}]
        best = max(left, key=lambda r: sum(n for names, n in rows if r.name in names) / cost[r.name])
        left.remove(best)
        out.append(best)
    return out


def ordered(df: DataFrame, text_col: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by falling rejection per cost, both measured on a random sample of about sample_rows rows that pass the base test."""
    share = min(1.0, sample_rows / max(1, df.count()))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sample = df.select(text.alias("text")).sample(share, seed=7).withColumn("s", base_stats(F.col("text"))).where(~base_failed(F.col("s"))).cache()
    try:
        verdicts = F.array_compact(F.array(*(F.when(rule.fails(F.col("text"), F.col("s")), rule.name) for rule in rules)))
        failed = [(frozenset(r["failed"]), r["count"]) for r in sample.groupBy(verdicts.alias("failed")).count().collect()]  # a row for each set of rules at most
        return ranked(rules, failed, costs(sample, rules))
    finally:
        sample.unpersist()


def quality_rules(df: DataFrame, text_col: str = "text", out_col: str = "quality", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with out_col: struct of base_stats() and base_failed, kept.

    A row is kept if neither the base test nor any rule rejects it. The rules form one CASE, so a row leaves at the
    first that rejects it; their order comes from ordered() and can't change the verdict. The counts are part of the
    result, so they are made for every row before the cascade; what the cascade spares are the rules' own scans of the
    text. A null or empty text has zero counts and fails the base test; a text of any length is judged whole. Repeated
    rows get equal results, an empty table stays empty. An out_col already there is replaced; all other columns pass
    through, whatever their names. There is no shuffle.
    """
    cascade = ordered(df, text_col, rules, sample_rows)

    def judged(x: Column) -> Column:
        text, s = x["text"], x["s"]
        kept = F.when(base_failed(s), F.lit(False))
        for rule in cascade:
            kept = kept.when(F.coalesce(rule.fails(text, s), F.lit(False)), F.lit(False))
        fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
        return F.struct(*(s[n].alias(n) for n in fields), base_failed(s).alias("base_failed"), kept.otherwise(F.lit(True)).alias("kept"))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.withColumn(out_col, let(F.struct(text.alias("text"), base_stats(text).alias("s")), judged))
