"""The queries over the tables, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read
from .collocations import collocations
from .filter_audit import filter_audit
from .html import html_text
from .languages import detect_language, fit_languages, held_out
from .licenses import license_scan
from .line_dedup import line_dedup
from .media import text_as_media
from .mixing import mix
from .near_duplicates import ngram_jaccard_join
from .quality import quality_rules
from .secrets import secret_scan
from .sentencepieces import encode_column
from .token_counts import token_counts


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(read(spark, sf_dir, "documents")).select("doc_id", *(q[n].alias(n) for n in names))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pieces.*")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: each lies in a folder of its language in the folder of its source."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return license_scan(read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of each document."""
    c = F.col("token_counts")
    rows = token_counts(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", c["n_tokens"].alias("doc_tokens"), F.posexplode(F.arrays_zip(c["starts"], c["ends"], c["tokens"])).alias("section", "s"))
    return rows.select("doc_id", "doc_tokens", F.col("section").cast("long").alias("section"), F.col("s")["starts"].alias("start_char"), F.col("s")["ends"].alias("end_char"), F.col("s")["tokens"].cast("long").alias("n_tokens"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_removed")


#: Shares of tokens that op6 mixes to.
TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens counts words; the targets are shares of them."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("low")
    labelled = read(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    m = F.col("mix")
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text"), labelled, TARGETS, with_text=False, whole="good")
    return mixed.select("doc_id", m["n_tokens"].alias("n_tokens"), *(m["posterior"][d].alias(f"p_{d}") for d in TARGETS), m["rate"].alias("rate"), m["copies"].alias("copies"), m["residual"].alias("residual"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read(spark, sf_dir, "pages")).select("page_id", "url", "extracted.text", "extracted.n_chars")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_as_media(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media.*")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    languages = fit_languages(docs.where(~out))  # a null id teaches nothing
    found = detect_language(docs.select("doc_id", "text"), languages, out_col="text")
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text.*")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_sentencepiece, op3_license_scans, op4_token_counts, op5_line_dedup, op6_mixing, op7_html_extraction, op8_quality_rules, op9_secret_scans, op10_media_columns, op11_filter_audit, op12_language_id, op13_collocations)}

SQL: dict[str, str] = {}

SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[ \t-\r]+') IF x <> ''] AS ws,
                  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ \t-\r]')] AS ls FROM d),
     g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
     h AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g),
     v AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY r),
     s AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
                  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
                  length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper,
                  length(regexp_replace(t, '[^!]+', '', 'g')) AS bangs
           FROM w LEFT JOIN v USING (r)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * (n_dup_lines - 1) > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * upper > letters OR 2 * letters < word_chars OR 4 * bangs > n_words) AS kept
FROM b
"""

SQL["op5_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
     p AS (SELECT r, doc_id, nr, ls[nr] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS nr FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d))),
     q AS (SELECT r, doc_id, nr, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '[^ ]+(?: +[^ ]+){0,9} *| +') END AS us FROM p),
     u AS (SELECT r, doc_id, nr, k, us[k] AS unit FROM (SELECT *, unnest(range(1, len(us) + 1)) AS k FROM q)),
     h AS (SELECT *, CAST('0x' || substr(md5(unit), 1, 7) AS BIGINT) AS h, row_number() OVER (PARTITION BY r ORDER BY nr, k) AS i FROM u),
     m AS (SELECT *, i = 1 OR (k = 1 AND (coalesce(lead(nr, 2) OVER w = nr, false) OR coalesce(lag(nr, 3) OVER w = lag(nr) OVER w, false))) AS starts,
                  coalesce((lag(h, 2) OVER w * 961 + lag(h) OVER w * 31 + h) % 1000003 % 3 = 0, false) AS hit FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
     n AS (SELECT *, hit AND NOT starts AND NOT coalesce(lag(starts) OVER (PARTITION BY r ORDER BY i), true) AS inside FROM m),
     b AS (SELECT *, starts OR (inside AND NOT coalesce(lag(starts, 2) OVER w, true) AND NOT coalesce(lead(starts) OVER w, true) AND NOT coalesce(lead(starts, 2) OVER w, true)
                     AND NOT coalesce(lag(inside) OVER w, false) AND NOT coalesce(lag(inside, 2) OVER w, false)) AS begins FROM n WINDOW w AS (PARTITION BY r ORDER BY i)),
     k AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS pos FROM b),
     c AS (SELECT r, any_value(doc_id) AS doc_id, pos, string_agg(CASE WHEN k = 1 AND NOT begins THEN chr(10) ELSE '' END || unit, '' ORDER BY i) AS chunk,
                  count(*) >= 3 AND bool_or(regexp_matches(unit, '[^ \t-\r]')) AS asked, min(nr) AS first_nr, max(nr) AS last_nr FROM k GROUP BY r, pos),
     f AS (SELECT chunk, count(*) AS times, min(doc_id) AS first FROM c WHERE asked GROUP BY chunk),
     g AS (SELECT c.*, asked AND times > 1 AND (doc_id <> first OR row_number() OVER (PARTITION BY r, c.chunk ORDER BY pos) > 1) AS gone FROM c LEFT JOIN f ON c.chunk = f.chunk),
     s AS (SELECT *, CASE WHEN lag(last_nr) OVER (PARTITION BY r ORDER BY pos) <> first_nr THEN chr(10) ELSE '' END AS apart FROM g WHERE NOT coalesce(gone, false)),
     t AS (SELECT r, string_agg(apart || chunk, '' ORDER BY pos) AS text FROM s GROUP BY r),
     x AS (SELECT r, any_value(doc_id) AS doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed FROM g GROUP BY r)
SELECT doc_id, coalesce(text, '') AS text, n_removed FROM x LEFT JOIN t USING (r)
"""

SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
     w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[ \t-\r]+') IF x <> ''] AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
     f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                  (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
                  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
                  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
           FROM w LEFT JOIN l USING (doc_id)),
     c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
     e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS me, substr(filter_order, 1, step - 1) AS earlier
           FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o)),
     x AS (SELECT part, filter_order, step, me, n, good, toxic, contains(fails, me) AS hit, fails = me AS alone,
                  earlier <> '' AND translate(fails, earlier, '') <> fails AS gone FROM c, s),
     g AS (SELECT part, filter_order, step, me, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
           FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, me) AS BIGINT) AS shapley
FROM g
"""

SQL["op13_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n-\r]')) AS piece FROM d),
     w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \t]+') IF x <> ''] AS ws FROM p),
     n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
     k AS (SELECT *, unnest(range(1, 6)) AS size FROM w),
     i AS (SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM k WHERE len(ws) >= size),
     f AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= 100),
     c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
     h AS (SELECT lang, size, phrase, a, ws, unnest(range(1, size)) AS cut FROM c),
     s AS (SELECT h.lang, h.phrase, h.a, cut, l.a AS l, r.a AS r, n.n, CAST((1000 * CAST(h.a AS HUGEINT) * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
           FROM h JOIN f l ON l.lang = h.lang AND l.phrase = array_to_string(h.ws[1:cut], ' ') JOIN f r ON r.lang = h.lang AND r.phrase = array_to_string(h.ws[cut + 1:h.size], ' ')
           JOIN n ON n.lang = h.lang),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     m AS (SELECT lang, a, size, ws, unnest(range(2, size)) AS part FROM c),
     o AS (SELECT lang, a, array_to_string(ws[q:q + part - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - part + 2)) AS q FROM m)),
     x AS (SELECT lang, phrase, max(a) AS around FROM o GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN x USING (lang, phrase) WHERE x.around IS NULL OR 100 * x.around < 100 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
