"""Quality rules, line first: judge every line, remove the lines that fail, reject documents that lose too much.

DataFrame functions only. A line fails when it is boilerplate (a stock phrase in a short line), navigation (many
separators), noise (many symbol characters for its words), shouting (capitals throughout) or, where it has several
words, lacks any sentence punctuation. Separately, the document-level base rule rejects texts of under ``min_words``
words and texts in which more than ``max_repeat_percent`` percent of the words lie in 5-word windows that occur twice.

Null and empty texts have no words, fail the base rule and are rejected. Lines without a word are neither judged nor
counted. Rows are judged one by one, so ties, repeated rows and empty tables need no care. Other columns pass through
untouched; those with the names of results are replaced by these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import UPPER, let, table, unused, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """The rules' patterns and thresholds; patterns are valid both for Java and for RE2."""

    boilerplate: str = r"cookie|javascript|all rights reserved|terms of use|terms of service|privacy policy|subscribe|sign in|sign up|log in|click here|read more|share this|newsletter"
    boilerplate_words: int = 25
    separators: str = "|»•›"
    max_separators: int = 3
    punctuation: str = ".!?…。"
    punctuation_words: int = 8
    max_symbols_per_word: float = 0.2
    shout_words: int = 4
    max_shout_share: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20
    max_lost_share: float = 0.5


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, n: Column, rules: LineRules) -> Column:
    """Whether a line of n words fails a rule. A run of capitals counts as shouted where two capitals meet."""
    boilerplate = (n <= rules.boilerplate_words) & F.lower(line).rlike(rules.boilerplate)
    navigation = _count(line, rules.separators) >= rules.max_separators
    noise = _count(line, SYMBOLS) > rules.max_symbols_per_word * n
    shouting = (n >= rules.shout_words) & (_count(line, UPPER) > rules.max_shout_share * F.length(F.translate(line, " ", "")))
    unpunctuated = (n >= rules.punctuation_words) & (_count(line, rules.punctuation) == 0)
    return boilerplate | navigation | noise | shouting | unpunctuated


def repeated_words(w: Column) -> Column:
    """How many of the words lie in a 5-word window that occurs twice or more in the same text.

    Windows are compared by 64-bit hash. Texts without any repeated window, most of them, are told by a distinct
    count; only the rest sort their windows. ``w`` is computed once even where Spark moves this expression.
    """

    def hashes(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        again = let(ordered, lambda s: F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["p"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"))
        return F.aggregate(F.sort_array(again), start, step)["total"]

    found = lambda v: let(hashes(v), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return let(w, lambda v: F.when(F.size(v) < WINDOW, F.lit(0)).otherwise(found(v))).cast("long")


def line_first(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, cleaned and kept."""
    whole = F.coalesce(F.col(text), F.lit(""))
    per_line = F.transform(F.split(whole, "\n"), lambda line: let(F.size(words(line)), lambda n: F.struct(line.alias("line"), n.alias("n"), ((n > 0) & line_fails(line, n, rules)).alias("bad"))))
    text_words, lines = unused(docs.columns, "_w", "_lines")
    df = docs.withColumn(text_words, words(F.col(text))).withColumn(lines, per_line)
    full = F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["line"])
    good = F.filter(lines, lambda x: ~x["bad"])
    df = (
        df.withColumn("n_words", F.size(text_words).cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", _count(whole, SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col(text_words)))
        .withColumn("kept_words", F.aggregate(good, F.lit(0), lambda a, x: a + x["n"]).cast("long"))
        .withColumn("cleaned", F.array_join(F.transform(good, lambda x: x["line"]), "\n"))
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    lost = F.col("n_words") - F.col("kept_words") > rules.max_lost_share * F.col("n_words")
    return df.withColumn("kept", ~failed & ~lost).drop(text_words, lines)


BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    """Base counts and the line-first verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_first(docs).select("doc_id", *BASE_COLUMNS)


def oracle(rules: LineRules = LineRules()) -> str:
    """The same verdicts in DuckDB SQL."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda x, chars: f"(length({x}) - length(translate({x}, {lit(chars)}, '')))"
    w = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {w}) AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, p - coalesce(prev, -10))) AS n
        FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, {w})) AS n
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT doc_id, line, n,
        (n <= {rules.boilerplate_words} AND regexp_matches(lower(line), {lit(rules.boilerplate)}))
        OR {count("line", rules.separators)} >= {rules.max_separators}
        OR {count("line", SYMBOLS)} > {rules.max_symbols_per_word} * n
        OR (n >= {rules.shout_words} AND {count("line", UPPER)} > {rules.max_shout_share} * length(replace(line, ' ', '')))
        OR (n >= {rules.punctuation_words} AND {count("line", rules.punctuation)} = 0) AS bad
      FROM l WHERE n > 0),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, sum(CASE WHEN bad THEN 0 ELSE n END) AS good FROM j GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST({count("d.t", SYMBOLS)} AS BIGINT) AS n_symbols,
        CAST(coalesce(s.dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(s.good, 0) AS good
      FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id),
v AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words - good > {rules.max_lost_share} * n_words) AS kept
FROM v"""
