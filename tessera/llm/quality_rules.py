"""Operator 2: quality rules, one Spark projection compiled from a threshold table.

Built-in functions only. Measures of a text are array expressions inside its row, so
nothing is shuffled and a row's work is about linear in its text (windows that occur
twice are found by sorting their fingerprints).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._session import documents, prepare

GAPS = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Shorter texts may well do without function words.
STOP_WORDS_FROM = 50


@dataclass(frozen=True)
class Rule:
    """A text passes where low <= measure <= high; a null measure passes."""

    measure: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        value = F.col(self.measure)
        tests = ([value < F.lit(self.low)] if self.low is not None else []) + ([value > F.lit(self.high)] if self.high is not None else [])
        return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


#: Texts below these thresholds are too short or repeat themselves.
BASE_RULES = (Rule("n_words", low=10), Rule("repeat_percent", high=20.0))

#: The method's own thresholds, over and above the base.
RULES = (
    Rule("mean_word", low=2.0, high=16.0),
    Rule("symbols_per_word", high=0.10),
    Rule("stop_word_share", low=0.02),
    Rule("dup_line_share", high=0.40),
    Rule("capital_share", high=0.30),
    Rule("pipe_share", high=0.25),
)

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be by this at from or an a",
    "le la les de des du un une et en est que qui dans pour sur par au",
    "der die das und ist von zu den mit nicht ein eine im auf für des dem",
    "el los las del y en es que un una por con para se su al lo",
)


def measures(docs: DataFrame) -> DataFrame:
    """Adds word, symbol, line and repetition measures of ``text`` (null: no words) to doc_id."""
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = texts.select(
        "doc_id", "text",
        F.array_remove(F.split("text", GAPS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n, words = F.size("words"), F.col("words")
    ends = F.sequence(F.lit(0), n - WINDOW)
    at = lambda i, k: F.get(words, i + k)
    counted = parts.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(" ".join(STOP_WORDS).split()))))).alias("n_stop_words"),
        F.size(F.array_remove(words, "|")).alias("n_no_pipe"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.when(n >= WINDOW, F.transform(ends, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    pairs = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.arrays_zip(F.col("grams").alias("h"), F.sequence(F.lit(0), F.size("grams") - 1).alias("i"))))
    pairs = pairs.otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    sorted_ = counted.withColumn("pairs", pairs).drop("grams")
    same = lambda x, k: (F.get("pairs", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("pairs", F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
    again = sorted_.withColumn("again", F.sort_array(F.transform(F.filter("pairs", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))).drop("pairs")
    reach = F.transform("again", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("again", k + 1) - x, F.lit(WINDOW))))
    out = again.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0), lambda s, v: s + v).cast("long")).drop("again")
    share = lambda top, bottom: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
    return out.select(
        "*",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        F.when(F.col("n_words") >= STOP_WORDS_FROM, F.col("n_stop_words") / F.col("n_words")).alias("stop_word_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        (1 - F.when(F.col("n_words") > 0, F.col("n_no_pipe") / F.col("n_words"))).alias("pipe_share"),
        F.when(F.col("n_words") > 0, 100.0 * F.col("n_repeat_words") / F.col("n_words")).alias("repeat_percent"),
    )


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Adds base_failed, kept and failed (the names of the measures that fail)."""
    any_of = lambda rs: reduce(lambda a, b: a | b, [r.failed() for r in rs], F.lit(False))
    failed = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.measure)) for r in (*base, *rules)]))
    return measured.withColumns({"base_failed": any_of(base), "kept": ~(any_of(base) | any_of(rules)), "failed": failed})


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, kept, failed.

    Null and empty text: no words, base_failed. Null doc_id stays null; repeated rows are
    judged each; other columns are ignored; an empty table gives no rows. Windows of words
    are compared by 64-bit fingerprint within one text.
    """
    prepare(docs.sparkSession)
    return judge(measures(docs), rules)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the rules keep, whole.

    The verdict is computed beside the row itself, so nothing is joined. The row's number
    keeps the filter from being pushed below the measures, where they would be computed
    anew for each use.
    """
    prepare(spark)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc_id"), "text")
    measured = measures(packed).withColumn("row_number", F.monotonically_increasing_id())
    return judge(measured).where("kept and row_number >= 0").select("doc_id.*")


#: The base in DuckDB SQL; ``kept`` follows from the same table of rules.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM p),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS gram
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
m AS (SELECT p.doc_id, len(words) AS n_words, coalesce(len(array_to_string(words, '')), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(words, lambda w: lower(w) IN ({", ".join("'" + w + "'" for w in sorted(set(" ".join(STOP_WORDS).split())))}))) AS n_stop_words,
  len(list_filter(words, lambda w: w = '|')) AS n_pipe, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AND word_chars / n_words BETWEEN 2.0 AND 16.0 AND n_symbols / n_words <= 0.10
    AND (n_words < 50 OR n_stop_words / n_words >= 0.02) AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.40) AND n_capitals / word_chars <= 0.30 AND n_pipe / n_words <= 0.25 AS kept
FROM m
"""
