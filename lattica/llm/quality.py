"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule compares one signal of a text with a cutoff. A path, fixed before any label is seen, leads
from no rule at all to the strictest cutoffs of all rules, one cutoff a step. In each stratum the steps
are tested in that order on the labelled hold-out: an exact binomial test of "the rules of this step,
taken together, turn away more than ``max_false`` of the good documents". The last step before the
first that isn't rejected gives the stratum's cutoffs. As the path is fixed, no correction is needed
along it; the level is divided by the number of strata (Bonferroni). So with the given confidence no
stratum at all loses more than ``max_false`` of its good documents to the rules. A stratum needs some
ln(level) / ln(1 - max_false) good labels before the first step can pass: 86 with four strata.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SPACE_WORD, fresh, materialise, table

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of FEATURES (bigint). A null or empty text has 0 of everything.

    A repeated word is one that stands in a 3-word window whose words stand twice or more in the
    text. Windows are compared by sorting their 64-bit hashes together with their places, within
    the row: nothing is shuffled, and a very long text costs n log n.
    """
    df = fresh(df, *FEATURES)
    keep = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__t", t).withColumn("__w", F.regexp_extract_all("__t", F.lit(SPACE_WORD), 0))
    df = df.withColumn("__n", F.size("__w"))
    windows = "CASE WHEN __n >= 4 THEN array_sort(transform(sequence(0, __n - 3), i -> struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]) AS h, i AS p))) ELSE cast(array() AS array<struct<h:bigint,p:int>>) END"
    df = df.withColumn("__s", F.expr(windows))
    twice = "filter(transform(__s, (x, i) -> CASE WHEN (i > 0 AND __s[i - 1].h = x.h) OR (i + 1 < size(__s) AND __s[i + 1].h = x.h) THEN x.p ELSE -1 END), p -> p >= 0)"
    df = df.withColumn("__d", F.expr(f"CASE WHEN size(__s) > 1 THEN {twice} ELSE cast(array() AS array<int>) END"))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"\S")))
    return df.select(
        *keep,
        F.col("__n").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("__t", r"\s+", "")).cast("bigint").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.expr("CAST(size(array_distinct(flatten(transform(__d, p -> array(p, p + 1, p + 2))))) AS BIGINT)").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A document fails where signal > cutoff (upper) or signal < cutoff (not upper)."""

    name: str
    signal: Column | str
    upper: bool
    grid: tuple[float, ...]

    def fails(self, cutoff: Column) -> Column:
        value = F.expr(self.signal)
        return value > cutoff if self.upper else value < cutoff


#: Candidate cutoffs from loose to strict, fixed before any label is seen.
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", True, (3.0, 2.5, 2.0, 1.5, 1.0, 0.5, 0.25, 0.1)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", True, (0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    Rule("dup_lines", "n_dup_lines / greatest(n_words, 1)", True, (0.1, 0.05, 0.02, 0.01, 0.005)),
    Rule("short_words", "word_chars / greatest(n_words, 1)", False, (2.0, 2.5, 3.0, 3.5)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", True, (15.0, 12.0, 10.0, 8.0)),
)


def path(rules: tuple[Rule, ...]) -> list[dict[str, float]]:
    """The steps: cutoffs by rule. Each step takes the next rule, in turns, one cutoff further."""
    steps: list[dict[str, float]] = []
    for k in range(max((len(r.grid) for r in rules), default=0)):
        for r in rules:
            if k < len(r.grid):
                steps.append({**(steps[-1] if steps else {}), r.name: r.grid[k]})
    return steps


def _log_beta_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact to double precision: the regularised incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p  # P(X <= k) = I_{1-p}(n - k, k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def binomial_cdf(k: int, n: int, p: float) -> float:
    return min(1.0, max(0.0, _log_beta_tail(k, n, p)))


def learn_cutoffs(features: DataFrame, labels: DataFrame, stratum: str, max_false: float, confidence: float, rules: tuple[Rule, ...] = RULES) -> dict[str | None, dict[str, float]]:
    """The cutoffs by stratum. Gathers one row of counts for each stratum, which are few by nature (languages).

    ``labels`` has doc_id and quality; ids labelled twice count once, as good only if every label is 1.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__q")).where("__q = 1").select("doc_id")
    labelled = features.join(good, "doc_id", "left_semi")
    steps = path(rules)
    counts = [F.count_if(_any_fails(rules, step)).alias(f"__{j}") for j, step in enumerate(steps)]
    rows = labelled.groupBy(F.col(stratum).alias("__stratum")).agg(F.count("*").alias("__n"), *counts).collect()
    found: dict[str | None, dict[str, float]] = {}
    for row in rows:
        for j, step in enumerate(steps):
            if binomial_cdf(row[f"__{j}"], row["__n"], max_false) > (1.0 - confidence) / len(rows):
                break
            found[row["__stratum"]] = step
    return found


def _any_fails(rules: tuple[Rule, ...], cutoffs: dict[str, float]) -> Column:
    failed = F.lit(False)
    for r in rules:
        if r.name in cutoffs:
            failed = failed | r.fails(F.lit(cutoffs[r.name]))
    return failed


def apply_cutoffs(features: DataFrame, cutoffs: dict[str | None, dict[str, float]], stratum: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept. A stratum without cutoffs (unseen, or too few labels) fails nothing but the base."""
    failed = F.lit(False)
    for s, found in cutoffs.items():
        failed = failed | (F.col(stratum).eqNullSafe(F.lit(s)) & _any_fails(rules, found))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return fresh(features, "base_failed", "kept").withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~failed)


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = 0.05, confidence: float = 0.95, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's columns but the text, with FEATURES, base_failed and kept.

    Null and empty texts have no words and fail the base. Rows with equal or null ids are judged each
    by itself; a null id has no label. A null stratum is one like any other. No labels, or too few of a
    stratum, leave the base rules alone; an empty table gives an empty result. Texts are taken whole.
    Input columns of the added names are replaced.
    """
    features = materialise(text_features(docs).drop("text"), "features")  # read twice: to learn, to judge
    return apply_cutoffs(features, learn_cutoffs(features, labels, stratum, max_false, confidence, rules), stratum, rules)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = judge_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", *FEATURES, "base_failed", "kept")


def _sql(max_false: float = 0.05, confidence: float = 0.95, rules: tuple[Rule, ...] = RULES) -> str:
    """The same in SQL: binomial tails as sums of terms by log-gamma, the path as a table of steps."""
    steps = ", ".join(f"({j}, " + ", ".join(str(step.get(r.name, "NULL")) for r in rules) + ")" for j, step in enumerate(path(rules)))
    fails = " OR ".join(f"coalesce({r.signal} {'>' if r.upper else '<'} c_{r.name}, false)" for r in rules)
    names = ", ".join(f"c_{r.name}" for r in rules)
    return rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3
), g3 AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM p
), twice AS (
  SELECT doc_id, g FROM g3 GROUP BY doc_id, g HAVING COUNT(*) > 1
), r AS (
  SELECT doc_id, COUNT(*) AS n FROM (SELECT DISTINCT g3.doc_id AS doc_id, unnest(range(i, i + 3)) AS at FROM g3 JOIN twice ON g3.doc_id = twice.doc_id AND g3.g = twice.g) GROUP BY doc_id
), f AS (
  SELECT t.doc_id AS doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN r ON r.doc_id = t.doc_id
), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING MIN(quality) = 1
), h AS (
  SELECT f.* FROM f JOIN good ON good.doc_id = f.doc_id
), g AS (
  SELECT j, {", ".join(f"CAST(c_{r.name} AS DOUBLE) AS c_{r.name}" for r in rules)} FROM (VALUES {steps}) AS v(j, {names})
), c AS (
  SELECT lang, j, COUNT(*) AS n, CAST(SUM(CAST({fails} AS INT)) AS BIGINT) AS k FROM h CROSS JOIN g GROUP BY lang, j
), terms AS (
  SELECT lang, j, n, k, unnest(range(0, k + 1)) AS i FROM c
), tails AS (
  SELECT lang, j, CASE WHEN k >= n THEN 1.0 ELSE SUM(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({max_false!r}) + (n - i) * ln(1 - {max_false!r}))) END AS tail
  FROM terms GROUP BY lang, j, n, k
), passed AS (
  SELECT lang, j, bool_and(tail <= {1 - confidence!r} / (SELECT COUNT(*) FROM (SELECT DISTINCT lang FROM h))) OVER (PARTITION BY lang ORDER BY j) AS ok FROM tails
), valid AS (
  SELECT lang, MAX(j) AS j FROM passed WHERE ok GROUP BY lang
), bad AS (
  SELECT DISTINCT f.doc_id AS doc_id FROM f JOIN valid v ON f.lang IS NOT DISTINCT FROM v.lang JOIN g ON g.j = v.j WHERE {fails}
)
SELECT f.doc_id AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad ON bad.doc_id = f.doc_id
"""


OP10_SQL = _sql()
