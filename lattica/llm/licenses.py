"""Licence scans by diagonal voting.

All rolling word k-grams of the texts are joined to the places of the same k-grams in licence
templates. A hit votes for its diagonal (place in the text minus place in the template); the
votes are aggregated by diagonal, and neighbouring diagonals are merged, so that a few words put in
or left out do not break a match. A merged span whose votes cover enough of its template is verified:
its hits are put in the order of the text, the longest run that ascends in the template as well is
kept, and within a stretch of the text not much longer than the template that run must cover enough.
Equal 64-bit hashes of words are taken as equal words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import license_texts
from lattica.llm.common import ALNUM_WORD, fresh, table

K = 3
#: The hash of the K words from place {1} on, of their hashes {0}; 64 bits, so that equal hashes are equal words.
_GRAM = "xxhash64(" + ", ".join(f"{{0}}[{{1}} + {k}]" for k in range(K)) + ")"


@dataclass(frozen=True)
class Template:
    """exact: each word in a row, as one place (a base phrase); else cover: the share of its words that a span needs."""

    label: str
    words: str
    exact: bool = False
    cover: float = 1.0


BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

#: Notices and whole texts differ in a few words; their names don't.
TEMPLATES = tuple(Template(label, words, cover=0.8) for label, words in license_texts.TEXTS) + tuple(Template(label, words) for label, words in license_texts.NAMES)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A verified span is at most so many times as long as its template.
STRETCH = 1.25


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def verified(hits: list[tuple[int, int]], length: int) -> tuple[float, int, int]:
    """The share of a template's words that an ascending run of hits (place, at) covers in one stretch, and the stretch's first and last word.

    The run is a longest one with both numbers strictly ascending. Ties: the earliest stretch.
    """
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))  # of one place, only one hit can be in a run
    for i, (_, at) in enumerate(hits):
        k = bisect_left(tails, at)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(at)
            ends.append(i)
        else:
            tails[k], ends[k] = at, i
    run, i = [], ends[-1] if ends else -1
    while i >= 0:
        run.append(hits[i])
        i = back[i]
    run.reverse()
    best, first, low, covered = (0, 0, 0), 0, 0, 0
    gains = [K if i == 0 else min(K, at - run[i - 1][1]) for i, (_, at) in enumerate(run)]
    for last, (place, _) in enumerate(run):
        covered += gains[last]
        while place + K - run[first][0] > STRETCH * length + K:
            covered -= gains[first]
            first += 1
            covered += K - gains[first]
            gains[first] = K
        if covered > best[0]:
            best = (covered, run[first][0], place + K - 1)
    return best[0] / length, best[1], best[2]


def _verified_share(spans: pd.Series, lengths: pd.Series) -> pd.Series:
    return pd.Series([verified([(int(d["diagonal"]) + int(at), int(at)) for d in span for at in d["votes"]], int(n))[0] for span, n in zip(spans, lengths)], dtype=float)


_ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES, gap: int = 3) -> DataFrame:
    """Per row: the input's columns but the text, and n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template's words that one merged span votes for. Null and empty
    texts have no words, empty labels and score 0. Rows are told apart by doc_id and text; equal rows
    have equal results, and a null doc_id is an id like any other. Texts of under k words match
    nothing; long ones are taken whole. Input columns of the added names are replaced. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    docs = fresh(docs, *_ADDED)
    every = (*base, *templates)
    grams = []
    for i, t in enumerate(every):
        words = words_of(t.words)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {t.words!r}")
        grams += [(words[p : p + K], i, p) for p in range(len(words) - K + 1)]
    index = spark.createDataFrame(grams, "w array<string>, template int, at int")  # a row for each word of the templates
    index = index.select(F.expr(_GRAM.format("transform(w, x -> xxhash64(x))", 0)).alias("hash"), "template", "at")

    keyed = docs.withColumn("__th", F.xxhash64("text"))
    # lower() also turns the Kelvin sign into k; no other letter outside ASCII becomes one within
    low = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    words = keyed.select("doc_id", "__th", F.regexp_extract_all(low, F.lit(ALNUM_WORD), 0).alias("w")).where(F.size("w") >= K)
    words = words.select("doc_id", "__th", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    rows = words.select("doc_id", "__th", F.posexplode(F.expr(f"transform(sequence(0, size(h) - {K}), i -> {_GRAM.format('h', 'i')})")).alias("place", "gram"))
    hits = rows.join(F.broadcast(index), F.col("gram") == F.col("hash"))
    votes = hits.groupBy("doc_id", "__th", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("votes"))

    by_span = Window.partitionBy("doc_id", "__th", "template").orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal").over(by_span) > gap).cast("int")
    facts = spark.createDataFrame([(i, t.label, len(words_of(t.words)), t.exact, float(t.cover)) for i, t in enumerate(every)], "template int, label string, length int, exact boolean, cover double")
    spans = votes.withColumn("span", F.sum(F.coalesce(starts, F.lit(0))).over(by_span)).join(F.broadcast(facts), "template")
    whole = F.col("exact") & (F.size("votes") == F.col("length") - (K - 1))
    merged = spans.groupBy("doc_id", "__th", "template", "label", "length", "exact", "cover", "span").agg(
        F.when(~F.first("exact"), F.collect_list(F.struct("diagonal", "votes"))).alias("diagonals"),
        F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"),
        F.sum(whole.cast("bigint")).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda p: F.sequence(p, p + (K - 1))))))
    merged = merged.withColumn("share", covered / F.col("length")).drop("votes")
    asked = ~F.col("exact") & (F.col("share") >= F.col("cover"))
    checked = merged.where(asked).withColumn("real", F.pandas_udf(_verified_share, "double")("diagonals", "length"))
    merged = merged.where(~asked).withColumn("real", F.lit(0.0)).unionByName(checked).drop("diagonals")
    base_hit, own_hit = F.col("exact") & (F.col("places") > 0), ~F.col("exact") & (F.col("real") >= F.col("cover"))
    found = merged.groupBy("doc_id", "__th").agg(
        F.sum(F.when(F.col("exact"), F.col("places")).otherwise(0)).alias("n_base"),
        F.min("first").cast("bigint").alias("first_word"),
        F.max("last").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base_hit, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(base_hit | own_hit, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    count = F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORD)), F.lit(0)).cast("bigint")
    left = keyed.withColumn("n_words", count).drop("text").alias("l")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.__th").eqNullSafe(F.col("r.__th"))
    keep = [F.col(f"l.`{c}`") for c in docs.columns if c != "text"]
    return left.join(found.alias("r"), on, "left").select(
        *keep, "l.n_words", F.coalesce("r.n_base", F.lit(0)).cast("bigint").alias("n_base"), "r.first_word", "r.last_word",
        F.coalesce("r.base_labels", F.lit("")).alias("base_labels"), F.coalesce("r.labels", F.lit("")).alias("labels"), F.coalesce("r.score", F.lit(0.0)).alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *_ADDED)
