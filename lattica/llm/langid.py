"""Language identification, words first.

A word that the model knows scores by its log frequency in each language. A word that it does not
know is covered by character n-grams: at each place the longest known n-gram is taken (of the word
with its ends marked), falling back to shorter ones, and the n-grams' scores are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import KEEP, discard, extended, fresh, held_out, lean, materialise, table

UND = "und"
#: Training texts of each language, about: all of a smaller language, an even sample by id of a larger one.
SAMPLE_DOCS = 2_000
#: The most frequent words, and n-grams of each length, that the model keeps of each language.
KEEP_WORDS, KEEP_GRAMS = 20_000, 8_000
MAX_GRAM = 4
#: Facts of each language are broadcast up to this many languages (some 30 bytes each).
BROADCAST_LANGS = 10_000
#: Texts of which the model is less sure are rejected in pipelines; few clean texts come near it.
MIN_SCORE = 0.3

#: Scores of unseen words that are kept, over all languages, and the words' letters at most; longer ones are scored anew.
_CACHE, _CACHED = 800_000, 64


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    if text.isalpha():
        return [text.lower()]
    return "".join([c if c.isalpha() else " " for c in text.lower()]).split() if not text.isascii() else text.lower().translate(_ASCII).split()


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in range(1, MAX_GRAM + 1) for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Known words and n-grams with rows of scores. A row holds only the languages that have its key: ``starts``
    are the rows' starts in ``lang`` and ``gain``; other languages score ``floor`` of the row's kind (0: word, else the n-gram's length)."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    starts: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    def __post_init__(self) -> None:
        self.cache: dict[str, np.ndarray] = {}
        self.room = _CACHE // max(1, len(self.langs))

    def row(self, row: int, kind: int) -> np.ndarray:
        out = self.floor[kind].copy()
        a, b = self.starts[row], self.starts[row + 1]
        out[self.lang[a:b]] += self.gain[a:b]
        return out

    def known(self, rows: np.ndarray) -> np.ndarray:
        """The summed scores of known words."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows + 1] - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.lang[at], weights=self.gain[at], minlength=len(self.langs)) + len(rows) * self.floor[0]

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word that is not known, by the longest n-grams that are; a bounded cache keeps it."""
        found = self.cache.get(word)
        if found is None:
            w, at, found = f"^{word}$", 0, np.zeros(len(self.langs))
            while at < len(w):
                for n in range(min(MAX_GRAM, len(w) - at), 0, -1):
                    row = self.grams.get(w[at : at + n])
                    if row is not None:
                        found += self.row(row, n)
                        break
                else:
                    n = 1  # a letter that no language has tells nothing
                at += n
            found = found / (len(w) / 2)  # as much as a known word, not as its many pieces
            if len(word) <= _CACHED:
                if len(self.cache) >= self.room:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the belief, 0 to 1. Equal beliefs: the first language in code-point order."""
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UND, 0.0
        get = self.words.get
        rows = [get(w, -1) for w in words]
        ids = np.array(rows)
        total = self.known(ids[ids >= 0])
        if (ids < 0).any():
            for w, r in zip(words, rows):
                if r < 0:
                    total += self.unseen(w)
        z = total / np.sqrt(len(words))
        z = np.exp(z - z.max())
        best = int(z.argmax())
        return self.langs[best], float(z[best] / z.sum())


def build(langs: list[str], top: list[tuple[str, int, str, int]], sums: dict[tuple[str, int], int]) -> Model:
    """A model of the kept keys (lang, kind, key, n) and all counts of each (lang, kind): log((n + 1/2) / (all + 1)), n is 0 for languages that haven't kept the key."""
    at = {x: i for i, x in enumerate(langs)}
    top = sorted((k, x, at[g], n) for g, k, x, n in top)
    floor = np.log(0.5 / (np.array([[sums.get((x, k), 0) for x in langs] for k in range(MAX_GRAM + 1)], float) + 1.0))
    words: dict[str, int] = {}
    grams: dict[str, int] = {}
    starts: list[int] = []
    before = None
    for i, (kind, x, _, _) in enumerate(top):
        if (kind, x) != before:
            before = (kind, x)
            (grams if kind else words)[x] = len(starts)
            starts.append(i)
    return Model(langs, words, grams, np.array([*starts, len(top)], np.int64), np.array([i for _, _, i, _ in top], np.int32), np.log(2 * np.array([n for *_, n in top], float) + 1).astype(np.float32), floor)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from doc_id, text and lang (rows without a lang or an id are left out).

    Fitted on a bounded sample: about ``sample_docs`` whole texts of each language, chosen by the
    hash of the id, so that reruns agree. Counting is done in Spark; what is gathered is bounded by
    KEEP_WORDS and KEEP_GRAMS for each language: the most frequent keys, equal counts in the order of
    a hash of the key. Null texts have no words. Repeated rows count as often as they stand. An empty
    table gives a model that knows no language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return build([], [], {})
    spark = docs.sparkSession
    rates = spark.createDataFrame([(x, min(1.0, sample_docs / n)) for x, n in sizes.items()], "lang string, rate double")
    even = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rates = F.broadcast(rates) if len(langs) <= BROADCAST_LANGS else rates  # else every text would be shuffled
    sample = labelled.join(rates, "lang").where(even < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                n: dict[str, int] = {}
                for t in texts:
                    for w in words_of(t or ""):
                        n[w] = n.get(w, 0) + 1
                g: dict[str, int] = {}
                for w, c in n.items():
                    for x in grams_of(w):
                        g[x] = g.get(x, 0) + c
                rows = [(lang, 0, w, c) for w, c in n.items()] + [(lang, len(x), x, c) for x, c in g.items()]
                if rows:
                    yield pd.DataFrame(rows, columns=["lang", "kind", "key", "n"])

    counted = sample.mapInPandas(lean(count), "lang string, kind int, key string, n bigint")
    counts = materialise(counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "lang-counts")  # read four times
    # the least count of which all keys have room, by a histogram of counts; the keys of the next one fill what is left
    held = counts.groupBy("lang", "kind", "n").agg(F.count("*").alias("keys")).groupBy("lang", "kind").agg(F.sort_array(F.collect_list(F.struct("n", "keys")), False).alias("h"), F.sum(F.col("n") * F.col("keys")).alias("total")).collect()
    least = []
    for r in held:
        room, cut, last = KEEP_GRAMS if r.kind else KEEP_WORDS, 1 << 62, 0
        for h in r.h:
            if h["keys"] > room:
                last = h.n
                break
            room -= h["keys"]
            cut = h.n
        least.append((r.lang, r.kind, cut, last, room))
    sums = {(r.lang, r.kind): r.total for r in held}
    cuts = spark.createDataFrame(least, "lang string, kind int, least bigint, last bigint, room int")
    cuts = F.broadcast(cuts) if len(langs) <= BROADCAST_LANGS else cuts
    marked = counts.join(cuts, ["lang", "kind"])
    # equal counts of one language: at most the different keys of the bounded sample, sorted with spilling
    nr = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.xxhash64("key"), "key"))
    ties = marked.where("n = last AND room > 0").withColumn("nr", nr).where("nr <= room")
    columns = ["lang", "kind", "key", "n"]
    top = marked.where("n >= least").select(*columns).unionByName(ties.select(*columns)).collect()
    discard(counts)
    return build(langs, [tuple(r) for r in top], sums)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The input's columns with lang_pred and score (0 to 1); only the text is looked at.

    A null text, and one without a letter, is ``und`` with score 0. Runs of letters count whole,
    however long (a text without spaces is one run). Equal rows get equal results; equal beliefs go to
    the first language in code-point order. Input columns named lang_pred or score are replaced. An
    empty table gives an empty result.
    """
    docs = fresh(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most KEEP_WORDS + MAX_GRAM * KEEP_GRAMS entries a language

    def start():
        model = shared.value

        def work(texts: list[str | None]) -> dict[str, list]:
            found = [model.predict(t) for t in texts]
            return {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return work

    return extended(docs, ["text"], start, "lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows, with their own columns, whose language is told with at least min_score; null texts and those without a letter go."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(texts: list[str | None]) -> dict[str, list]:
            found = [model.predict(t) for t in texts]
            return {KEEP: [x != UND and s >= min_score for x, s in found]}

        return work

    return extended(docs, ["text"], start, "").select(*names)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
