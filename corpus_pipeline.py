"""From raw documents to a training mixture: each stage works on all that the one before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import decontaminate, jaccard, langid, mixing, surrogates
from lattica.llm.common import fresh, held_out, materialise, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the labelled ones that are not held out.

    Null texts and texts without a letter go. Equal rows go or stay together; an empty table stays empty.
    """
    labelled = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), 4))
    return langid.keep_identified(docs, langid.train(labelled))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five words, a similarity of 0.8.

    The one with the smallest doc_id stays, of several texts with that id one. Rows without an id stay,
    texts without words are near nothing. An empty table stays empty.
    """
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; texts that are little else go.

    Null and empty texts, and those without such a passage, stay as they are; equal rows are cut alike. An empty table stays empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates, of which the corpus has been checked to hold no two alike.

    Null and empty texts stay as they are; equal rows get equal texts. An empty table stays empty.
    """
    found = surrogates.checked(docs, surrogates.key_of(spark))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, and how often each is taken so that the sources have their weights.

    Texts are large: narrow rows are settled, and what came out is joined to the texts once. Equal rows
    share a key; each takes one of the results of their key. Null texts have no words and are not taken.
    Columns named as the added ones are replaced; an empty table gives an empty result.
    """
    docs = fresh(docs, *mixing.ADDED)
    keyed = docs.withColumn("__row", F.xxhash64(*docs.columns))
    narrow = materialise(keyed.select("__row", "source", mixing.words_in("text").alias("size")), "sizes")  # read twice
    settled = mixing.mix(narrow, size="size").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("copies", *(c for c in mixing.ADDED if c != "copies")))).alias("__all"))
    nr = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    joined = keyed.join(settled, "__row").withColumn("__one", F.element_at("__all", nr))
    return joined.select(*docs.columns, *(F.col(f"__one.{c}").alias(c) for c in mixing.ADDED))


STAGES = [
    ("language", identified),
    ("near copies", deduplicated),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]

#: Similarity of pairs, a trained model and random rounding cannot be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with their texts; between two stages the rows are written to the shared folder and read again.

    Null, empty, equal and clashing rows fare as each stage says; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
