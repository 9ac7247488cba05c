"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken x = target / size of the source times. The whole part
of x is certain; the fraction is rounded at random, dependently: two documents that are still
open exchange mass, in words, until one of them is settled, so that the words taken stay equal to
the words wanted throughout. A bucket of a source settles all its documents but one, each against all
smaller ones of the bucket; the open ones are settled in pairs in the next level of a reduction tree,
and so on until each source has one open document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import SPACE_WORD, discard, fresh, materialise, table

#: The weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The documents, and the words, of a bucket, about; its rows are in one task's memory.
BUCKET, BUCKET_WORDS = 10_000, 5_000_000
#: Sources are told to the tasks by broadcast up to this count (about 50 bytes each).
BROADCAST_SOURCES = 100_000
#: Equal rows that are settled as one row with their number, at most, and buckets that meet in one of the next level.
PIECE, FAN = 1_000, 1_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def wanted(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, at_most: float = 3.0) -> DataFrame:
    """Rows source, n (words) to source, source_size and target: all words shared by weight, none above at_most times its own size.

    Sources take the weights in code-point order, null last. They are sorted and numbered in
    partitions, and the share of a unit of weight is found by sums over all sources, one pass for
    each time that it grows: no list of sources is gathered.
    """
    spark = sums.sparkSession
    order = F.col("source").asc_nulls_last()
    parted = materialise(sums.select("source", "n").repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before, rows = 0, []
    for r in parted.groupBy("part").agg(F.count("*").alias("sources")).orderBy("part").collect():  # a row for each partition
        rows.append((r.part, before))
        before += r.sources
    offsets = spark.createDataFrame(rows, "part int, before bigint")
    nr = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (nr % len(weights) + 1).cast("int"))
    known = materialise(parted.join(F.broadcast(offsets), "part").select("source", "n", weight.alias("w"), (F.col("n") * at_most).alias("cap")), "weights")
    discard(parted)
    share, open_ = 0.0, -1
    while True:
        full = F.col("cap") <= share * F.col("w") if open_ >= 0 else F.lit(False)
        r = known.agg(F.sum("n").alias("n"), F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count_if(~full).alias("open")).collect()[0]
        if r.open in (0, open_):
            break
        share, open_ = ((r.n or 0) - (r.caps or 0.0)) / r.w, r.open
    return known.select("source", F.col("n").alias("source_size"), F.least("cap", share * F.col("w")).alias("target"))


def settle(x: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Round fractions in place until at most one is open; sum(size * x) does not change but for that one."""
    tiny = 1e-9
    x[:] = np.where(x < tiny, 0.0, np.where(x > 1 - tiny, 1.0, x))
    draws = rng.random(len(x))
    held = -1
    for i in range(len(x)):
        if not 0.0 < x[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        # words that a may gain from b, and that b may gain from a
        up = min((1 - x[a]) * size[a], x[b] * size[b])
        down = min(x[a] * size[a], (1 - x[b]) * size[b])
        move = up if draws[i] * (up + down) < down else -down
        x[a] += move / size[a]
        x[b] -= move / size[b]
        for j in (a, b):
            if x[j] < tiny or x[j] > 1 - tiny:
                x[j] = round(x[j])
        held = a if 0.0 < x[a] < 1.0 else b if 0.0 < x[b] < 1.0 else -1


def settle_alike(f: float, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round documents that all have the fraction f, sizes descending, until at most one is open.

    Each document is paired with all smaller ones as one: mass goes from it to them, spread by size, or
    back, until it is settled or they are. They keep a common fraction, so that the largest documents
    are settled first and what stays open is small, unless one document outweighs all the others.
    """
    x, left = np.zeros(len(size)), float(size.sum())
    for k in range(len(size)):
        if f < 1e-9 or f > 1 - 1e-9:
            x[k:] = round(f)
            return x
        rest = left - size[k]
        if rest < 0.5:  # sizes are whole
            x[k] = f
            return x
        up, down = min((1 - f) * size[k], f * rest), min(f * size[k], (1 - f) * rest)
        move = up if draws[k] * (up + down) < down else -down
        x[k] = f + move / size[k]
        f = min(1.0, max(0.0, f - move / rest))
        if x[k] < 1e-9 or x[k] > 1 - 1e-9:
            x[k] = round(x[k])
        left = rest
    return x


def _level(seed: int, level: int):
    def run(rows: pa.Table) -> pa.Table:
        column = lambda c: rows[c].to_numpy()
        rows = rows.take(pa.array(np.lexsort((column("__piece"), column("__tie"), -column("size")))))
        key = [seed, level, *(int(column(c)[0]) & 0xFFFFFFFFFFFFFFFF for c in ("__bucket", "__source"))]
        nr = np.repeat(np.arange(len(rows)), column("__n"))  # equal rows come as one, with their number
        x, size, rng = column("__x")[nr].astype(float), column("size")[nr].astype(float), np.random.default_rng(key)
        if level:
            settle(x, size, rng)
        else:  # all documents of a source start with one fraction; empty ones, which come last, with none
            some = int((size > 0).sum())
            x[:some] = settle_alike(float(x[0]), size[:some], rng.random(some))
        kind = np.where(x <= 0, 0, np.where(x >= 1, 1, 2))
        kinds, first, count = np.unique(nr * 3 + kind, return_index=True, return_counts=True)
        out = rows.take(pa.array(kinds // 3))
        out = out.set_column(out.column_names.index("__x"), "__x", pa.array(x[first]))
        return out.set_column(out.column_names.index("__n"), "__n", pa.array(count.astype(np.int64)))

    return run


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, at_most: float = 3.0, seed: int = 7, bucket: int = BUCKET, size: str | None = None) -> DataFrame:
    """The input's columns with size, source_size, target, copies and taken (= copies * size).

    ``size`` names a column with sizes that are known already; the texts may then be left out.

    Sources may be null (one source, the last). A null or empty text has size 0 and is not taken.
    The mean of a document's copies is target / source_size exactly, at every size of a source, and the
    words taken of a source miss its target by less than the size of one document. Equal rows are
    settled each by itself; as they are interchangeable, reruns give the same rows. They come as one
    row with their number, in pieces, so that no bucket is larger for them. Input columns of the added
    names are replaced; all columns must be of types that can be grouped by. An empty table gives an
    empty result.
    """
    docs = docs.withColumn("__size", F.col(size).cast("bigint") if size else words_in("text"))
    docs = fresh(docs, *ADDED)
    keep = [c for c in docs.columns if c != "__size"]
    sized = docs.withColumnRenamed("__size", "size")
    tie = F.xxhash64(*[F.col(c) for c in keep])
    equal = materialise(sized.groupBy(*keep, "size").agg(F.count("*").alias("__n")).withColumn("__tie", tie), "equal-rows")
    sums = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("__n")).alias("n"), F.sum("__n").alias("docs"))
    sums = materialise(sums, "sums")
    buckets = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("docs") / bucket, F.col("n") / BUCKET_WORDS))).cast("int")
    known = wanted(sums, weights, at_most).join(sums.select(F.col("source").alias("__s"), buckets.alias("__buckets")), F.col("source").eqNullSafe(F.col("__s")))
    known = materialise(known.select(F.col("source").alias("__s"), "source_size", "target", "__buckets"), "wanted")
    facts = known.agg(F.count("*").alias("sources"), F.max("__buckets").alias("most")).collect()[0]
    known = F.broadcast(known) if facts.sources <= BROADCAST_SOURCES else known
    rows = equal.join(known, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__mean", F.when(F.col("size") > 0, x).otherwise(F.lit(0.0)))
    rows = rows.withColumn("__whole", F.floor(F.col("__mean") + 1e-9)).withColumn("__x", F.greatest(F.col("__mean") - F.col("__whole"), F.lit(0.0))).drop("__mean")
    rows = rows.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / PIECE))))
    rows = rows.withColumn("__n", F.least(F.col("__n") - F.col("__piece") * PIECE, F.lit(PIECE)).cast("bigint"))
    rows = rows.withColumn("__source", F.xxhash64("source")).withColumn("__bucket", F.pmod(F.xxhash64("__tie", "__piece"), "__buckets")).drop("__buckets")
    level, biggest, done = 0, facts.most or 1, None
    while True:
        settled = rows.groupBy("__source", "__bucket").applyInArrow(_level(seed, level), rows.schema)
        settled = materialise(settled, f"mix{level}")
        open_ = settled.where("__x > 0 AND __x < 1")
        closed = settled.where("NOT (__x > 0 AND __x < 1)")
        done = closed if done is None else done.unionByName(closed)
        if biggest <= 1:  # one bucket for each source: what is still open is the last document of its source
            coin = F.pmod(F.xxhash64(F.lit(seed), "__source", "__tie"), F.lit(1 << 30)) / float(1 << 30)
            done = done.unionByName(open_.withColumn("__x", (coin < F.col("__x")).cast("double")))
            break
        rows = open_.withColumn("__bucket", F.floor(F.col("__bucket") / FAN))
        biggest, level = -(-biggest // FAN), level + 1
    copies = (F.col("__whole") + F.round("__x")).cast("bigint")
    done = done.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    return done.select(*keep, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in("text").alias("size"))
    return mix(docs, size="size").select("doc_id", "size", "source_size", "target", "taken")
