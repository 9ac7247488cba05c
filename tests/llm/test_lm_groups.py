"""What op8's groups of texts hold and get, beyond the tables of contexts."""

import random

from pyspark.sql import functions as F

from lattica.llm import lm


def texts_of_two_kinds(spark, n):
    rng, rows = random.Random(5), []
    for i in range(n):
        letters = "abcdefghij" if i % 2 else "nopqrstuvw"
        syllables = [a + b for a in letters[:5] for b in letters[5:]]
        rows.append((i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(300))))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_groups_get_few_bytes(spark, monkeypatch):
    """Small groups of texts get less than one and a half times the size of the texts, and every text has its score."""
    monkeypatch.setattr(lm, "MAX_BITS", 11)
    monkeypatch.setattr(lm, "GROUP", 60_000)
    monkeypatch.setattr(lm, "PART", 60_000)
    seen, ask = [], lm.ask
    monkeypatch.setattr(lm, "ask", lambda *args: seen.append(ask(*args)) or seen[-1])
    docs = texts_of_two_kinds(spark, 300)
    scored = lm.score(docs, F.col("doc_id") % 7 != 2)
    assert scored.count() == 300 and scored.where("score >= 0").count() == 0
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    got = seen[0].where("chunk >= 0").agg(F.sum(F.length("values"))).first()[0]
    assert got < 1.5 * size


def test_kinds_of_texts_meet(spark):
    """Texts of one kind are packed together, every row once, whatever its text."""
    docs = texts_of_two_kinds(spark, 60).unionByName(spark.createDataFrame([(100, None), (101, ""), (102, "é" * 3000), (103, "ab")], "doc_id bigint, text string"))
    docs = docs.withColumn("__learn", F.lit(True)).withColumn("__deal", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    texts = [r.text for r in docs.where("text <> ''").collect()]
    kinds = lm.kinds_of(texts, 3)
    groups = lm.np.array([2] * len(kinds))
    packed = lm.pack(docs, kinds, groups).collect()
    found = {}
    for r in packed:
        for row in lm._opened(bytes(r.held)).to_pylist():
            assert row["doc_id"] not in found
            found[row["doc_id"]] = (r.chunk // 2, row["text"])
    assert {i: t for i, (_, t) in found.items()} == {r.doc_id: r.text for r in docs.collect()}
    odd, even = ({found[i][0] for i in range(first, 60, 2)} for first in (1, 0))
    assert len(odd) == len(even) == 1 and odd != even
    assert {r.chunk < 0 for r in lm.pack(docs, kinds, groups, learned=True).collect()} == {True}
