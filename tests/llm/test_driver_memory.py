"""What the driver's Python holds at a time."""

import tracemalloc

import numpy as np

from lattica.llm import jaccard


def test_the_table_of_counts_is_held_in_two_bytes_a_slot(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, 400)) for _ in range(40)]
    slots = 1 << 22
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    jaccard._rarity(docs, 3, slots)  # what is loaded once
    tracemalloc.start()
    found = jaccard._rarity(docs, 3, slots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(slots, np.int64)
    for g in jaccard.gram_sets(texts, 3):
        np.add.at(want, (g >> np.uint64(64 - 22)).astype(np.intp), 1)
    assert found.dtype == np.uint16 and np.array_equal(found, want)
    assert peak < 4 * slots
