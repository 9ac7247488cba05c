"""Licences, decontamination, quality, language, mixing and the language model against plain Python."""

import collections
import functools
import hashlib
import math
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, langid, licenses, lm, mixing, quality, tokens
from lattica.llm.common import materialise

LOW = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOW))


def key(row):
    return (None if pd.isna(row.doc_id) else int(row.doc_id), row.text)


def collected(df):
    return [r.asDict() for r in df.collect()]


# ---- licences


def test_licences(table, docs):
    extra = {7001: "x Released under the MIT License. y", 7002: "apache license, version 2 apache license version 2", 7003: "CC BY-NC cc by nc", 7004: "GNU General Public License version 2", 7005: "under the mit", 7006: "under the mİt license under the mit licenKe"}
    more = table.sparkSession.createDataFrame([(k, v, None, None, 0) for k, v in extra.items()], table.schema)
    got = {(r.doc_id, r.h): r for r in licenses.scan(table.unionByName(more).withColumn("h", F.xxhash64("text"))).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in table.unionByName(more).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    every = [(None if pd.isna(d) else int(d), t) for d, t in zip(docs.doc_id, docs.text)] + list(extra.items())
    for doc, text in every:
        text = None if text is None or text is pd.NA else text
        w, starts, found = words(text), [], set()
        for t in licenses.BASE:
            p = t.words.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += at
            found |= {t.label} if at else set()
        r = got[doc, hashes[doc, text]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))), text
        assert found <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got.values()}
    assert by_id[7004].labels == "gpl-2" and by_id[7005].labels == "" and by_id[7001].labels == "mit"


def brute_labels(text):
    """Labels of the method in plain Python: diagonals, chains of neighbours, the best ascending run by comparing all pairs of hits."""
    w, found = words(text), set()
    for t in licenses.TEMPLATES:
        p = licenses.words_of(t.words)
        places = collections.defaultdict(list)
        for at in range(len(p) - 2):
            places[tuple(p[at : at + 3])].append(at)
        diagonals = collections.defaultdict(set)
        for i in range(len(w) - 2):
            for at in places.get(tuple(w[i : i + 3]), ()):
                diagonals[i - at].add(at)
        spans = []
        for d in sorted(diagonals):
            if not spans or d - spans[-1][-1] > 3:
                spans.append([])
            spans[-1].append(d)
        for span in spans:
            hits = sorted(((d + at, at) for d in span for at in diagonals[d]), key=lambda h: (h[0], -h[1]))
            best = []
            for place, at in hits:  # a longest ascending run that ends here
                best.append(max((b for b, h in zip(best, hits) if h[0] < place and h[1] < at), key=len, default=[]) + [(place, at)])
            run = max(best, key=len)
            share = max(len({a + k for _, a in run[i:j] for k in range(3)}) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if run[j - 1][0] + 3 - run[i][0] <= 1.25 * len(p) + 3) / len(p)
            if share >= t.cover:
                found.add(t.label)
    return found


def test_licence_spans_with_changes(spark):
    """Whole texts with changed words are found; their pieces in another order, and far apart, are not."""
    import random

    rng, rows = random.Random(5), []
    for k, t in enumerate(licenses.TEMPLATES):
        w = t.words.split()
        edited = [rng.choice(("changed", x + " oddly put")) if rng.random() < 0.03 else x for x in w]
        pieces = [w[i : i + 5] for i in range(0, len(w), 5)]
        rng.shuffle(pieces)
        rows += [(3 * k, "some words " + " ".join(edited) + " and more"), (3 * k + 1, " ".join(sum(pieces, []))), (3 * k + 2, " ".join(" ".join(x) + " far apart" * 30 for x in pieces))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    brute = {k: brute_labels(t) for k, t in rows}
    own = {k: {t.label for t in licenses.BASE if re.search(rf"\b{t.words}\b", " ".join(words(x)))} for k, x in rows}
    assert got == {k: ",".join(sorted(brute[k] | own[k])) for k, _ in rows}
    assert all(t.label in got[3 * k] for k, t in enumerate(licenses.TEMPLATES) if t.cover < 1) and got[7] == "" and got[2] == ""


def test_verified_runs():
    assert licenses.verified([(10 + i, i) for i in range(8)], 10) == (1.0, 10, 19)
    assert licenses.verified([(i, 7 - i) for i in range(8)], 10)[0] == 0.3
    assert licenses.verified([], 10)[0] == 0 and licenses.verified([(0, 0), (500, 7)], 10)[0] == 0.3


def test_licence_edges(empty, clashing):
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(clashing).columns.count("score") == 1 and licenses.scan(clashing).count() == clashing.count()


# ---- decontamination


def brute_overlap(text, items, n):
    windows = collections.defaultdict(set)
    for name, item in items:
        w = words(item)
        if w:
            for k in range(max(1, len(w) - n + 1)):
                windows[tuple(w[k : k + n])].add(str(name))
    w, hit, names = words(text), set(), set()
    for size in {len(k) for k in windows}:
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                names |= windows[tuple(w[k : k + size])]
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def items_of(spark, sf_dir):
    extra = [(901, "same words here"), (902, "x"), (903, None), (904, " "), (905, "again and again"), (None, "some words")]
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame(extra, "item_id bigint, text string"))


@pytest.mark.parametrize("block", [200_000, 500])
def test_overlap(spark, sf_dir, table, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", block)
    items = items_of(spark, sf_dir)
    known = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    got = sorted((str(r.doc_id), r.text or "", r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_overlap(table, items).collect())
    want = sorted((str(None if pd.isna(d) else int(d)), t or "", *brute_overlap(t, known, 10)) for d, t in zip(docs.doc_id, docs.text.where(docs.text.notna(), None)))
    assert got == want


def test_automaton_on_random_words():
    import random

    rng = random.Random(1)
    for _ in range(200):
        items = [(str(k), [rng.choice("abc").encode() for _ in range(rng.randint(0, 12))]) for k in range(rng.randint(1, 4))]
        text = [rng.choice("abcd").encode() for _ in range(60)]
        n = rng.randint(1, 6)
        spans, names = decontaminate.Automaton(items, n).spans(text)
        got = brute_overlap(b" ".join(text).decode(), [(k, b" ".join(w).decode()) for k, w in items], n)
        assert (sum(b - a for a, b in spans), len(names)) == got[1:3]


def test_cutting(spark):
    text = "Keep this. " + "one two three four five six seven eight nine ten, " + "and this"
    docs = spark.createDataFrame([(1, text, 5), (2, "one two three four five six seven eight nine ten", 5), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: "Keep this. , and this", 3: None}


def test_overlap_edges(empty, clashing, spark, sf_dir):
    items = items_of(spark, sf_dir)
    assert decontaminate.find_overlap(empty, items).count() == 0
    assert decontaminate.find_overlap(clashing, items.where("false")).where("contaminated").count() == 0


# ---- quality


def brute_features(text):
    w = words(text, SPACED)
    seen = collections.defaultdict(list)
    for k in range(len(w) - 2):
        # windows compare words as they stand, not lower-cased
        seen[tuple(SPACED.findall(text)[k : k + 3])].append(k)
    repeated = {p + d for v in seen.values() if len(v) > 1 for p in v for d in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_features(table):
    rows = quality.text_features(table.where("doc_id IS NULL OR doc_id <> 9008")).collect()
    assert rows and all(tuple(r[f] for f in quality.FEATURES) == brute_features(r.text) for r in rows)
    long = quality.text_features(table.where("doc_id = 9008")).collect()[0]
    assert (long.n_words, long.n_repeat_words) == (30_000, 30_000)


def test_binomial_bounds():
    for n, k, p in ((50, 3, 0.1), (400, 0, 0.01), (1000, 30, 0.05), (7, 7, 0.3), (20, 19, 0.9)):
        assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_the_path_tightens():
    steps = quality.path(quality.RULES)
    assert steps[-1] == {r.name: r.grid[-1] for r in quality.RULES} and len(steps) == sum(len(r.grid) for r in quality.RULES)
    for r in quality.RULES:
        seen = [step[r.name] for step in steps if r.name in step]
        assert seen == sorted(seen, reverse=r.upper)


def test_cutoffs_keep_their_promise(spark):
    """Bad texts have many symbols; the cutoffs found turn them away and at most the allowed share of good ones. The chosen step is that of a plain walk along the path."""
    rows = [(k, ("good words " * 40) + "#" * (k % 4 + 12 * (k % 101 == 0)) if k % 3 else "###% " * 60, ("xx", "yy")[k % 2]) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(6000)], "doc_id bigint, quality int")
    rules = (quality.RULES[0], quality.RULES[4])
    feats = materialise(quality.text_features(docs), "features")  # as judge_quality does: else each count would work them out anew
    cutoffs = quality.learn_cutoffs(feats, labels, "lang", 0.02, 0.95, rules)
    for lang in ("xx", "yy"):
        good = [(x.n_symbols / max(1, x.n_words), x.word_chars / max(1, x.n_words)) for x in feats.where(f"lang = '{lang}' AND doc_id % 3 > 0").collect()]
        want = None
        for step in quality.path(rules):
            bad = sum(a > step["symbols"] or b > step.get("long_words", 1e9) for a, b in good)
            if sum(math.comb(len(good), i) * 0.02**i * 0.98 ** (len(good) - i) for i in range(bad + 1)) > 0.025:
                break
            want = step
        assert cutoffs[lang] == want
    judged = quality.apply_cutoffs(feats, cutoffs, "lang", rules).join(labels, "doc_id")
    assert cutoffs["xx"]["symbols"] <= 0.25 and judged.where("quality = 0 AND kept").count() == 0
    few = quality.learn_cutoffs(feats, labels.limit(20), "lang", 0.02, 0.95, rules)
    assert not few  # too few labels promise nothing


def test_quality_edges(clashing, empty, spark):
    labels = spark.createDataFrame([(9006, 1), (9006, 0), (None, 1)], "doc_id bigint, quality int")
    got = quality.judge_quality(clashing, labels)
    assert got.count() == clashing.count() and got.where("kept IS NULL").count() == 0
    assert quality.judge_quality(empty, labels.where("false")).count() == 0


# ---- language


def test_language(spark, table):
    held = table.withColumn("held", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = langid.train(held.where("NOT held"))
    got = langid.identify(held, model).collect()
    real = [r for r in got if r.held and r.lang and r.doc_id < 9000]
    assert sum(r.lang == r.lang_pred for r in real) / len(real) > 0.97
    for r in got:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) and 0 <= r.score <= 1
    kept = langid.keep_identified(table, model)
    assert kept.columns == table.columns and kept.where("doc_id IN (9001, 9002, 9003, 9004)").count() == 0
    assert kept.where("doc_id < 9000").count() >= 0.97 * table.where("doc_id < 9000").count()


def small_model(words, grams, langs=("a", "b")):
    """Keys with their scores by language."""
    import numpy as np

    rows = [*words.values(), *grams.values()]
    lang = [i for r in rows for i, x in enumerate(r) if x]
    starts = np.cumsum([0, *(sum(x != 0 for x in r) for r in rows)])
    gain = np.array([x for r in rows for x in r if x], np.float32)
    return langid.Model(list(langs), {w: i for i, w in enumerate(words)}, {g: len(words) + i for i, g in enumerate(grams)}, starts, np.array(lang, np.int32), gain, np.zeros((langid.MAX_GRAM + 1, len(langs))))


def test_backoff_takes_the_longest_known_gram():
    m = small_model({"the": (1, 0)}, {"^x": (0, 4), "y": (2, 0), "^": (9, 9)})
    assert m.unseen("xyz").tolist() == pytest.approx([2 / 2.5, 4 / 2.5])
    assert m.predict("the")[0] == "a" and m.predict("x")[0] == "b" and m.predict(None) == ("und", 0.0) and m.predict("12 !")[0] == "und"
    assert m.predict("q") == ("a", 0.5)  # equal beliefs


def test_long_runs_of_letters_count_whole(spark):
    m = small_model({}, {"x": (1, 0), "y": (0, 1)})
    run = "x" * 64 + "y" * 10_000
    assert m.predict(run)[0] == "b" and m.unseen(run) == pytest.approx([64 / (10_066 / 2), 10_000 / (10_066 / 2)]) and run not in m.cache
    docs = spark.createDataFrame([(k, "x" * 64 + "qz" * 40, "en") for k in range(3)], "doc_id bigint, text string, lang string")
    assert "qzqz" in langid.train(docs).grams


def test_ties_fill_the_room(spark, monkeypatch):
    monkeypatch.setattr(langid, "KEEP_WORDS", 300)
    monkeypatch.setattr(langid, "KEEP_GRAMS", 50)
    text = "often often " + " ".join("".join(chr(97 + int(c)) for c in f"{k:03d}") for k in range(400))
    model = langid.train(spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string"))
    again = langid.train(spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string").repartition(3))
    assert len(model.words) == 300 and "often" in model.words and set(model.words) == set(again.words)
    assert all(sum(len(g) == n for g in model.grams) <= 50 for n in range(1, 5))


def brute_language(docs, texts):
    """Counts and scores as dictionaries, one language at a time."""
    words_, grams_ = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, t in docs:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words_[lang][w] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    grams_[lang, n][f"^{w}$"[i : i + n]] += 1
    langs = sorted(words_)
    known, kgrams = set().union(*words_.values()), {n: set().union(*(grams_[x, n] for x in langs)) for n in range(1, 5)}

    def score(lang, t):
        total, ws = 0.0, re.findall(r"[^\W\d_]+", t.lower())
        for w in ws:
            if w in known:
                total += math.log((words_[lang][w] + 0.5) / (sum(words_[lang].values()) + 1))
                continue
            x, at, here = f"^{w}$", 0, 0.0
            while at < len(x):
                n = next((n for n in range(min(4, len(x) - at), 0, -1) if x[at : at + n] in kgrams[n]), 0)
                here += math.log((grams_[lang, n][x[at : at + n]] + 0.5) / (sum(grams_[lang, n].values()) + 1)) if n else 0
                at += n or 1
            total += here / (len(x) / 2)
        return total / math.sqrt(len(ws))

    out = []
    for t in texts:
        z = {x: score(x, t) for x in langs}
        top = max(z.values())
        out.append((max(langs, key=lambda x: z[x]), 1 / sum(math.exp(v - top) for v in z.values())))
    return out


def test_language_against_brute_force(spark, table):
    some = table.where("doc_id < 60 AND text IS NOT NULL AND lang IS NOT NULL")
    rows = some.select("lang", "text").collect()
    texts = [t for (t,) in table.where("doc_id BETWEEN 60 AND 110 AND text RLIKE '[a-z]'").select("text").collect()] + ["zzqx unseen words", "x"]
    model = langid.train(some)
    for got, want in zip(map(model.predict, texts), brute_language([tuple(r) for r in rows], texts)):
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-4)


def test_language_edges(empty, clashing):
    model = langid.train(empty)
    assert model.predict("any words") == ("und", 0.0)
    assert langid.identify(clashing, model).where("lang_pred <> 'und'").count() == 0


# ---- mixing


def brute_targets(sizes, weights, at_most):
    """All words shared by weight; what is above a source's bound is shared anew among the others."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap, left, open_, out = {s: at_most * n for s, n in order}, float(sum(n for _, n in order)), [s for s, _ in order], {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total >= cap[s]]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets(spark):
    import random

    rng = random.Random(3)
    cases = [[("b", 100), (None, 1000), ("a", 10), ("c", 500)], [("x", 0), ("y", 0)], [("only", 7)]]
    cases.append([(f"s{k}", rng.choice((0, 1, 10, 1000, 100_000))) for k in range(60)])
    for sizes in cases:
        got = {r.source: r.target for r in mixing.wanted(spark.createDataFrame(sizes, "source string, n bigint").repartition(3)).collect()}
        assert got == pytest.approx(brute_targets(sizes, mixing.WEIGHTS, 3.0))
    assert mixing.wanted(spark.createDataFrame([], "source string, n bigint")).count() == 0


def test_equal_rows_and_large_ids(spark):
    """Rows that are alike in every column are settled one by one, in pieces; ids beyond 2^53 beside null ones stay."""
    big = 9007199254740993
    rows = [(None, "a", 3)] * 2500 + [(big + k, "a", 5) for k in range(50)] + [(k, "b", 4) for k in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").repartition(3), size="size", bucket=400).collect()
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in got) == collections.Counter(rows)
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5


def test_mixing(table):
    got = mixing.mix(table)
    rows = got.collect()
    assert len(rows) == table.count() and all(r.size == len(words(r.text, SPACED)) and r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.text or "", r.copies) for r in rows) == sorted((str(r.doc_id), r.text or "", r.copies) for r in again)


def test_mixing_by_the_tree(spark, monkeypatch):
    """Many buckets of a hot source meet in a second level."""
    monkeypatch.setattr(mixing, "BUCKET", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), (F.col("id") % 50 + 1).alias("size"))
    got = mixing.mix(docs, size="size", bucket=10).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("copies").alias("c")).collect()
    assert all(abs(r.t - r.w) <= 51 and r.c <= 3 for r in got)


def test_settling_keeps_the_mean():
    import numpy as np

    size, hits = np.array([5.0, 3, 9, 2, 7]), np.zeros(5)
    for k in range(3000):
        x = np.full(5, 0.3)
        mixing.settle(x, size, np.random.default_rng(k))
        assert abs((x * size).sum() - 0.3 * size.sum()) < 1e-6 and ((x > 0) & (x < 1)).sum() <= 1
        hits += x
    assert np.abs(hits / 3000 - 0.3).max() < 0.04


@pytest.mark.parametrize("f, size", [(0.3, [20, 9, 7, 3, 2, 1, 1]), (0.8, [50, 2, 1]), (0.5, [4]), (0.4, [1] * 9)])
def test_settling_against_the_smaller_keeps_the_mean(f, size):
    import numpy as np

    size, hits = np.array(size, float), np.zeros(len(size))
    for k in range(4000):
        x = mixing.settle_alike(f, size, np.random.default_rng(k).random(len(size)))
        assert abs((x * size).sum() - f * size.sum()) < 1e-6 and ((x > 0) & (x < 1)).sum() <= 1
        hits += x
    assert np.abs(hits / 4000 - f).max() < 0.035


def test_mixing_edges(empty, clashing):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(clashing).where("copies IS NULL OR taken < 0").count() == 0


# ---- language model


def brute_base(docs):
    rows = [(None if pd.isna(d) else int(d), None if pd.isna(t) else t) for d, t in zip(docs.doc_id, docs.text)]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[*words(t, SPACED), None] for _, t in rows]
    c = collections.Counter(x for w, h in zip(tokens, held) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [((d, t), h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for (d, t), h, w in zip(rows, held, tokens)]


@pytest.mark.parametrize("frequent", [500_000, 300])
def test_language_model(table, docs, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    all_ = table.withColumn("held", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    found = lm.score(all_.withColumn("t", F.col("text")), all_.where("NOT held")).collect()
    got = sorted((str(r.doc_id), r.t or "", r.held, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    want = sorted((str(k[0]), k[1] or "", h, n, m, t, round(b, 5)) for k, h, n, m, t, b in brute_base(docs))
    assert [x[:6] for x in got] == [x[:6] for x in want] and all(abs(a[6] - b[6]) < 1e-4 for a, b in zip(got, want))
    assert all(r.score < 0 for r in found) and all((r.bits_per_byte is None) == (not words(r.t, SPACED)) for r in found)  # of the words joined by single spaces


def test_word_hashes():
    import pyarrow as pa

    ws = ["a", "b", "ab", "ba", "aa", "x" * 300, "x" * 301, "é"]
    h = tokens.hash_words(pa.array(ws, pa.large_string()))
    assert len(set(h.tolist())) == len(ws) and h.tolist() == tokens.hash_words(pa.array(ws[::-1], pa.large_string()))[::-1].tolist()
    starts, numbers, _, kinds = tokens.tokenised([" A b\t", None, "", "\x0b a\x1cB"])
    assert starts.tolist() == [0, 2, 2, 2, 3] and kinds.take(pa.array(numbers)).to_pylist() == ["a", "b", "a\x1cb"]


def test_coding_is_a_round_trip():
    chars = [ord(c) for c in "etaoinshrdlcumwfgypbvkxjqzé0123456789.,;:!?-()'\"abcñüöä"]
    chars = list(dict.fromkeys(chars))
    coder = lm.Coder(chars)
    frequent, next_ = [c for c in chars if c != 32][:28], [c for c in chars if c != 32][28:60]

    def back(s):
        out, k = [], 0
        while s[k] != lm._END:
            if s[k] == lm._SHIFT:
                out.append(next_[s[k + 1]])
                k += 2
            elif s[k] == lm._POINT:
                x = 0
                for d in s[k + 1 : k + 6]:
                    x = x << 5 | int(d)
                out.append(x)
                k += 6
            else:
                out.append(32 if s[k] == lm._SPACE else frequent[s[k] - 2])
                k += 1
        assert k == len(s) - 1
        return "".join(map(chr, out))

    for text in ("", "hello world", "ÀÉ 你好 \U0001f600 x", "q9z (tab)\tnew\nline"):
        assert back(coder(lm.words_of(text))) == b" ".join(lm.words_of(text)).decode()


def test_probabilities_of_next_symbols_sum_to_one():
    """After any prefix, the bits of all continuations by one symbol are a distribution."""
    import numpy as np

    rng = np.random.default_rng(1)
    tables = [rng.integers(-60, 60, n).astype(np.int8) for n in lm.table_sizes(8)]
    prefix = rng.integers(1, 30, 40).astype(np.uint8)
    base = lm.score_streams([prefix], tables)[0]
    more = lm.score_streams([np.append(prefix, s).astype(np.uint8) for s in range(32)], tables)
    assert np.exp2(base - more).sum() == pytest.approx(1, abs=1e-3)


def brute_bits(stream, tables, bits, segment):
    """One decision at a time."""
    import numpy as np

    total, past = 0.0, [0] * 8
    weights = scale = offset = None
    for i, symbol in enumerate(stream):
        if i % segment == 0:
            weights, scale, offset = [[w * float(lm.UNIT) for w in lm.START] for _ in range(5)], [1.0] * 5, [0.0] * 5
        if i % segment % lm.STEP == 0:
            moves = [[0.0] * 5 for _ in range(5)]
        begin = max((k + 1 for k in range(i) if stream[k] <= 1), default=0)
        word = np.array(stream[begin:i], np.uint8)
        places = []
        for order in lm.ORDERS:
            h = 0
            for back in range(order):
                h |= int(past[-1 - back]) << (5 * back)
            places.append(int(lm._place(np.array([h], np.uint64), bits)[0]) if 5 * order > bits else h << 5)
        places.append(int(lm._place(lm._word_so_far(np.append(word, 0).astype(np.uint8))[-1:] if begin == 0 else lm._word_so_far(np.concatenate(([1], word, [0])).astype(np.uint8))[-1:], bits)[0]))
        for d in range(5):
            node, bit = (1 << d) | (int(symbol) >> (5 - d)), (int(symbol) >> (4 - d)) & 1
            x = [float(t[p + node]) for t, p in zip(tables, places)]
            z = sum(a * b for a, b in zip(x, weights[d]))
            p1 = 1 / (1 + math.exp(-(z * scale[d] + offset[d])))
            total -= math.log2(p1 if bit else 1 - p1)
            lack = bit - p1
            for k in range(3):
                moves[d][k] += lm.RATE * float(lm.UNIT) ** 2 * x[k] * lack
            moves[d][3] += lm.SCALE_RATE * z * lack
            moves[d][4] += lm.OFFSET_RATE * lack
        past.append(symbol)
        if (i % segment + 1) % lm.STEP == 0:
            for d in range(5):
                weights[d] = [w + m for w, m in zip(weights[d], moves[d])]
                scale[d] += moves[d][3]
                offset[d] += moves[d][4]
    return total


@pytest.mark.parametrize("segment", [64, 2048])
def test_mixing_of_predictions_against_brute_force(segment):
    import numpy as np

    rng = np.random.default_rng(4)
    tables = [rng.integers(-40, 40, n).astype(np.int8) for n in lm.table_sizes(8)]
    for n in (1, 15, 16, 200):
        stream = np.append(rng.integers(1, 32, n), 0).astype(np.uint8)
        assert lm.score_streams([stream], tables, segment)[0] == pytest.approx(brute_bits(stream.tolist(), tables, 8, segment), rel=1e-4)


def test_tables_grow_with_the_corpus(table):
    assert [lm.bits_for(n) for n in (0, 1 << 14, (1 << 14) + 1, 1 << 17, 1 << 60)] == [14, 14, 15, 17, lm.MAX_BITS]
    texts = [r.text for r in table.collect()]
    chars = [r.key for r in lm.count_tokens(table).where("kind = 1").orderBy(F.desc("n"), "key").limit(61).collect()]
    import numpy as np

    coder, counts = lm.Coder(chars), [np.zeros(n, np.int64) for n in lm.table_sizes(14)]
    for t in texts:
        stream = coder(lm.words_of(t))
        symbols, starts, bases = lm.contexts([stream], 14)
        at = np.arange(starts[0], starts[0] + len(stream))
        for c, b in zip(counts, bases):
            np.add.at(c, b[at] + symbols[at], 1)
    assert all((lm._stretched(a) == b).all() for a, b in zip(counts, lm.learn_tables(table, chars, 14)))


def brute_scores(texts, training, chars):
    """log10 probabilities by counts of each whole context, in dictionaries."""
    import numpy as np

    coder, counts = lm.Coder(chars), collections.defaultdict(lambda: np.zeros(32, np.int64))

    def seen(stream):
        past, word = (0,) * max(lm.ORDERS), ()
        for s in stream.tolist():
            yield [*((o, past[-o:]) for o in lm.ORDERS), ("word", word)], s
            past, word = past[1:] + (s,), () if s <= lm._SPACE else word + (s,)

    for t in training:
        for found, s in seen(coder(lm.words_of(t))):
            for c in found:
                counts[c][s] += 1
    stretched = functools.cache(lambda c: lm._stretched(counts[c]) if c in counts else np.zeros(32, np.int8))
    out = []
    for t in texts:
        stream = coder(lm.words_of(t))
        rows = [[stretched(c) for c in found] for found, _ in seen(stream)]
        tables = [np.concatenate([r[k] for r in rows]) for k in range(3)]  # a row for each place in the text

        def look(at, s, sign, tables=tables, first=max(lm.ORDERS)):
            node = lm._NODE[:, s].transpose(1, 0, 2)
            return [k.take(node + 32 * np.clip(at - first, 0, len(k) // 32 - 1)[:, None]).astype(np.float32) for k in tables]

        symbols = np.concatenate((np.zeros(max(lm.ORDERS), np.uint8), stream))
        out.append(-lm._mixed([stream], symbols, np.array([max(lm.ORDERS)]), look, lm.SEGMENT)[0] * math.log10(2))
    return out


@pytest.mark.parametrize("within", [True, False])
def test_contexts_beyond_the_tables_keep_their_own_counts(table, within, monkeypatch):
    """More tokens than the largest tables have places: as if each context had one, over several chunks and parts."""
    monkeypatch.setattr(lm, "MAX_BITS", 11)
    monkeypatch.setattr(lm, "GROUP", 20_000, raising=False)
    monkeypatch.setattr(lm, "PART", 10_000, raising=False)
    table = table.where(F.coalesce(F.length("text"), F.lit(0)) < 2_000)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = lm.score(table.withColumn("t", F.col("text")), ~held if within else table.where(~held)).collect()
    chars = [r.key for r in lm.count_tokens(table.where(~held)).where("kind = 1").orderBy(F.desc("n"), "key").limit(61).collect()]
    assert len(found) == table.count() and found[0].train_tokens > 1 << lm.MAX_BITS
    want = brute_scores([r.t for r in found], [r.text for r in table.where(~held).collect()], chars)
    assert all(r.score == pytest.approx(w, rel=1e-4) for r, w in zip(found, want))


def test_keys_are_ranked_with_their_last_bits():
    import numpy as np

    values = np.array([5, 3, 5, (1 << 62) + 1, 1 << 62, (1 << 62) + 1, 0], np.uint64)
    for bits, kept in ((63, values), (4, values[values < 16])):
        different, numbers = lm._ranked(kept, bits)
        assert different.tolist() == sorted(set(kept.tolist())) and (different[numbers] == kept).all()


def test_scores_do_not_depend_on_company():
    import numpy as np

    rng = np.random.default_rng(1)
    tables = [rng.integers(-60, 60, n).astype(np.int8) for n in lm.table_sizes(8)]
    streams = [rng.integers(1, 30, n).astype(np.uint8) for n in (1, 17, 5000, 300)]
    alone = [lm.score_streams([s], tables)[0] for s in streams]
    assert np.allclose(lm.score_streams(streams, tables), alone, rtol=1e-5)


def test_language_model_edges(empty, clashing):
    assert lm.score(empty, empty).count() == 0
    none = lm.score(clashing, empty).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none) and len(none) == clashing.count()
