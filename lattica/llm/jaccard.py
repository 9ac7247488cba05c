"""N-gram Jaccard join with a count-vector R-tree.

A document is its set of distinct word n-grams. Two documents link when the sets' Jaccard
similarity is at least the threshold; classes are the connected components of the links.

1. Equal sets are one class member from the start, so that copies cost one row.
2. Sets that may reach the threshold share one of their rarest n-grams (the prefix rule: the first
   ``n - ceil(t * n) + 1`` of n-grams in one order of all). The order puts n-grams first whose slot in
   a table of counts of bounded size is emptier, so that passages which many documents share come last.
   These shared n-grams deal the documents out to blocks; no pair is formed yet.
3. In a block, n-grams are hashed into groups and the counts of the groups are points in an R-tree.
   The overlap of a set with all sets below a tree node is at most the sum of the smaller
   coordinates of the set's point and the node's upper corner; nodes that cannot reach the overlap
   that the threshold asks for are left out. Surviving pairs are verified on the sets, but for pairs
   that verified links connect already. Only links that connect are returned.
4. Blocks too large for a task are split, and each pair of parts is a block of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import extended, lean, materialise, table
from lattica.llm.components import components
from lattica.llm.tokens import chunks, tokenised

#: The most n-grams of a block that one task holds; larger blocks are split into pairs of parts.
BLOCK_GRAMS = 4_000_000
#: Small blocks share tasks of about so many n-grams.
TASK_GRAMS = 1_500_000
#: The most sets of a run (one n-gram's) that a task holds; hotter n-grams are split into pairs of parts.
RUN_SETS = 20_000
#: Candidates' ids are broadcast up to this count (32 bytes each).
BROADCAST_IDS = 1_000_000
#: Slots of the table of counts (two bytes each when broadcast).
SLOTS_PER_DOC, MIN_SLOTS, MAX_SLOTS = 64, 1 << 18, 1 << 24
_SLOT_BLOCK = 1 << 16
#: Tables of so many tasks are added up in one group.
_FAN = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_CACHE = 150_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; words are those between ASCII white space, with A-Z lower-cased."""
    starts, numbers, hashes, _ = tokenised(texts)
    h = hashes.view(np.uint64)[numbers]
    all_ = _rolled(h, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        # a whole sequence that is shorter is no n-gram of a longer text: the length goes into the hash
        out.append(np.unique(all_[a : b - n + 1] if b - a >= n else _rolled(h[a:b], b - a)))
    return out


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    size = max(0, len(h) - n + 1) if n else 0
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = _mixed((out + _MIX) * _MUL ^ h[i : size + i])
    return out


def _sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows' sets, worked out for some texts at a time."""
    for rows in chunks(texts):
        yield from zip(rows, gram_sets([texts[i] for i in rows], n))


def _key(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def _packed(counts: np.ndarray) -> bytes:
    """In the fewest bytes a count, compressed; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w))
    return bytes([width]) + zlib.compress(counts.astype(f"u{width}").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def _rarity(docs: DataFrame, n: int, slots: int) -> np.ndarray:
    """How full the slot of an n-gram is: a table of fixed size, counted over all documents.

    Differences well below the chance scatter of the counts are rounded away, so that two bytes do.
    """
    shift = np.uint64(64 - slots.bit_length() + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, np.int32)
        for pdf in batches:
            for _, g in _sets(pdf["text"].tolist(), n):
                np.add.at(total, (g >> shift).astype(np.intp), np.int32(1))
        part = TaskContext.get().partitionId() // _FAN
        rows = [(b, part, _packed(c)) for b, c in enumerate(total.reshape(-1, _SLOT_BLOCK)) if c.any()]
        if rows:
            yield pd.DataFrame(rows, columns=["block", "part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unpacked(c) for c in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [0], "counts": [_packed(total)]})

    # in two levels, so that no task gets a block from every other one
    kind = "block int, part int, counts binary"
    sums = docs.select("text").mapInPandas(lean(count), kind).groupBy("block", "part").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind)
    blocks = {r.block: bytes(r.counts) for r in sums.collect()}  # at most MAX_SLOTS counts, which stay compressed but for one block
    scatter = math.sqrt(max(1.0, sum(int(_unpacked(c).sum()) for c in blocks.values()) / slots))
    away = max(0, int(math.log2(scatter / 4)) if scatter > 4 else 0)
    out = np.zeros(slots, np.uint16)
    for b, c in blocks.items():
        out[b * _SLOT_BLOCK : (b + 1) * _SLOT_BLOCK] = np.minimum(_unpacked(c) >> away, 65535)
    return out


def _vector(grams: np.ndarray) -> bytes:
    """Counts of groups of n-grams, a byte each; from 8 groups on, one for eight to sixteen n-grams."""
    groups = 1 << max(3, (len(grams) // 16).bit_length())
    while True:
        counts = np.bincount((grams & np.uint64(groups - 1)).astype(np.intp), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


def _folded(vector: bytes, groups: int) -> np.ndarray:
    """Fewer groups: those with the same last bits are added up."""
    return np.frombuffer(vector, np.uint8).reshape(-1, groups).sum(axis=0, dtype=np.int32)


def _bounded_links(keys: np.ndarray, sizes: np.ndarray, vectors: list[bytes], parts: np.ndarray, t: float) -> list[tuple[int, int]]:
    """Pairs that connect all pairs which the summed coordinate minima allow to be similar.

    The rows are points of an R-tree; each row searches it, and what it reaches is not reached again,
    so that a group of near copies costs one pass. Sizes of allowed pairs differ by less than a factor
    of two, so rows are taken by their number of groups together with those that have twice as many.
    """
    out: list[tuple[int, int]] = []
    widths = np.array([len(v) for v in vectors])
    for groups in np.unique(widths).tolist():
        rows = np.flatnonzero((widths >= groups) & (sizes <= sizes[widths == groups].max() / t + 1e-9))
        if len(rows) < 2:
            continue
        points, size, part = np.stack([_folded(vectors[r], groups) for r in rows]), sizes[rows], parts[rows]
        crossed = len(np.unique(part)) > 1
        tree, left, unreached = CountTree(points, size), np.ones(len(rows), bool), len(rows)
        for first in range(len(rows)):
            if not left[first]:
                continue
            front, left[first], unreached = [first], False, unreached - 1
            while front and unreached:
                i = front.pop()
                near = tree.search(points[i], int(size[i]), t)
                near = near[left[near]]
                if crossed:
                    near = near[part[near] != part[i]]
                if len(near):
                    hits = near.tolist()
                    left[near], unreached = False, unreached - len(hits)
                    out += [(int(keys[rows[i]]), int(keys[rows[j]])) for j in hits]
                    front += hits
            if not unreached:
                break
    return out


def _runs(t: float):
    """From rows sorted by gram (and part pair), links of each run of equal ones; a run is held whole, and hot ones come in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, seen = None, set()
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            marks = _marks(pdf)
            last = (marks == marks[-1]).all(axis=1)
            rest = pdf[last]
            if not last.all():
                yield _linked(pdf[~last], t, seen)
        if rest is not None:
            yield _linked(rest, t, seen)

    return run


def _marks(pdf: pd.DataFrame) -> np.ndarray:
    """What tells runs apart: the n-gram and the pair of parts."""
    return np.stack((pdf["gram"].to_numpy(), pdf["place"].to_numpy() >> 21), axis=1)


def _linked(pdf: pd.DataFrame, t: float, seen: set[int]) -> pd.DataFrame:
    out: list[tuple[int, int]] = []
    if len(pdf):
        marks = _marks(pdf)
        starts = np.concatenate(([0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(pdf)]))
        keys, sizes, parts, vectors = pdf["key"].to_numpy(), pdf["n"].to_numpy(), pdf["place"].to_numpy() & ((1 << 21) - 1), pdf["vector"].tolist()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a > 1:
                # copies of a passage or a text share many n-grams: the same rows are not held against each other again
                same = hash((keys[a:b].tobytes(), parts[a:b].tobytes()))
                if same not in seen:
                    if len(seen) < _CACHE:
                        seen.add(same)
                    out += _bounded_links(keys[a:b], sizes[a:b], vectors[a:b], parts[a:b], t)
    return pd.DataFrame(sorted(set(out)), columns=["u", "v"]).astype("int64")


def _prefixes(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """doc_id, th (the text's hash), n, key (of the set; null if empty), prefix (the n-grams by which the set is dealt out) and vector (counts of groups)."""
    spark = docs.sparkSession
    wanted = max(1, docs.count()) * SLOTS_PER_DOC
    slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << wanted.bit_length()))
    levels = spark.sparkContext.broadcast(_rarity(docs, n, slots))  # 2 * MAX_SLOTS bytes at most
    shift = np.uint64(64 - slots.bit_length() + 1)

    def start():
        level = levels.value

        def work(texts: list[str | None]) -> dict[str, list]:
            out = {"n": [], "key": [], "prefix": [], "vector": []}
            for _, g in _sets(texts, n):
                size = len(g) - math.ceil(t * len(g)) + 1 if len(g) else 0
                order = np.argsort(level[(g >> shift).astype(np.int64)], kind="stable")
                out["n"].append(len(g))
                out["key"].append(_key(g) if len(g) else None)
                out["prefix"].append(g[order[:size]].view(np.int64))
                out["vector"].append(_vector(g) if len(g) else b"")
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("th"))
    return materialise(extended(rows, ["text"], start, "n bigint, key bigint, prefix array<bigint>, vector binary", drop=["text"]), "prefixes")


class CountTree:
    """An R-tree over group-count points, packed: sets by size, then by the sum of half their coordinates; upper corners only, as bounds need no more."""

    LEAF, FAN = 32, 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = np.argsort(sizes, kind="stable")
        half = points[:, ::2].sum(axis=1)
        self.order = np.concatenate([s[np.argsort(half[s], kind="stable")] for s in np.array_split(slab, max(1, len(slab) // 512))])
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [self._pack(self.points, self.sizes, self.sizes, self.LEAF)]
        while len(self.levels[-1][1]) > self.FAN:
            self.levels.append(self._pack(*self.levels[-1], self.FAN))

    @staticmethod
    def _pack(high: np.ndarray, low_size: np.ndarray, high_size: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.arange(0, len(high), fan)
        return np.maximum.reduceat(high, starts), np.minimum.reduceat(low_size, starts), np.maximum.reduceat(high_size, starts)

    def search(self, point: np.ndarray, size: int, t: float) -> np.ndarray:
        """Rows (of the points given) whose sets may reach similarity t with this one."""
        nodes, slack = np.arange(len(self.levels[-1][1])), 1e-9
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_size, high_size = (a[nodes] for a in self.levels[depth])
            fit = (high_size >= t * size - slack) & (low_size <= size / t + slack)
            fit &= np.minimum(high, point).sum(axis=1) >= t / (1 + t) * (size + np.maximum(low_size, t * size)) - slack
            nodes = nodes[fit]
            fan, count = (self.FAN, len(self.levels[depth - 1][1])) if depth else (self.LEAF, len(self.sizes))
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes = nodes[nodes < count]
        sizes = self.sizes[nodes]
        fit = np.minimum(self.points[nodes], point).sum(axis=1) >= t / (1 + t) * (size + sizes) - slack
        return self.order[nodes[fit]]


def link_block(sets: list[np.ndarray], parts: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """Links that connect what links connect, among the sets (of different parts only where two parts are given)."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    groups = 1 << max(4, min(8, int(sizes.mean() / 4).bit_length()))
    points = np.zeros((count, groups), np.int32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    tree, tf = CountTree(points, sizes), float(t)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(ids.max()) + 1, bool)
    owner, crossed = np.arange(count), len(np.unique(parts)) > 1
    links: list[tuple[int, int]] = []
    for i in range(count - 1):
        near = tree.search(points[i], int(sizes[i]), tf)
        near = near[(near > i) & (owner[near] != owner[i])]
        if crossed:
            near = near[parts[near] != parts[i]]
        if not len(near):
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        for some in np.array_split(near, max(1, int(sizes[near].sum()) // 2_000_000)):
            at = np.concatenate([ids[starts[j] : starts[j + 1]] for j in some])
            cuts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            shared = np.add.reduceat(mark[at], cuts, dtype=np.int64)
            union = sizes[i] + sizes[some] - shared
            for j in some[shared * t.denominator >= union * t.numerator].tolist():
                if owner[j] != owner[i]:
                    links.append((i, j))
                    owner[owner == owner[j]] = owner[i]
        mark[own] = False
        if not (owner[i:] != owner[i]).any():
            break
    return links


def _links(t: Fraction):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["root", "i", "j", "key"])
        out: list[tuple[int, int]] = []
        for _, g in pdf.groupby(["root", "i", "j"], sort=False):
            if len(g) > 1:
                g = g.sort_values(["n", "key"])
                keys = g["key"].to_numpy()
                sets = [np.asarray(s).view(np.uint64) for s in g["grams"]]
                out += [(int(keys[a]), int(keys[b])) for a, b in link_block(sets, g["part"].to_numpy(), t)]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _in_parts(rows: DataFrame, parts: Column) -> DataFrame:
    """Adds parts, part, i and j: rows of a group in several parts are repeated so that part p meets each part q in group (min, max)."""
    rows = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("part", "q")).withColumn("j", F.greatest("part", "q"))


def _classed(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """doc_id, th, n, root (of the class; null for the empty set) and least (the class's smallest doc_id)."""
    base = _prefixes(docs, n, t)
    sets = base.where("key IS NOT NULL").groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("vector").alias("vector"))
    sets = materialise(sets, "sets")
    dealt = sets.select("key", F.explode("prefix").alias("gram"))
    shared = dealt.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    live = dealt.join(shared, "gram").join(sets.select("key", "n", "vector"), "key")
    live = _in_parts(live, F.ceil(F.col("sets") / RUN_SETS))
    place = F.shiftleft(F.col("i").cast("bigint"), 42) + F.shiftleft(F.col("j").cast("bigint"), 21) + F.col("part")
    runs = live.select("gram", place.alias("place"), "key", "n", "vector").repartition("gram", F.shiftright("place", 21)).sortWithinPartitions("gram", "place", "key")
    blocks = components(runs.mapInPandas(lean(_runs(float(t))), "u bigint, v bigint"))

    members = materialise(sets.where("rep IS NOT NULL").join(blocks, sets.key == blocks.node).select("root", "key", "rep", "n"), "members")
    sums = members.groupBy("root").agg(F.sum("n").alias("grams"))
    total = members.agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()[0]
    tasks = max(1, math.ceil((total.n or 0) / TASK_GRAMS))
    dealt_out = _in_parts(members.join(sums, "root"), F.ceil(F.col("grams") / BLOCK_GRAMS))
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "i", "j"))
    dealt_out = dealt_out.select("rep", "key", "root", "i", "j", "part", task.alias("task"))
    ids = members.select("rep", F.col("key").alias("rep_key"))
    ids = F.broadcast(ids) if total.docs <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(ids, "rep").select("rep_key", "text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf["rep_key"].tolist()
            # another row may bear the same id; the set tells
            rows = [(keys[i], len(g), g.view(np.int64)) for i, g in _sets(pdf["text"].tolist(), n) if len(g) and _key(g) == keys[i]]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "n", "grams"])

    held = texts.mapInPandas(lean(grams), "key bigint, n bigint, grams array<bigint>")
    deals = F.broadcast(dealt_out.drop("rep")) if total.docs <= BROADCAST_IDS else dealt_out.drop("rep")
    links = held.join(deals, "key").groupBy("task").applyInPandas(_links(t), "u bigint, v bigint")
    joined = components(links)

    placed = sets.select("key", "n", "rep").join(joined, sets.key == joined.node, "left").withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("rep").alias("least"))
    placed = placed.join(least, "root").select(F.col("key").alias("k"), F.col("n").alias("m"), "root", "least")
    return base.select("doc_id", "th", "n", "key").join(placed, (F.col("key") == F.col("k")) & (F.col("n") == F.col("m")), "left").select("doc_id", "th", "n", "root", "least")


def classes(docs: DataFrame, n: int = 5, threshold: Fraction | str = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; other columns are left out, whatever their names.

    component_id is the smallest doc_id that links lead to, the row's own included. A text of fewer
    than n words is one n-gram; a null text and one without words has none and links with nothing.
    A null doc_id is no id to be found by: such a row takes part in no link but with equal sets.
    Repeated rows are equal sets; one id with several texts has a row, and maybe a class, for each.
    Texts are taken whole, however long. Empty tables give empty results.
    """
    found = _classed(docs, n, Fraction(threshold))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction | str = Fraction(4, 5)) -> DataFrame:
    """The rows, with their own columns, that stand for their class: one each, with its smallest doc_id.

    Where several texts of a class, or several rows of a text, have that id, the row with the least hash
    of the text, then of all columns, stays. Texts without words are each a class by id and text. Rows
    without an id stay. Empty tables give empty results.
    """
    names = docs.columns
    found = _classed(docs, n, Fraction(threshold)).where("doc_id IS NOT NULL AND doc_id = coalesce(least, doc_id)")
    own = F.when(F.col("root").isNull(), F.struct("doc_id", "th"))
    kept = materialise(found.groupBy("root", own.alias("own")).agg(F.min(F.struct("doc_id", "th")).alias("one"), F.count("*").alias("rows")).select("one.*", "rows"), "kept")
    ids = kept.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    ids = F.broadcast(ids) if kept.count() <= BROADCAST_IDS else ids  # few enough ids spare the texts a shuffle
    rows = docs.where(F.col("doc_id").isNotNull()).join(ids, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_semi")
    if kept.where("rows > 1").limit(1).count():
        # rows of one id and text: the least hash of all columns is found before rows are dealt; equal rows are then interchangeable
        rows = rows.withColumn("__th", F.xxhash64("text")).withColumn("__all", F.xxhash64(*names))
        least = rows.groupBy(F.col("doc_id").alias("__id"), F.col("__th").alias("__t")).agg(F.min("__all").alias("__least"))
        least = F.broadcast(least) if kept.count() <= BROADCAST_IDS else least
        rows = rows.join(least, (F.col("doc_id") == F.col("__id")) & (F.col("__th") == F.col("__t")) & (F.col("__all") == F.col("__least")), "left_semi").dropDuplicates(["doc_id", "__th"]).select(*names)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, Fraction(9, 10))
