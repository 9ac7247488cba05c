"""Benchmark decontamination by a generalised suffix automaton of the benchmark items.

The automaton holds every run of words of every item. A text streams through it; at each word the
state and the length of the longest run that ends there are known. Where that length reaches the
window, the window's words are hit and the items that hold the window can be read off the state.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import ALNUM_WORD, KEEP, discard, extended, fresh, materialise, table

WINDOW = 10
#: The most item words that one automaton holds (some 1 KB each in a worker); more items make more automata, each streamed by itself.
AUTOMATON_WORDS = 200_000

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class Automaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, ids in numbered:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min((min(len(ids), window) for _, ids in numbered), default=window)
        n = len(self.next)
        #: Of each state, the state of its runs' last ``window`` words.
        self.tail = [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.tail[v] = v if self.length[up] < window else self.tail[up]
        self.holders: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for name, ids in numbered:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.holders.setdefault(self.tail[v], set()).add(name)
            if len(ids) < window:
                while self.length[self.link[v]] >= len(ids):
                    v = self.link[v]
                self.whole.setdefault(v, []).append((len(ids), name))
        #: Of each state, the nearest state on its suffix path, itself included, where a short item is whole.
        self.short = [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            self.short[v] = v if v in self.whole else self.short[self.link[v]] if self.link[v] > 0 else -1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (from, to) in words, ascending and apart, and the names of the items hit."""
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.shortest:
                self._stream(ids[start:end].tolist(), start, spans, names)
        return spans, names

    def _stream(self, ids: list[int], offset: int, spans: list[tuple[int, int]], names: set[str]) -> None:
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        v = matched = 0
        for i, c in enumerate(ids, offset):
            while c not in nxt[v]:
                v = link[v]
                matched = length[v]
            v = nxt[v][c]
            matched += 1
            hit = 0
            if matched >= window:
                hit = window
                names |= self.holders[self.tail[v]]
            u = short[v]
            while u > 0:
                for n, name in self.whole[u]:
                    if n <= matched:
                        names.add(name)
                        hit = max(hit, n)
                u = short[link[u]] if link[u] > 0 else -1
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))


_HITS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:bigint,stop:bigint>>"
_ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def _item_blocks(items: DataFrame) -> Iterator[tuple[bool, list[tuple[str, list[bytes]]]]]:
    """The items in blocks of about AUTOMATON_WORDS words, each with whether it is the last; one block is fetched at once."""
    named = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("name"), "text")
    words = named.agg(F.sum(F.regexp_count("text", F.lit(ALNUM_WORD))).alias("n")).collect()[0].n or 0
    blocks = max(1, -(-words // AUTOMATON_WORDS))
    for b in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).collect()
        yield b == blocks - 1, [(r.name, words_of(r.text)) for r in sorted(rows, key=lambda r: (r.name, r.text))]


def find_overlap(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input's columns (the text included) with n_words, n_hit, n_items, items_sha256, contaminated, items and spans.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer. Null
    texts and items have no words; items without words or id match nothing; an empty benchmark hits
    nothing; an empty table gives an empty result. Equal rows are handled each by itself, and long
    texts whole. Input columns of the added names are replaced. Rows stay in their partitions:
    nothing is shuffled. A benchmark of more words than one automaton holds is taken in blocks, with
    the rows written to the shared folder between them, so that one automaton is in memory at a time.
    """
    return _streamed(docs, items, window, None)


def _streamed(docs: DataFrame, items: DataFrame, window: int, max_cover: float | None) -> DataFrame:
    """``find_overlap``, or, where max_cover is given, the rows of ``decontaminate``, in the last pass."""
    docs = fresh(docs, *_ADDED)
    names, out, before = docs.columns, docs, None
    for last, block in _item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))  # of AUTOMATON_WORDS words or one item, about
        out = _pass(out, shared, before is None, max_cover if last else None)
        if not last:
            written = materialise(out, "overlap")
            shared.unpersist()
            if before is not None:
                discard(before)
            out = before = written
    return out.select(*names, *(_ADDED if max_cover is None else ()))


def _pass(docs: DataFrame, shared: Broadcast, first: bool, max_cover: float | None) -> DataFrame:
    counted = max_cover is not None and "n_chars" in docs.columns
    reads = ["text", *(() if first else ("spans", "items")), *(("n_chars",) if counted else ())]

    def start():
        sam = shared.value

        def work(texts: list[str | None], *more: list) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in _ADDED}
            for k, text in enumerate(texts):
                words = words_of(text)
                spans, hit = sam.spans(words)
                if not first:  # what other blocks of items have hit
                    spans = _union([*spans, *((x["start"], x["stop"]) for x in more[0][k])])
                    hit |= set(more[1][k])
                known = sorted(hit)
                row = (len(words), sum(b - a for a, b in spans), len(known), hashlib.sha256(",".join(known).encode()).hexdigest(), bool(spans), known, [{"start": a, "stop": b} for a, b in spans])
                for c, x in zip(_ADDED, row):
                    out[c].append(x)
            if max_cover is None:
                return out
            spans = [[(x["start"], x["stop"]) for x in found] for found in out["spans"]]
            left = [cut(t, x) if x else t for t, x in zip(texts, spans)]
            done = {"text": left, KEEP: [not n > max_cover * m for n, m in zip(out["n_hit"], out["n_words"])]}
            return done | ({"n_chars": [len(t) if x else n for n, t, x in zip(more[-1], left, spans)]} if counted else {})

        return work

    if max_cover is None:
        return extended(docs, reads, start, _HITS)
    kind = f", n_chars {docs.schema['n_chars'].dataType.simpleString()}" if counted else ""
    return extended(docs, reads, start, f"text string{kind}", drop=_ADDED)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : places[a][0]])
        at = places[b - 1][1]
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_cover: float = 0.8) -> DataFrame:
    """The input's columns: hit spans are cut from the texts; a text of which more than max_cover of the words are hit goes.

    Null and empty texts stay as they are, as do texts without a hit. n_chars, where there is such a
    column, follows a text that is cut. Columns named as results of find_overlap go. Everything else as there.
    """
    return _streamed(docs, items, window, max_cover)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_overlap(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *_ADDED[:5])


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bp AS (
  SELECT item, w, len(w) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, least(n, 10) AS size, array_to_string(list_slice(w, i, i + least(n, 10) - 1), ' ') AS g FROM bp
), sizes AS (
  SELECT DISTINCT size FROM bw
), dp AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size
), dw AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g FROM dp
), hits AS (
  SELECT doc_id, dw.size AS size, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size
), places AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits
), hit AS (
  SELECT doc_id, COUNT(*) AS n FROM places GROUP BY doc_id
), names AS (
  SELECT doc_id, COUNT(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(names.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id
"""
