"""Language-model scores by online logistic context mixing.

Text is lower-cased (A-Z), its words are joined by single spaces, and it ends with an end symbol.
Characters are written in symbols of five binary decisions: the end, the space, the 28 most frequent other
characters of the training texts, and two shifts, one before the 32 next frequent characters and one before
a code point in five symbols. Each decision is predicted in several contexts: the last 4 and 8 symbols and the word so far, by tables of counts over
all training texts. Of up to 2^MAX_BITS counted training tokens, contexts are hashed into tables that grow with the tokens and
that each task holds in memory. Of more tokens, each context keeps counts of its own, however many there are: groups of texts
send the different contexts with symbols that they hold (last symbols as they are, words so far by 48 bits of a hash and two symbols) to the part
that their keys fall in, which adds up the counts of all training texts and sends each group what its predictions are made of.
Groups are of texts with similar frequencies of bytes, which share contexts; that changes no score. Groups and
parts are of bounded size and grow in number with the corpus. The stretched predictions are mixed with weights
that are gated by the decision's depth and adapt online within a text; the mix is refined by an
adaptive scale and offset. Long texts are mixed in segments of ``segment`` symbols that each start with the same weights,
with contexts running across; that bounds the steps in which texts are scored together. Training
texts are scored by tables that hold their own counts, so their scores are better than those of unseen texts.

The unigram base needs the training count of every token. Counts of frequent words are broadcast
(a bounded table that covers most tokens), rare ones are joined in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica.llm.common import extended, fresh, held_out, lean, materialise, table
from lattica.llm.tokens import chunks, powers, spread, tokenised

ORDERS = (4, 8)
#: Hashed contexts of an order: 2 to the power of so many bits, of 32 symbols each (a byte each when broadcast, four when counted).
#: A corpus of more tokens than the most has no hashed tables, but keys of all contexts.
MIN_BITS, MAX_BITS = 14, 19
#: Words whose counts are broadcast, at most (16 bytes each).
FREQUENT = 500_000
#: Symbols of a segment, and those that are mixed between two changes of the weights.
SEGMENT, STEP = 2_048, 16
#: Starting weights by order, learning rates of weights, scale and offset, and what is added to counts.
START, RATE, SCALE_RATE, OFFSET_RATE, PRIOR = (0.5, 0.4, 0.5), 0.006, 0.001, 0.002, 0.05
#: Stretched predictions are kept in a byte of this unit.
UNIT = np.float32(0.08)
_END, _SPACE, _SHIFT, _POINT = 0, 1, 30, 31
#: Different words that a task holds before it hands their counts on.
_CACHE = 1_000_000
_BLOCK = 1 << 16
#: Symbols whose contexts are found at once, about.
_PIECE = 1 << 16
#: Bytes of texts, about, that are packed together: what they come to is no large object for the JVM.
_PACKED = 500_000
#: Tables of so many tasks are added up in one group.
_FAN = 256
#: Characters, about, of the texts whose keys are asked for together, and of those whose keys make up a part.
GROUP, PART = 12_000_000, 8_000_000
#: Bits of a context in the keys of each order (of words: 48 of a hash, two symbols); five of the symbol follow.
_KEY_BITS = (*(5 * o for o in ORDERS), 58)
#: Kinds of texts, at most, that make up groups of their own, texts that they are found by, about, and characters of each that count.
KINDS, SAMPLE, HEAD = 8, 2_000, 1_024
#: No key: keys have fewer bits.
_NONE = np.uint64((1 << 64) - 1)
#: Keys that are ranked at once, whose sort stays in a core's cache and whose numbers fit in two bytes.
_RANK = 1 << 16
#: Keys of a group are put together by ranges of so many first bits.
_RANGE_BITS = 6
#: Keys whose counts are added up by decisions at once, about.
_RUN = 1 << 15
_LOG10_2 = math.log10(2.0)

_SYMBOLS = np.arange(32)
_NODE = np.stack([(1 << d) | (_SYMBOLS >> (5 - d)) for d in range(5)]).astype(np.intp)
#: Minus the sign of each decision.
_SIGN = np.stack([1.0 - ((_SYMBOLS >> (4 - d)) & 1) * 2.0 for d in range(5)]).astype(np.float32)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: The hash of the end, which is no word's but by chance.
END = int(spread(np.array([1], np.uint64)).view(np.int64)[0])


class Coder:
    """Texts to symbols."""

    def __init__(self, chars: list[int]):
        self.code = np.full(0x110000, _POINT << 5, np.uint16)
        rest = [c for c in chars if c != 32]
        self.code[rest[28:60]] = (_SHIFT << 5) + np.arange(len(rest[28:60]))
        self.code[rest[:28]] = np.arange(2, 2 + len(rest[:28]))
        self.code[32] = _SPACE

        self.code[10] = _END  # no word has it

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return self.many([words])[0]

    def many(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The symbols of each text, by its words; all at once."""
        if not texts:
            return []
        joined = b"\n".join([b" ".join(words) for words in texts]) + b"\n"
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends, codes = np.flatnonzero(points == 10) + 1, self.code.take(points)
        wide = np.flatnonzero(codes >= 32)
        if len(wide):
            size = np.ones(len(codes), np.int64)
            first = codes[wide] >> 5
            size[wide] = np.where(first == _SHIFT, 2, 6)
            after = np.cumsum(size)
            at = after - size
            out = np.empty(int(after[-1]), np.uint8)
            out[at] = codes
            out[at[wide]] = first
            one, far = wide[first == _SHIFT], wide[first == _POINT]
            out[at[one] + 1] = codes[one] & 31
            for k in range(5):
                out[at[far] + 1 + k] = (points[far] >> np.uint32(20 - 5 * k)) & np.uint32(31)
            ends = after[ends - 1]
        else:
            out = codes.astype(np.uint8)
        return np.split(out, ends[:-1])


def bits_for(tokens: int) -> int:
    """Bits of the tables for so many training tokens: a context for each, between the bounds."""
    return min(MAX_BITS, max(MIN_BITS, (max(1, tokens) - 1).bit_length()))


def contexts(streams: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All symbols, the start of each stream, and of each order the place of each symbol's context in the order's table."""
    return _over(streams, lambda symbols: _contexts(symbols, bits), [np.int32] * (len(ORDERS) + 1))


def _over(streams: list[np.ndarray], find: Callable[[np.ndarray], Iterator[np.ndarray]], types: list[type]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    gap = np.zeros(max(ORDERS), np.uint8)
    sizes = np.array([len(gap) + len(s) for s in streams], np.int64)
    ends = np.cumsum(sizes)
    symbols = np.concatenate([p for s in streams for p in (gap, s)]) if streams else gap
    bases = [np.empty(len(symbols), t) for t in types]
    at = 0
    while at < len(symbols):  # whole streams, of so many symbols that what is at work stays in a core's cache
        stop = int(ends[np.searchsorted(ends, min(at + _PIECE, len(symbols)))]) if streams else len(symbols)
        for base, found in zip(bases, find(symbols[at:stop])):
            base[at:stop] = found
        at = stop
    return symbols, ends - sizes + len(gap), bases


def _contexts(symbols: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for back in ORDERS:
        past = _past(symbols, back)
        yield _place(past, bits) if 5 * back > bits else (past << np.uint64(5)).astype(np.int32)
    yield _place(_word_so_far(symbols), bits)


def _past(symbols: np.ndarray, back: int) -> np.ndarray:
    """The last symbols before each place, five bits each, put together from runs of 1, 2, 4 and so on."""
    out, run = np.zeros(len(symbols), np.uint64), np.zeros(len(symbols), np.uint64)
    run[1:] = symbols[:-1]
    size, have = 1, 0
    while have < back:
        if back & size:
            out[have:] |= run[: len(run) - have] << np.uint64(5 * have)
            have += size
        if have < back:
            run[size:] |= run[:-size] << np.uint64(5 * size)
            size *= 2
    return out


def _place(context: np.ndarray, bits: int) -> np.ndarray:
    return (((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)) << np.uint64(5)).astype(np.int32)


def _opens(symbols: np.ndarray) -> np.ndarray:
    """Where the word begins that each place is in."""
    opens = np.zeros(len(symbols), np.int64)
    opens[1:] = np.where(symbols[:-1] <= _SPACE, np.arange(1, len(symbols)), 0)
    return np.maximum.accumulate(opens)


def _word_so_far(symbols: np.ndarray, opens: np.ndarray | None = None) -> np.ndarray:
    """A hash of the symbols since the last space or end, before each place: a difference of running sums of symbols times powers."""
    up, down = powers(len(symbols) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * down[:-1])))[:-1]
    opens = _opens(symbols) if opens is None else opens
    h = (sums - sums[opens]) * up[opens]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def keys(streams: list[np.ndarray], nr: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols, the start of each stream, and an order's context with the symbol at each place; at places between streams, ``_NONE``.

    The last two symbols of a context, and the symbol, are the last bits, so that keys that differ only there are neighbours.
    """
    low, odd = np.uint64(10), np.uint64(0x9E3779B97F4A7C15)

    def find(symbols: np.ndarray) -> Iterator[np.ndarray]:
        if nr < len(ORDERS):  # older symbols times an odd number: others of as many bits, whose first bits are evenly dealt
            past = _past(symbols, ORDERS[nr])
            older, last = ((past >> low) * odd) & np.uint64((1 << (_KEY_BITS[nr] - 10)) - 1), past & np.uint64(1023)
        else:  # the word without its last two symbols, and these; spaces where it has fewer
            opens = _opens(symbols)
            size = np.arange(len(symbols)) - opens
            older, one, two = np.zeros(len(symbols), np.uint64), np.ones(len(symbols), np.uint64), np.ones(len(symbols), np.uint64)
            older[2:] = _word_so_far(symbols, opens)[:-2] >> np.uint64(74 - _KEY_BITS[nr])
            one[1:], two[2:] = symbols[:-1], symbols[:-2]
            older[size < 2], two[size < 2], one[size < 1] = 0, _SPACE, _SPACE
            last = (two << np.uint64(5)) | one
        yield (((older << low) | last) << np.uint64(5)) | symbols

    symbols, starts, (found,) = _over(streams, find, [np.uint64])
    if streams:
        found[(starts[:, None] - np.arange(1, max(ORDERS) + 1)).ravel()] = _NONE
    else:
        found[:] = _NONE
    return symbols, starts, found


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where values that are in order begin to differ from those before."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values but ``_NONE`` in order, and how often each occurs. The array given is put in order."""
    values.sort()
    values = values[: np.searchsorted(values, _NONE)]
    at = np.flatnonzero(_firsts(values))
    n = np.empty(len(at), np.int32)
    np.subtract(at[1:], at[:-1], out=n[:-1], casting="unsafe")
    n[-1:] = len(values) - at[-1:]
    return values[at], n


def _ranked(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values of so many bits in order, and the number of each value among them: by one sort of values with their places in the last bits."""
    low = max(1, (len(values) - 1).bit_length())
    cut, packed = np.uint64(max(0, bits + low - 64)), values
    if cut:  # bits above the last 15 are left out
        packed = ((values >> (cut + np.uint64(15))) << np.uint64(15)) | (values & np.uint64(0x7FFF))
    at = (np.sort((packed << np.uint64(low)) | np.arange(len(values), dtype=np.uint64)) & np.uint64((1 << low) - 1)).astype(np.intp)
    ordered = values[at]
    if cut and (ordered[1:] < ordered[:-1]).any():  # values that differ only in what was left out
        return np.unique(values, return_inverse=True)
    first = _firsts(ordered)
    numbers = np.empty(len(values), np.int32)
    numbers[at] = np.cumsum(first, dtype=np.int32) - 1
    return ordered[first], numbers


def _nodes(ordered: np.ndarray) -> list[np.ndarray]:
    """At each decision, which of the keys in order are the first that come to it."""
    change = ordered[1:] ^ ordered[:-1]
    return [np.concatenate((np.ones(min(1, len(ordered)), bool), change >= np.uint64(1 << (5 - d)))) for d in range(5)]


def table_sizes(bits: int) -> list[int]:
    return [32 << min(5 * o, bits) for o in ORDERS] + [32 << bits]


def _stretched(counts: np.ndarray) -> np.ndarray:
    """Counts of symbols by context to stretched predictions by node of the five decisions."""
    c = counts.reshape(-1, 32).astype(np.float32)
    out = np.zeros_like(c)
    for d in range(5):
        pairs = c.reshape(len(c), 1 << d, 2, 16 >> d).sum(axis=3)
        out[:, 1 << d : 2 << d] = np.log((pairs[:, :, 1] + np.float32(PRIOR)) / (pairs[:, :, 0] + np.float32(PRIOR)))
    return np.rint(np.clip(out, -10, 10) / UNIT).astype(np.int8).ravel()


def _levels(ordered: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """From the last decision to the first: its number, of each node the first node below, whether a second one is there, and the first key."""
    firsts, below = _nodes(ordered), np.arange(len(ordered))
    for d in reversed(range(5)):
        at = np.flatnonzero(firsts[d][below])
        two = np.diff(np.append(at, len(below))) == 2
        below = below[at]
        yield d, at, two, below


def _runs(ordered: np.ndarray) -> Iterator[slice]:
    """Keys in order by runs of whole contexts that stay in a core's cache."""
    at = 0
    while at < len(ordered):
        stop = int(np.searchsorted(ordered, ((ordered[min(at + _RUN, len(ordered)) - 1] >> np.uint64(5)) + np.uint64(1)) << np.uint64(5)))
        yield slice(at, stop)
        at = stop


def other_sides(ordered: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For different keys in order with their counts, at the five decisions of each key's symbol: the counts of the side it doesn't take."""
    out = np.empty((5, len(ordered)), np.int32 if counts.sum() < 1 << 31 else np.int64)
    for run in _runs(ordered):
        sums = taken = counts[run]
        for d, at, _, first in _levels(ordered[run]):
            sums = np.add.reduceat(sums, at)
            all_ = np.repeat(sums, np.diff(np.append(first, len(taken))))
            out[d, run] = all_ - taken
            taken = all_
    return out


def predictions(ordered: np.ndarray, counts: np.ndarray, others: list[np.ndarray] | None = None) -> np.ndarray:
    """For different keys in order with their counts, the same as ``_stretched`` at the five decisions of each key's symbol, positive where they favour it.

    ``others`` has by decision the counts of the sides that no key takes, one for each node with one node below; else these are 0.
    """
    out, done = np.empty((5, len(ordered)), np.int8), [0] * 5
    for run in _runs(ordered):
        here, sums = ordered[run], counts[run]
        for d, at, two, first in _levels(here):
            left = sums[at]
            right = np.zeros_like(left)
            right[two] = sums[at[two] + 1]
            if others is not None:
                n = len(two) - int(np.count_nonzero(two))
                right[~two] = others[d][done[d] : done[d] + n]
                done[d] += n
            sums = left + right
            swapped = (here[first] >> np.uint64(4 - d)) & np.uint64(1) == 1  # the only node below is a one
            ones, zeros = (np.where(swapped, x, y).astype(np.float32) + np.float32(PRIOR) for x, y in ((left, right), (right, left)))
            x = np.rint(np.clip(np.log(ones / zeros), -10, 10) / UNIT).astype(np.int8)
            sides = ((here >> np.uint64(4 - d)).astype(np.int8) & np.int8(1)) * np.int8(2) - np.int8(1)
            out[d, run] = np.repeat(x, np.diff(np.append(first, len(here)))) * sides
    return out


def score_streams(streams: list[np.ndarray], tables: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
    """Bits of each stream."""
    symbols, starts, bases = contexts(streams, (len(tables[-1]) // 32).bit_length() - 1)

    def look(at: np.ndarray, s: np.ndarray, sign: np.ndarray) -> list[np.ndarray]:
        node = np.empty(sign.shape, np.intp)
        for d in range(5):
            node[:, d] = _NODE[d].take(s)
        return [t.take(node + b.take(at).astype(np.intp)[:, None]).astype(np.float32) for t, b in zip(tables, bases)]

    return _mixed(streams, symbols, starts, look, segment)


def _mixed(streams: list[np.ndarray], symbols: np.ndarray, starts: np.ndarray, look: Callable[..., list[np.ndarray]], segment: int) -> np.ndarray:
    """Bits of each stream. ``look`` has each order's predictions for symbols at some places, given minus the sign of their decisions."""
    owner, begin, end = [], [], []
    for i, (s, at) in enumerate(zip(streams, starts.tolist())):
        for b in range(0, len(s), segment):
            owner.append(i)
            begin.append(at + b)
            end.append(at + min(len(s), b + segment))
    begin, end = np.array(begin, np.int64), np.array(end, np.int64)
    order = np.argsort(begin - end, kind="stable")
    begin, end, owner = begin[order], end[order], np.array(owner)[order]
    n = len(begin)
    # segments are the last axis: what is added up over steps and depths then runs along memory
    weights = [np.full((5, n), w * UNIT, np.float32) for w in START]
    rate = np.float32(RATE * UNIT * UNIT)  # of weights of predictions in units
    scale, offset, bits = np.ones((5, n), np.float32), np.zeros((5, n), np.float32), np.zeros(n)
    lengths, steps = end - begin, np.arange(STEP)[:, None]
    for first in range(0, segment, STEP):
        a = int(np.searchsorted(-lengths, -first, side="left"))  # segments longer than first
        if not a:
            break
        at = begin[:a] + first + steps
        live = at < end[:a]
        np.minimum(at, len(symbols) - 1, out=at)
        s = symbols.take(at)
        sign = np.empty((STEP, 5, a), np.float32)
        for d in range(5):
            sign[:, d] = _SIGN[d].take(s)
        x, z = look(at, s, sign), None
        for k, v in enumerate(x):
            m = v * weights[k][:, :a]
            z = m if z is None else np.add(z, m, out=z)
        e = z * scale[:, :a]
        e += offset[:, :a]
        e *= sign
        np.minimum(e, 60, out=e)
        np.exp(e, out=e)
        total = e + 1
        sign *= e
        sign /= total  # minus what is lacking to certainty, with the sign of the decision
        np.log(total, out=total)
        if not live.all():
            total *= live[:, None]  # a segment that ends here changes its weights for nothing that follows
        bits[:a] += total.sum(axis=(0, 1))
        for k, v in enumerate(x):
            v *= sign
            weights[k][:, :a] -= rate * v.sum(axis=0)
        z *= sign
        scale[:, :a] -= SCALE_RATE * z.sum(axis=0)
        offset[:, :a] -= OFFSET_RATE * sign.sum(axis=0)
    return np.bincount(owner, weights=bits / math.log(2.0), minlength=len(streams)) if n else np.zeros(len(streams))


def count_tokens(training: DataFrame) -> DataFrame:
    """kind (0: word or end, 1: character), key and n over all training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, ends, held, size = np.zeros(0x110000, np.int64), 0, [], 0

        def merged() -> pd.DataFrame:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)
            held.clear()
            return pd.DataFrame({"kind": 0, "key": keys, "n": n})

        for pdf in batches:
            texts = pdf["text"].tolist()
            for rows in chunks(texts):
                _, numbers, hashes, words = tokenised([texts[i] for i in rows])
                ends += len(rows)
                counts = np.bincount(numbers, minlength=len(hashes))
                held.append((hashes, counts))
                size += len(hashes)
                # the characters of each different word, times its count
                offsets = pc.utf8_length(words).to_numpy()
                at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else (0, 0)
                joined = words.buffers()[2][at[0] : at[-1]].to_pybytes() if at[-1] > at[0] else b""
                points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
                here = np.bincount(points, weights=np.repeat(counts, offsets), minlength=1)
                chars[: len(here)] += here.astype(np.int64)
                if size > _CACHE:
                    yield merged()
                    size = 0
        held.append((np.array([END]), np.array([ends])))
        yield merged()
        points = np.flatnonzero(chars)
        yield pd.DataFrame({"kind": 1, "key": points, "n": chars[points]})

    counted = training.select("text").mapInPandas(lean(run), "kind int, key bigint, n bigint")
    return materialise(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"), "tokens")


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in their narrowest type, whose letter comes first, compressed."""
    kind = "b" if values.dtype == np.int8 else next(t for t in "BHIq" if values.max(initial=0) <= np.iinfo(t).max)
    return kind.encode() + pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(held: bytes) -> np.ndarray:
    kind = np.dtype(chr(held[0]))
    return np.frombuffer(pa.decompress(held[1:], decompressed_size=_BLOCK * kind.itemsize, codec="zstd", asbytes=True), kind)


def learn_tables(training: DataFrame, chars: list[int], bits: int) -> list[np.ndarray]:
    """The stretched predictions of each order. Each task counts in tables of fixed size; only touched blocks are sent."""
    sizes = table_sizes(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, counts = Coder(chars), [np.zeros(n + 1, np.int32) for n in sizes]  # the last place is for what is between two texts
        for pdf in batches:
            texts = pdf["text"].tolist()
            for rows in chunks(texts):
                streams = [coder(words_of(texts[i])) for i in rows]
                symbols, starts, bases = contexts(streams, bits)
                between = (starts[:, None] - np.arange(1, max(ORDERS) + 1)).ravel()
                for base, c in zip(bases, counts):
                    places = np.add(base, symbols, dtype=np.intp)
                    places[between] = len(c) - 1
                    np.add.at(c, places, np.int32(1))
        part = TaskContext.get().partitionId() // _FAN
        rows = [(k, b, part, _packed(c)) for k, t in enumerate(counts) for b, c in enumerate(t[:-1].reshape(-1, _BLOCK)) if c.any()]
        if rows:
            yield pd.DataFrame(rows, columns=["nr", "block", "part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BLOCK, np.int64)
        for c in pdf["counts"]:
            total += _unpacked(c)
        return pd.DataFrame({"nr": [pdf["nr"].iloc[0]], "block": [pdf["block"].iloc[0]], "part": [0], "counts": [_packed(total)]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _unpacked(add(pdf)["counts"].iloc[0])
        return pd.DataFrame({"nr": [pdf["nr"].iloc[0]], "block": [pdf["block"].iloc[0]], "values": [_packed(_stretched(total))]})

    tables = [np.zeros(n, np.int8) for n in sizes]
    kind = "nr int, block int, part int, counts binary"
    sent = training.select("text").mapInPandas(lean(run), kind)
    # in two levels, so that no task gets a block from every other one
    added = sent.groupBy("nr", "block", "part").applyInPandas(add, kind).groupBy("nr", "block").applyInPandas(finish, "nr int, block int, values binary")
    for r in added.collect():  # a byte a slot at most
        tables[r.nr][r.block * _BLOCK : (r.block + 1) * _BLOCK] = _unpacked(r["values"])
    return tables


def _squeezed(parts: list[np.ndarray]) -> bytes:
    """Arrays of bytes, each compressed by itself, as its own frequencies have it: how many, their sizes and compressed sizes, and these bytes."""
    held = [pa.compress(np.ascontiguousarray(p), codec="zstd", asbytes=True) for p in parts]
    return bytes([len(parts)]) + np.array([[len(p), len(h)] for p, h in zip(parts, held)], "<u4").tobytes() + b"".join(held)


def _unsqueezed(held: bytes, at: int = 0) -> tuple[list[np.ndarray], int]:
    """What ``_squeezed`` made, and where it ends."""
    out, sizes = [], np.frombuffer(held, "<u4", 2 * held[at], at + 1).reshape(-1, 2).tolist()
    at += 1 + 8 * len(sizes)
    for n, size in sizes:
        out.append(np.frombuffer(pa.decompress(held[at : at + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8))
        at += size
    return out, at


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte: first all lowest bytes."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return _squeezed(list(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T))


def _from_planes(held: bytes, at: int = 0) -> np.ndarray:
    planes, _ = _unsqueezed(held, at)
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.view("<u8").ravel()


def _small(parts: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers that mostly fit in a byte: bytes, and apart those from 255."""
    large = np.concatenate([p[p >= 255] for p in parts])
    return _squeezed([np.minimum(p, 255).astype(np.uint8) for p in parts]) + (_planes(large) if len(large) else b"")


def _from_small(held: bytes) -> list[np.ndarray]:
    parts, end = _unsqueezed(held)
    out, large, at = [p.astype(np.int64) for p in parts], _from_planes(held, end) if end < len(held) else None, 0
    for p in out:
        many = np.flatnonzero(p == 255)
        if len(many):
            p[many] = large[at : at + len(many)]
            at += len(many)
    return out


def _trimmed(run: Callable[..., pa.Table], *args: pa.Table) -> pa.Table:
    """What ``run`` makes of a group, with memory given back."""
    return list(lean(lambda groups: (run(*g) for g in groups))(iter([args])))[0]


def ask(texts: DataFrame, chars: list[int], bits: int) -> DataFrame:
    """nr, part, chunk, values: what each chunk needs for the predictions of its keys.

    ``texts`` has chunk and held, packed rows with text and __learn (whether the text is counted); each chunk fits in a task.
    Chunks below 0 ask for nothing. The keys of an order are dealt by their first ``bits`` bits into parts.
    A chunk gets the counts of its keys and of the sides of decisions that none of its keys takes.
    """
    kind = "nr int, part int, chunk bigint, held binary, counts binary"
    made, answers = to_arrow_schema(StructType.fromDDL(kind)), "nr int, part int, chunk bigint, values binary"
    answered = to_arrow_schema(StructType.fromDDL(answers))

    def send(group: pa.Table) -> pa.Table:
        coder, streams = Coder(chars), ([], [])
        for held in group["held"]:
            rows = _opened(held.as_py())
            for learn in (False, True):
                texts_ = rows["text"].filter(pc.equal(rows["__learn"], learn)).to_pylist()
                for some in chunks(texts_):
                    streams[learn].extend(coder.many([words_of(texts_[i]) for i in some]))
        chunk, rows = group["chunk"][0].as_py(), []
        for nr, size in enumerate(_KEY_BITS):
            # an order and a side at a time, as keys take eight bytes a symbol
            (other, _), (found, counts) = (_distinct(keys(side, nr)[2]) for side in streams)
            if len(other):  # keys that only the others have come in between, with a count of 0
                at = np.searchsorted(found, other)
                new = found[np.minimum(at, len(found) - 1)] != other if len(found) else np.ones(len(other), bool)
                found, counts = np.insert(found, at[new], other[new]), np.insert(counts, at[new], 0)
            part_bits = min(bits, size)
            bases = np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(size + 5 - part_bits)
            cuts = [*np.searchsorted(found, bases).tolist(), len(found)]
            # keys from their part's first one on, as differences
            rows += [(nr, p, chunk, _planes(np.diff(found[a:b], prepend=bases[p])), _planes(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), made.types)], schema=made)

    def answer(group: pa.Table) -> pa.Table:
        nr, part, chunks_ = group["nr"][0].as_py(), group["part"][0].as_py(), group["chunk"].to_pylist()
        held = [np.cumsum(_from_planes(x.as_py()), dtype=np.uint64) for x in group["held"]]
        found, numbers = _ranked(np.concatenate(held), _KEY_BITS[nr] + 5 - min(bits, _KEY_BITS[nr]))
        counts = np.bincount(numbers, weights=np.concatenate([_from_planes(n.as_py()) for n in group["counts"]]), minlength=len(found)).astype(np.int64)
        others, rows, at = other_sides(found, counts), [], 0
        for chunk, own in zip(chunks_, held):
            if chunk >= 0:
                mine = numbers[at : at + len(own)]
                sides = [others[d].take(mine[first[~two]]) for d, _, two, first in _levels(own)]
                rows.append((nr, part, chunk, _small([counts[mine], *sides])))
            at += len(own)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, answered.types)], schema=answered)

    sent = texts.groupBy("chunk").applyInArrow(lambda group: _trimmed(send, group), kind)
    return sent.groupBy("nr", "part").applyInArrow(lambda group: _trimmed(answer, group), answers)


def score_chunk(texts: list[str | None], coder: Coder, answers: pa.Table, bits: int, segment: int = SEGMENT) -> np.ndarray:
    """Bits of each text of a chunk, by the predictions that ``ask`` gave for it."""
    pieces, out = [], np.zeros(len(texts))
    for rows in chunks(texts):
        streams = coder.many([words_of(texts[i]) for i in rows])
        pieces.append((rows, streams, [], []))
    parts, nrs, values = answers["part"].to_numpy(), answers["nr"].to_numpy(), answers["values"]
    for nr, size in enumerate(_KEY_BITS):
        windows = []
        for _, streams, numbers, own in pieces:
            found, n = keys(streams, nr)[2], 0
            where, here, ahead = np.zeros(len(found), np.uint16), [], []
            for a in range(0, len(found), _RANK):
                live = found[a : a + _RANK] != _NONE
                mine, number = _ranked(found[a : a + _RANK][live], size + 5)
                where[a : a + _RANK][live] = number
                here.append(mine)
                ahead.append(n)
                n += len(mine)
            numbers.append((where, np.array(ahead)))
            own.append(np.empty(n, np.uint64))
            windows += zip(here, np.split(own[nr], np.cumsum([len(x) for x in here])[:-1]))
        blobs = {int(parts[i]): values[i].as_py() for i in np.flatnonzero(nrs == nr).tolist()}
        part_bits = min(bits, size)
        range_bits = min(part_bits, _RANGE_BITS)
        low, width = np.uint64(size + 5 - range_bits), size + 5 - part_bits
        cuts = [np.append(np.searchsorted(x, np.arange(1 << range_bits, dtype=np.uint64) << low), len(x)) for x, _ in windows]
        for r in range(1 << range_bits):  # the same range of keys of all windows
            here = [(x[c[r] : c[r + 1]], v[c[r] : c[r + 1]]) for (x, v), c in zip(windows, cuts) if c[r] < c[r + 1]]
            if not here:
                continue
            mine, number = _ranked(np.concatenate([x for x, _ in here]) - (np.uint64(r) << low), int(low))
            known, first = np.zeros((len(mine), 8), np.int8), r << (part_bits - range_bits)
            ends = [*np.searchsorted(mine, np.arange(1 << (part_bits - range_bits), dtype=np.uint64) << np.uint64(width)).tolist(), len(mine)]
            for part, (a, b) in enumerate(zip(ends, ends[1:]), first):
                if a < b:
                    given, *sides = _from_small(blobs[part])
                    known[a:b, :5] = -predictions(mine[a:b], given, sides[::-1]).T
            got, at = known.view(np.uint64).ravel()[number], 0
            for x, v in here:
                v[:] = got[at : at + len(x)]
                at += len(x)
    gap = np.zeros(max(ORDERS), np.uint8)
    for rows, streams, numbers, own in pieces:

        def look(at: np.ndarray, s: np.ndarray, sign: np.ndarray, numbers: list = numbers, own: list = own) -> list[np.ndarray]:
            window = at // _RANK
            found = [v.take(ahead.take(window) + n.take(at)).view(np.int8).reshape(*at.shape, 8) for (n, ahead), v in zip(numbers, own)]
            out = [np.empty_like(sign) for _ in found]
            for v, x in zip(found, out):
                for d in range(5):
                    np.multiply(v[:, :, d], sign[:, d], out=x[:, d])
            return out

        sizes = np.array([len(gap) + len(s) for s in streams], np.int64)
        symbols = np.concatenate([p for s in streams for p in (gap, s)])
        out[rows] = _mixed(streams, symbols, np.cumsum(sizes) - sizes + len(gap), look, segment)
        numbers.clear()
        own.clear()
    return out


_ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def score(docs: DataFrame, training: DataFrame | Column, segment: int = SEGMENT) -> DataFrame:
    """The input's columns but the text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``training`` is a table with a text, or a condition on the rows of ``docs``, which then are coded and counted in one go.
    Null texts are empty: their only token is the end, and bits_per_byte, of the words joined by single
    spaces, is null as for texts without words. Rows are told apart by doc_id and text, so that equal
    rows get equal results. No training texts: every count is 0. Texts are taken whole. Input columns
    of the added names are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    within = isinstance(training, Column)
    docs = docs.withColumn("__learn", F.coalesce(training, F.lit(False)) if within else F.lit(False))
    training = docs.where("__learn") if within else training
    counts = count_tokens(training)
    words, chars = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()[0]
    n_all, vocabulary = total.n or 0, total.v or 0
    top = [r.key for r in chars.orderBy(F.desc("n"), "key").limit(61).collect()]
    whole = n_all > 1 << MAX_BITS  # then no tables that fit in a task have a place for each context
    shared = spark.sparkContext.broadcast((top, None if whole else learn_tables(training, top, bits_for(n_all))))  # 32 << MAX_BITS bytes an order at most

    # the least count that at most FREQUENT words reach; counts are few, words are not
    room, least = FREQUENT, 1 << 62
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(FREQUENT).collect():
        room -= r.words
        if room < 0:
            break
        least = r.n
    often = words.where(F.col("n") >= least).toPandas().sort_values("key")
    frequent = spark.sparkContext.broadcast((often["key"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))
    base_total = math.log10(n_all + vocabulary + 1)
    docs = fresh(docs, *_ADDED).withColumn("__th", F.xxhash64("text"))

    def start():
        keys, n = frequent.value
        logs = np.append(np.log10(n + 1.0), np.nan)
        chars_here, tables = shared.value
        coder = Coder(chars_here)

        def looked_up(hashes: np.ndarray) -> np.ndarray:
            """Log counts of frequent words, nan for the others."""
            at = np.searchsorted(keys, hashes)
            at[at == len(keys)] = 0
            return logs[np.where(keys[at] == hashes, at, len(keys))] if len(keys) else np.full(len(hashes), np.nan)

        def work(texts: list[str | None], answers: pa.Table | None = None, part_bits: int = 0) -> dict[str, list]:
            whole_bits = None if answers is None else score_chunk(texts, coder, answers, part_bits, segment)
            out: dict[str, list] = {c: [] for c in ("n_tokens", "__often", "__base", "__rare", "score", "bits_per_byte")}
            for rows in chunks(texts):
                here = [texts[i] for i in rows]
                starts, numbers, hashes, _ = tokenised(here)
                # the end follows each text's words
                numbers = np.insert(numbers, starts[1:], len(hashes))
                hashes = np.append(hashes, END)
                starts = starts + np.arange(len(starts))
                values = looked_up(hashes)[numbers]
                rare = np.isnan(values)
                known = np.add.reduceat(np.where(rare, 0.0, values), starts[:-1])
                often = np.add.reduceat((~rare).astype(np.int64), starts[:-1])
                cuts = np.concatenate(([0], np.cumsum(rare)))[starts]
                lost, tokens = hashes[numbers[rare]], np.diff(starts)
                out["n_tokens"] += tokens.tolist()
                out["__often"] += often.tolist()
                out["__base"] += (known - tokens * base_total).tolist()
                out["__rare"] += [lost[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                split = [words_of(t) for t in here]
                bits = score_streams([coder(w) for w in split], tables, segment) if whole_bits is None else whole_bits[rows]
                out["score"] += (-bits * _LOG10_2).tolist()
                out["bits_per_byte"] += [b / (sum(map(len, w)) + len(w) - 1) if w else None for b, w in zip(bits.tolist(), split)]
            return out

        return work

    added = "n_tokens bigint, __often bigint, __base double, __rare array<bigint>, score double, bits_per_byte double"
    if whole:
        scored = _by_chunks(docs, None if within else training, top, start, added)
    else:
        scored = extended(docs, ["text"], start, added, drop=["text", "__learn"])
    scored = materialise(scored, "scored")
    # a marker in each row tells how often equal rows have been counted
    rare = scored.where(F.size("__rare") > 0).select("doc_id", "__th", F.posexplode("__rare").alias("at", "key"))
    joined = rare.join(words.where(F.col("n") < least), "key", "left")
    sums = joined.groupBy("doc_id", "__th").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more"),
        F.count("n").alias("found"),
        F.sum((F.col("at") == 0).cast("bigint")).alias("rows"),
    ).select("doc_id", "__th", (F.col("more") / F.col("rows")).alias("more"), (F.col("found") / F.col("rows")).cast("bigint").alias("found"))
    left, more = scored.alias("l"), sums.alias("s")
    same = F.col("l.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("l.__th").eqNullSafe(F.col("s.__th"))
    keep = [F.col(f"l.`{c}`") for c in docs.columns if c not in ("text", "__th", "__learn")]
    return left.join(more, same, "left").select(
        *keep, "l.n_tokens", (F.col("l.__often") + F.coalesce("s.found", F.lit(0))).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("l.__base") + F.coalesce("s.more", F.lit(0.0))).alias("base_score"), "l.score", "l.bits_per_byte",
    )


def _frequencies(texts: pa.Array) -> np.ndarray:
    """How often each byte occurs in the first characters of each text: roots of shares, in whole numbers, so that no machine rounds sums in its own way."""
    heads = pc.fill_null(pc.utf8_slice_codeunits(texts, 0, HEAD), "").cast(pa.large_binary())
    out = np.empty((len(heads), 256))
    for a in range(0, len(heads), 256):
        here = heads[a : a + 256]
        offsets = np.frombuffer(here.buffers()[1], np.int64)[here.offset : here.offset + len(here) + 1]
        sizes, data = np.diff(offsets), np.frombuffer(here.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        n = np.bincount(np.repeat(np.arange(len(here)) * 256, sizes) + data, minlength=len(here) * 256).reshape(-1, 256)
        out[a : a + 256] = np.rint(np.sqrt(n / np.maximum(1, sizes)[:, None]) * 1000)
    return out


def _nearest(found: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return ((kinds * kinds).sum(axis=1) - 2.0 * (found @ kinds.T)).argmin(axis=1)


def kinds_of(texts: list[str], most: int) -> np.ndarray:
    """Middles of so many kinds of texts at most, from the one farthest of all others on."""
    found = _frequencies(pa.array(texts, pa.large_string()))
    if not len(found):
        return np.zeros((1, 256))
    kinds = found[:1]
    while len(kinds) < most:
        far = ((found[:, None, :] - kinds[None]) ** 2).sum(axis=2).min(axis=1)
        if not far.max():
            break
        kinds = np.concatenate((kinds, found[far.argmax()][None]))
    for _ in range(10):
        own = _nearest(found, kinds)
        kinds = np.stack([np.rint(found[own == k].mean(axis=0)) if (own == k).any() else kinds[k] for k in range(len(kinds))])
    return kinds


def _opened(held: bytes) -> pa.Table:
    """Rows that ``pack`` packed."""
    return pa.ipc.open_stream(pa.decompress(held[8:], decompressed_size=int.from_bytes(held[:8], "little"), codec="zstd")).read_all()


def pack(texts: DataFrame, kinds: np.ndarray, groups: np.ndarray, learned: bool = False) -> DataFrame:
    """chunk and held: rows by kind of text and __deal, many together under zstd. Chunks are numbered from 0, or if learned from -1 down."""
    first = np.cumsum(groups) - groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, to, size = [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows, chunk = pa.Table.from_batches(held).combine_chunks(), np.concatenate(to)
            order = np.argsort(chunk, kind="stable")
            lengths = pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy().astype(np.int64)[order]
            cuts = np.flatnonzero(_firsts(chunk[order]) | _firsts(np.cumsum(lengths) // _PACKED)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_table(rows.take(order[a:b]))
                buffer = sink.getvalue()
                found = buffer.size.to_bytes(8, "little") + pa.compress(buffer, codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([chunk[order[a]]], pa.int64()), pa.array([found], pa.binary())], names=["chunk", "held"])
            held.clear()
            to.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, at = _nearest(_frequencies(batch["text"]), kinds), batch.schema.get_field_index("__deal")
            chunk = first[kind] + batch["__deal"].to_numpy() % groups[kind]
            to.append(-1 - chunk if learned else chunk)
            held.append(pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], names=[f for i, f in enumerate(batch.schema.names) if i != at]))
            size += batch.nbytes
            if size > GROUP:
                yield from sent()
                size = 0
        if held:
            yield from sent()

    return texts.mapInArrow(lean(run), "chunk bigint, held binary")


def _by_chunks(docs: DataFrame, training: DataFrame | None, chars: list[int], start: Callable[[], Callable[..., dict[str, list]]], added: str) -> DataFrame:
    """The columns of ``docs`` but the text, and the added ones, by chunks of texts and the predictions for each.

    Texts of one kind, by the frequencies of their bytes, meet in the same chunks: they share more contexts, of which there then are fewer to send.
    """
    docs = docs.withColumn("__deal", F.shiftrightunsigned(F.xxhash64("doc_id", "__th"), 1))
    sides = [docs]
    if training is not None:
        sides.append(training.select("text", F.lit(True).alias("__learn"), F.shiftrightunsigned(F.xxhash64(*[c for c in ("doc_id", "text") if c in training.columns]), 1).alias("__deal")))
    rows, n = docs.agg(F.count("*"), F.sum(F.length("text"))).collect()[0]
    some = docs.where(F.col("__deal") % max(1, rows // SAMPLE) == 0).select(F.substring("text", 1, HEAD).alias("text")).where("text <> ''").limit(2 * SAMPLE).collect()
    kinds = kinds_of(sorted(r.text for r in some), min(KINDS, max(1, (n or 0) // (2 * GROUP))))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(kinds), np.int64)
        for batch in batches:
            total += np.bincount(_nearest(_frequencies(batch["text"]), kinds), weights=batch["n"].to_numpy(), minlength=len(kinds)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kinds))), pa.array(total)], names=["kind", "n"])

    packed, all_ = [], 0
    for i, side in enumerate(sides):
        heads = side.select(F.substring("text", 1, HEAD).alias("text"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
        total = np.zeros(len(kinds), np.int64)
        for r in heads.mapInArrow(sizes, "kind bigint, n bigint").groupBy("kind").agg(F.sum("n").alias("n")).collect():
            total[r.kind] = r.n
        packed.append(pack(side, kinds, np.maximum(1, -(-total // GROUP)), learned=i > 0))
        all_ += int(total.sum())
    bits = max(0, -(-all_ // PART) - 1).bit_length()
    asked = ask(packed[0] if training is None else packed[0].unionByName(packed[1]), chars, bits)
    kept = [f for f in docs.schema if f.name not in ("text", "__learn", "__deal")]
    out = StructType(kept + list(StructType.fromDDL(added)))
    arrow = to_arrow_schema(out)

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        rows = pa.concat_tables(_opened(held.as_py()) for held in left["held"])
        found = start()(rows["text"].to_pylist(), right, bits)
        return pa.Table.from_arrays([rows[f.name] if f.name in rows.column_names else pa.array(found[f.name], t) for f, t in zip(out, arrow.types)], names=arrow.names)

    return packed[0].groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(lambda left, right: _trimmed(made, left, right), out)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 7))
    return score(docs, ~F.col("held_out")).select("doc_id", "held_out", *_ADDED[:5], "bits_per_byte")
