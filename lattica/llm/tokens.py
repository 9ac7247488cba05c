"""Words of many texts at once: split, numbered and hashed in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters of a run of texts that are worked on together, about.
CHUNK = 800_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


#: Longer words are hashed one by one: sums of powers modulo 2^64 have known collisions among long strings.
_LONG = 256


def hash_words(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes: of all bytes at once, as differences of a running sum of bytes times powers."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1])))
    h = spread((sums[offsets[1:]] - sums[offsets[:-1]]) * up[offsets[:-1]])
    for i in np.flatnonzero(np.diff(offsets) > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    return h.view(np.int64)


def tokenised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Where each text's words start (and the last ends), the words' numbers, the numbered words' hashes and the words."""
    low = pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    split = pc.ascii_split_whitespace(low)
    starts, words = split.offsets.to_numpy().astype(np.int64), split.flatten()
    real = pc.binary_length(words).to_numpy() > 0
    if not real.all():
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        words = words.filter(pa.array(real))
    coded = words.dictionary_encode()
    return starts, coded.indices.to_numpy(), hash_words(coded.dictionary), coded.dictionary


def chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Rows in runs of about CHUNK characters."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run
