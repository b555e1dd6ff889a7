"""Words, lines and their hashes of a whole Arrow batch of texts, as numpy arrays.

A word is a maximal run of bytes other than the six ASCII white space characters; UTF-8
keeps those bytes out of every other character, so whole batches are cut without decoding.
Nulls and empty texts have no words. All functions work on one batch of bounded size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
LONG = 1024


def tidy(run: Callable) -> Callable:
    """A task over Arrow batches that leaves no freed memory with its worker.

    Workers wait for their next task with what the allocators have kept, while the JVM beside
    them may need it.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


@dataclass
class Words:
    """Cut texts: word ``i`` is ``data[starts[i]:ends[i]]`` and belongs to text ``text[i]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def cut_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return cut_runs(data, offsets, ~is_space(data))


def cut_runs(data: np.ndarray, offsets: np.ndarray, inner: np.ndarray) -> Words:
    """The maximal runs of marked bytes, none across the end of a text."""
    begins, ends = inner.copy(), inner.copy()
    if len(data):
        begins[1:] &= ~inner[:-1]
        ends[:-1] &= ~inner[1:]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = inner[heads]
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = inner[offsets[1:][np.diff(offsets) > 0] - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], U64)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes of all ranges at a time; long ones singly."""
    import xxhash

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    left = (ends - starts).astype(np.int64)
    out = mix(left.astype(U64) + U64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(left > LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].data)
    live, at = np.flatnonzero((left > 0) & (left <= LONG)), starts
    at = at[live]
    rest = left[live]
    while len(live):
        out[live] = mix((out[live] + U64(0x632BE59BD9B4E019)) ^ (eights[at] & _KEEP[np.minimum(rest, 8)]))
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    return out


def hash_words(words: Words) -> np.ndarray:
    return hash_ranges(words.data, words.starts, words.ends)


def hash_runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every ``length`` consecutive entries, by the place of the first.

    The last ``length - 1`` places are filled with runs that wrap round; callers leave out
    runs that cross the end of a text.
    """
    out = np.zeros(len(hashes), U64)
    for k in range(length):
        out += mix(np.roll(hashes, -k) + U64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
    return mix(out)


def run_fits(words: Words, length: int) -> np.ndarray:
    """Whether ``length`` words from this place on lie in one text."""
    room = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))
    return room >= length


def covered(begins: np.ndarray, length: int) -> np.ndarray:
    """Marks every entry that lies within ``length`` entries from a marked begin."""
    steps = np.zeros(len(begins) + length + 1, np.int64)
    at = np.flatnonzero(begins)
    steps[at] += 1
    np.subtract.at(steps, at + length, 1) if len(at) else None
    return np.cumsum(steps)[: len(begins)] > 0
