"""Substring deduplication by hashed windows, in place of relative Lempel-Ziv factors.

A word is removed where a stretch of ``window`` words covers it that a document with a smaller id
has too. Greedy factors (reference document, place, length) against those documents would mark the
same words once the windows across factor ends are asked for as well, but need the reference's words
at hand to grow a match; hashes of windows need only the answer whether a window is there. So no
factor, place or length is made. The reference is indexed in blocks and never held in one place:

1. Documents are put into chunks of about CHUNK_BYTES of text, written once.
2. Each window has an anchor, its ``seed``-word run with the smallest hash, which equal windows
   share. A chunk sends its distinct anchors to reference blocks dealt by hash; a block answers
   with one bit for each: whether another chunk has it too. Where no other document has the
   anchor, no factor can begin, and the window is done.
3. Of the windows left a chunk sends each distinct one once, with its smallest document, to the
   blocks that index windows; the answer is one bit: whether a smaller document elsewhere has it.
4. The words of all windows that a smaller document has are removed. Every window of a document is
   judged, so text that continues in another reference document is not lost at the boundary.

Equal passages are folded to one entry per chunk before anything is shuffled, so a passage that a
third of all documents share costs one entry per chunk. Blocks are sized by the number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from crewlytics.llm.scratch import stored
from crewlytics.llm.text_arrays import bytes_of, covered, cut_words, hash_runs, hash_words, run_fits, tidy
from crewlytics.llm.tokens import slices

WINDOW, SEED = 13, 6
CHUNK_BYTES = 4 << 20
BLOCK_ENTRIES = 1 << 20  # entries that a reference block holds on average
FEWEST_BLOCKS = 64
NO_ID = np.iinfo(np.int64).max


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def chunked(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, rows): whole rows of ``docs`` in compressed packets, none of them cut."""
    at = docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def packet(held):
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1], pa.int64()), pa.array([_packed(whole)], pa.binary())], ["chunk", "rows"]
            )

        held, size = [], 0
        for whole in batches:
            for part in slices(whole, at, CHUNK_BYTES):
                room = bytes_of(part.column(at))[1][-1]
                if held and size + room > CHUNK_BYTES:
                    yield packet(held)
                    held, size = [], 0
                held.append(part)
                size += room
        if held:
            yield packet(held)

    return docs.mapInArrow(run, "chunk long, rows binary")


class Chunk:
    """The words, windows and anchors of one packet; the same at every step."""

    def __init__(self, rows: pa.RecordBatch, id: str, text: str, window: int, seed: int):
        self.rows, self.window = rows, window
        texts = rows.column(rows.schema.get_field_index(text))
        self.words = cut_words(*bytes_of(texts))
        ids = rows.column(rows.schema.get_field_index(id)).cast(pa.int64())
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        hashes, owner = hash_words(self.words), self.ids[self.words.text]
        seeds = hash_runs(hashes, seed)
        self.at = np.flatnonzero(run_fits(self.words, window) & (owner != NO_ID))
        self.owner = owner[self.at]
        anchor = seeds[self.at]
        for k in range(1, window - seed + 1):
            np.minimum(anchor, seeds[self.at + k], out=anchor)
        self.anchors, self.anchor_of = np.unique(anchor, return_inverse=True)
        low = np.full(len(self.anchors), NO_ID)
        high = np.full(len(self.anchors), np.iinfo(np.int64).min)
        np.minimum.at(low, self.anchor_of, self.owner)
        np.maximum.at(high, self.anchor_of, self.owner)
        self.shared_here = low < high
        self.hashes = hashes

    def candidates(self, elsewhere: np.ndarray) -> None:
        """Keeps the windows whose anchor another document has; folds equal ones."""
        pick = (self.shared_here | elsewhere)[self.anchor_of]
        self.at, self.owner = self.at[pick], self.owner[pick]
        keys = hash_runs(self.hashes, self.window)[self.at]
        self.keys, first, self.key_of = np.unique(keys, return_index=True, return_inverse=True)
        second = hash_runs(self.hashes ^ np.uint64(0xA5A5A5A55A5A5A5A), self.window)
        self.checks = (second[self.at[first]] >> np.uint64(32)).astype(np.uint32)
        self.low = np.full(len(self.keys), NO_ID)
        np.minimum.at(self.low, self.key_of, self.owner)

    def removed(self, elsewhere: np.ndarray) -> np.ndarray:
        """Marks the words of all duplicate spans."""
        found = elsewhere[self.key_of] | (self.low[self.key_of] < self.owner)
        begins = np.zeros(len(self.hashes), bool)
        begins[self.at[found]] = True
        return covered(begins, self.window)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The reference block of each sorted key: a range of hashes."""
    return np.searchsorted(keys >> np.uint64(32), np.arange(1, blocks, dtype=np.uint64) * np.uint64(2**32 // blocks))


def _messages(chunk: int, arrays: list[np.ndarray], blocks: int):
    """(block, chunk, data) rows: each block's stretch of arrays that are sorted by the first."""
    cuts = np.r_[0, _block(arrays[0], blocks), len(arrays[0])]
    rows = [
        (b, chunk, b"".join(a[cuts[b] : cuts[b + 1]].tobytes() for a in arrays))
        for b in np.flatnonzero(np.diff(cuts)).tolist()
    ]
    kinds = (pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "chunk", "data"]
    )


def _answers(keys: np.ndarray, blocks: int, bits: list[dict]) -> np.ndarray:
    """The bits of all blocks in the order of the chunk's keys."""
    cuts = np.r_[0, _block(keys, blocks), len(keys)]
    out = np.zeros(len(keys), bool)
    for answer in bits or []:
        b = answer["block"]
        n = cuts[b + 1] - cuts[b]
        out[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=n)
    return out


def _replies(chunks: list[int], marks: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bits": [np.packbits(m).tobytes() for m in marks]})


def _anchor_block(key: tuple, table: pa.Table) -> pa.Table:
    """Which anchors of each chunk are in another chunk too."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    several = values[counts > 1]
    marks = []
    for p in parts:
        at = np.minimum(np.searchsorted(several, p), max(len(several) - 1, 0))
        marks.append(several[at] == p if len(several) else np.zeros(len(p), bool))
    out = _replies(table.column("chunk").to_pylist(), marks)
    return out.append_column("block", pa.array([key[0].as_py()] * len(marks), pa.int32())).select(["chunk", "block", "bits"])


def _window_block(key: tuple, table: pa.Table) -> pa.Table:
    """Which windows of each chunk a smaller document has elsewhere."""
    parts = table.column("data").to_pylist()
    sizes = [len(x) // 20 for x in parts]
    keys = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(parts, sizes, strict=True)])
    low = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(parts, sizes, strict=True)])
    checks = np.concatenate([np.frombuffer(x, np.uint32, n, 16 * n) for x, n in zip(parts, sizes, strict=True)])
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    heads = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    least = np.minimum.reduceat(low[order], heads)
    smaller = np.zeros(len(keys), bool)
    smaller[order] = np.repeat(least, np.diff(np.r_[heads, len(k)])) < low[order]
    out = _replies(table.column("chunk").to_pylist(), np.split(smaller, np.cumsum(sizes)[:-1]))
    return out.append_column("block", pa.array([key[0].as_py()] * len(parts), pa.int32())).select(["chunk", "block", "bits"])


def _asked(messages: DataFrame, block) -> DataFrame:
    """All answers of a chunk in one row; their number is that of the blocks it asked."""
    answers = messages.groupBy("block").applyInArrow(block, "chunk long, block int, bits binary")
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("block", "bits")).alias("bits"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with every word removed that a window covers which starts in a smaller document.

    All columns of ``docs`` stay, with the text cut; ``n_words`` and ``n_removed`` (long) are
    added, or replace columns of that name. Words are runs without ASCII white space; windows are
    judged on the input. Removing a run of words also removes the white space after it, and a text
    without duplicate spans stays as it is, null included. The id must be an integer; rows with a
    null id neither lose words nor cause others to. Repeated rows have one id and keep their
    words from each other. Texts of any length are read whole; no documents give no rows.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed")]
    names = [f.name for f in kept]
    packets = stored(chunked(docs.select(names), text), "chunks")
    entries = packets.count() * (CHUNK_BYTES // 24)
    blocks = FEWEST_BLOCKS
    while blocks * BLOCK_ENTRIES < entries:
        blocks *= 2

    @tidy
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = Chunk(_unpacked(blob), id, text, window, seed)
                cuts = np.r_[0, _block(chunk.anchors, blocks), len(chunk.anchors)]
                short = _short(chunk.anchors, blocks)
                rows = [
                    (b, number, short[cuts[b] : cuts[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cuts)).tolist()
                ]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        ["block", "chunk", "data"],
                    )

    @tidy
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = Chunk(_unpacked(blob), id, text, window, seed)
                chunk.candidates(_answers(chunk.anchors, blocks, bits))
                yield _messages(number, [chunk.keys, chunk.low, chunk.checks], blocks)

    @tidy
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, bits, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = Chunk(_unpacked(blob), id, text, window, seed)
                chunk.candidates(_answers(chunk.anchors, blocks, bits))
                yield _cut(chunk, chunk.removed(_answers(chunk.keys, blocks, more)), text)

    asked = stored(_asked(packets.mapInArrow(anchors, MESSAGE), _anchor_block), "anchor-bits")
    first = packets.join(asked, "chunk", "left")
    found = stored(_asked(first.select("chunk", "rows", "bits").mapInArrow(windows, MESSAGE), _window_block), "window-bits")
    both = first.join(found.withColumnRenamed("bits", "more"), "chunk", "left")
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return both.select("rows", "bits", "more").mapInArrow(parsed, schema)


MESSAGE = "block int, chunk long, data binary"


def _short(keys: np.ndarray, blocks: int) -> np.ndarray:
    """32 bits of each key from below those that name its block."""
    return (keys >> np.uint64(max(0, 32 - blocks.bit_length() + 1))).astype(np.uint32)


def _cut(chunk: Chunk, gone: np.ndarray, text: str) -> pa.RecordBatch:
    """The packet's rows with the marked words cut out of their texts."""
    words, rows = chunk.words, chunk.rows
    n_removed = np.diff(np.r_[0, np.cumsum(gone)][words.first])
    at = rows.schema.get_field_index(text)
    texts = rows.column(at)
    if gone.any():
        out = texts.to_pylist()
        raw = words.data.tobytes()
        for i in np.flatnonzero(n_removed).tolist():
            a, b = words.first[i], words.first[i + 1]
            stay = np.flatnonzero(np.diff(np.r_[True, gone[a:b], True].astype(np.int8)))
            # runs of kept words: from the first one's start to the start of the word behind the run
            pieces = []
            for head, tail in zip(stay[::2].tolist(), stay[1::2].tolist(), strict=True):
                begin = words.offsets[i] if head == 0 else words.starts[a + head]
                end = words.offsets[i + 1] if a + tail == b else words.starts[a + tail]
                pieces.append(raw[begin:end])
            out[i] = b"".join(pieces).decode("utf-8")
        texts = pa.array(out, rows.schema.field(at).type)
    columns = [texts if k == at else c for k, c in enumerate(rows.columns)]
    columns += [pa.array(words.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "n_words", "n_removed"])
