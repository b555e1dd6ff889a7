"""Best-fit packing by patterns of lengths and non-negative least squares.

The lengths of all pieces form a histogram of at most ``max_len`` counts, the only thing that
reaches the driver. Patterns of up to three lengths that fill a sequence are enumerated over
length classes, their repeat counts fitted to the histogram by non-negative least squares and
rounded. Each pattern is then filled with real lengths of its classes that leave no gap; what is
left over is packed best-fit decreasing. All of this works on counts of equal lengths, so the
plan's size depends on ``max_len`` and not on the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewlytics.llm.scratch import stored
from crewlytics.llm.text_arrays import tidy
from crewlytics.llm.tokens import encoder, slices

CLASSES = 128  # length classes that patterns are enumerated over
SHARES = (1.0, 0.75, 0.5, 0.25)  # of the fitted repeats; fewer leave more to best fit


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """The non-negative x with the least |a x - b|, by active sets."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    small = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        best = int(slope.argmax())
        if slope[best] <= small:
            break
        active[best] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 1e-12)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def patterns(classes: int) -> np.ndarray:
    """Every multiset of one to three classes that adds up to ``classes``, one row each."""
    found = [(classes, 0, 0)]
    found += [(classes - b, b, 0) for b in range(1, classes // 2 + 1)]
    found += [
        (classes - b - c, b, c)
        for c in range(1, classes // 3 + 1)
        for b in range(c, (classes - c) // 2 + 1)
        if classes - b - c >= b
    ]
    return np.array(found)


class Plan:
    """Groups of equal sequences: how many, and the (length, copies) each one holds."""

    def __init__(self, counts: np.ndarray, max_len: int, share: float = 1.0):
        self.share = share  # of the fitted repeats that are used; the rest is left over
        self.max_len = max_len
        self.left = counts.astype(np.int64).copy()  # left[length]: pieces without a place
        self.groups: list[list] = []  # [sequences, room, [(length, copies), ...]]
        self.lengths = [int(x) for x in np.flatnonzero(self.left) if x]
        self._full()
        self._fitted()
        self._best_fit()

    def _take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.remove(length)

    def _add(self, n: int, parts: list[int]) -> None:
        for p in set(parts):
            self._take(p, n * parts.count(p))
        held = [(p, parts.count(p)) for p in sorted(set(parts), reverse=True)]
        self.groups.append([n, self.max_len - sum(parts), held])

    def _full(self) -> None:
        if self.left[self.max_len]:
            self._add(int(self.left[self.max_len]), [self.max_len])

    def _fitted(self) -> None:
        classes = min(CLASSES, self.max_len)
        width = -(-self.max_len // classes)
        top = -(-self.max_len // width)
        of = -(-np.arange(self.max_len + 1) // width)
        target = np.bincount(of, weights=self.left, minlength=top + 1)[1:]
        rows = patterns(top)
        a = np.zeros((top, len(rows)))
        for k in range(3):
            held = rows[:, k] > 0
            np.add.at(a, (rows[held, k] - 1, np.flatnonzero(held)), 1)
        # short pieces also fill gaps later, so missing their count costs less
        weight = np.where(np.arange(1, top + 1) * 8 < top, 0.1, 1.0)[:, None]
        repeats = np.rint(self.share * nnls(a * weight, target * weight[:, 0])).astype(np.int64)
        for p in np.argsort(-rows[:, 0], kind="stable"):
            if repeats[p]:
                self._fill([int(c) for c in rows[p] if c], width, int(repeats[p]))

    def _fill(self, classes: list[int], width: int, todo: int) -> None:
        """Up to ``todo`` sequences of a pattern, of lengths that leave no gap."""

        def within(c: int) -> list[int]:
            low, high = (bisect_right(self.lengths, x) for x in ((c - 1) * width, c * width))
            return self.lengths[low:high][::-1]

        for first in within(classes[0]):
            for second in within(classes[1]) if len(classes) == 3 else [0]:
                parts = [first, second] if second else [first]
                last = self.max_len - sum(parts)
                if last and len(classes) > 1:
                    parts.append(last)
                if min(parts) < 1 or sum(parts) != self.max_len:
                    continue
                n = min([todo] + [int(self.left[x]) // parts.count(x) for x in parts])
                if n > 0:
                    self._add(n, parts)
                    todo -= n
                if not todo:
                    return

    def _best_fit(self) -> None:
        rooms: dict[int, list[int]] = {}
        for g, (_, room, _) in enumerate(self.groups):
            rooms.setdefault(room, []).append(g)
        open_rooms = sorted(r for r in rooms if r)
        for length in sorted(self.lengths, reverse=True):
            n = int(self.left[length])
            while n:
                at = bisect_right(open_rooms, length - 1)
                if at == len(open_rooms):
                    per = self.max_len // length
                    for sequences, copies in ((n // per, per), (1, n % per)):
                        if sequences and copies:
                            self.groups.append([sequences, self.max_len - copies * length, [(length, copies)]])
                            self._open(rooms, open_rooms, len(self.groups) - 1)
                    n = 0
                    break
                room = open_rooms[at]
                g = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], open_rooms[at]
                per = room // length
                used = min(self.groups[g][0], n // per)
                if not used:
                    used, per = 1, n
                if used < self.groups[g][0]:
                    rest = [self.groups[g][0] - used, room, list(self.groups[g][2])]
                    self.groups.append(rest)
                    self._open(rooms, open_rooms, len(self.groups) - 1)
                self.groups[g] = [used, room - per * length, [*self.groups[g][2], (length, per)]]
                self._open(rooms, open_rooms, g)
                n -= used * per
        self.lengths, self.left[:] = [], 0

    def _open(self, rooms: dict, open_rooms: list[int], g: int) -> None:
        room = self.groups[g][1]
        if room and room not in rooms:
            open_rooms.insert(bisect_right(open_rooms, room), room)
        if room:
            rooms.setdefault(room, []).append(g)

    def slots(self) -> tuple[np.ndarray, ...]:
        """Runs of places, by length and rank within the length: first rank over all lengths,
        first sequence, copies in a sequence, first offset, length."""
        rows, base = [], 0
        for n, _, held in self.groups:
            offset = 0
            for length, copies in held:
                rows.append((length, base, copies, offset, n * copies))
                offset += length * copies
            base += n
        rows.sort(key=lambda r: r[0])
        table = np.array(rows, np.int64).reshape(-1, 5)
        first = np.cumsum(table[:, 4]) - table[:, 4]
        return first, table[:, 1], table[:, 2], table[:, 3], table[:, 0]

    @property
    def sequences(self) -> int:
        return sum(g[0] for g in self.groups)


def best_plan(counts: np.ndarray, max_len: int) -> Plan:
    """The plan with the fewest sequences among several roundings of the fitted repeats."""
    return min((Plan(counts, max_len, s) for s in SHARES), key=lambda p: p.sequences)


def pieces(
    docs: DataFrame, path: str, max_len: int, end_id: int, keep_ids: bool, id: str, text: str
) -> DataFrame:
    """The pieces of every document, with their rank among equal lengths of their task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, task = encoder(path, "leading"), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, 1):
                ids = tokenizer.encode(batch.column(1))
                bounds = ids.bounds + np.arange(len(ids.bounds))
                flat = np.insert(ids.flat, ids.bounds[1:], np.uint32(end_id)).astype("<u4")
                raw, sizes = flat.tobytes(), np.diff(bounds)
                n = -(-sizes // max_len)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = sizes[doc] - (n[doc] - 1) * max_len
                start = np.where(piece == 0, 0, head + (piece - 1) * max_len)
                length = np.where(piece == 0, head, max_len)
                at = bounds[doc] + start
                order = np.argsort(length, kind="stable")
                runs = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else order
                place = np.arange(len(order)) - np.repeat(runs, np.diff(np.r_[runs, len(order)]))
                rank = np.zeros(len(order), np.int64)
                rank[order] = place + seen[length[order]]
                seen += np.bincount(length, minlength=max_len + 1)
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)),
                    pa.array(rank),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if keep_ids:
                    stops = np.r_[0, np.cumsum(length)].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(flat.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def pack(
    docs: DataFrame, path: str, max_len: int = 2048, end_id: int = 0, keep_ids: bool = False,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Packs all documents into few sequences of at most ``max_len`` tokens; one row per piece.

    Returns id, piece, start, length, ids_crc32, sequence_id, offset, and with ``keep_ids`` the
    ids themselves. Every document gets ``end_id`` behind its ids, so a null or empty text is one
    piece of one token. Only documents longer than ``max_len`` are cut, the remainder first. Rows
    with a null or repeated id are packed like any others. No documents give no rows; columns
    other than id and text are not read.
    """
    rows = stored(pieces(docs, path, max_len, end_id, keep_ids, id, text), "pieces")
    held = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(max_len + 1, np.int64)
    for length, n in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most max_len rows
        counts[length] = n
    first, sequence, copies, offset, lengths = best_plan(counts, max_len).slots()
    length_base = np.cumsum(counts) - counts

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            over_all = length_base[length] + rank
            slot = np.searchsorted(first, over_all, "right") - 1
            inside = over_all - first[slot]
            columns = [*batch.columns[:5], pa.array(sequence[slot] + inside // copies[slot])]
            columns.append(pa.array(offset[slot] + inside % copies[slot] * lengths[slot]))
            names = [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if keep_ids:
                columns.append(batch.column(6))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"),
        *(["ids"] if keep_ids else []),
    )
    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema + (", ids array<int>" if keep_ids else ""))
