"""Secrets in texts: fixed rules, and formats learned from the credentials that the rules label.

Grammar inference: the labelled credentials of a kind form a prefix tree whose states carry counts
of the characters that follow and of ends. States are merged in the red-blue order: the tree below
a state is folded into an earlier one if at all states that come to lie on each other the shares of
each character and of the end differ by no more than chance allows (Hoeffding's bound). What is left
is a deterministic probabilistic automaton, one per kind, and one more of ordinary runs.

All candidates, the runs of credential characters that no rule has found, are then scored. A run is
a secret of a kind if that kind's automaton explains it better than the one of ordinary runs by
``min_bits`` bits in all, and is typical of the kind: as long as some labelled one at least and at
most, and with no fewer bits a character than the worst hundredth of those held out of the fit, less
``SLACK``. A grammar is learnt from a bounded sample of the labelled values, but how short and how long a
kind gets is taken from all of them, and a run of any length is scored whole. Unlabelled credentials among the ordinary runs would teach their grammar the formats, so
runs typical of a kind are left out of its examples; but not where they are more than
``MINORITY`` of them, as the kind is then no format of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlytics.llm.scratch import stored
from crewlytics.llm.text_arrays import tidy

# fixed values: the rules, in the order in which spans that begin together are listed
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
TRIMMED = ".-"

ORDINARY = "ordinary"
EXAMPLES = 1000  # labelled values per kind that a grammar is fitted to
LEARNT = 4096  # a grammar is learnt from this many first characters of an example
FEW = 32  # where fewer values are left to score, each is scored by itself
FEWEST = 20  # kinds with fewer examples have no grammar
ALPHA = 0.05
MIN_BITS = 40.0
SLACK = 0.25
MINORITY = 0.25
BUCKETS = 64
END = 256


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of what the rules find, in order; places are code points."""
    found = []
    small = text.lower()
    if any(word in small for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    for run in RUN.finditer(text):  # longer matches of the other kinds lie within such runs
        part, base = run[0], run.start()
        if "AKIA" in part:
            found += [
                (base + m.start(), 1, base + m.end())
                for m in ACCESS.finditer(part)
                if len(m[0]) >= ACCESS_LENGTH
            ]
        if len(part) >= HEX_LENGTH:
            found += [(base + m.start(), 2, base + m.end()) for m in HEX.finditer(part)]
    return sorted(found)


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of credential characters that overlap nothing found, without dots and dashes at the ends."""
    starts = [s for s, _, _ in found]
    furthest = list(accumulate((e for _, _, e in found), max))
    out = []
    for run in RUN.finditer(text):
        part = run[0].strip(TRIMMED)
        start = run.start() + len(run[0]) - len(run[0].lstrip(TRIMMED))
        end = start + len(part)
        before = bisect_left(starts, end)  # spans that begin before the end of the run
        if len(part) >= MIN_RUN and (not before or furthest[before - 1] <= start):
            out.append((start, end))
    return out


@dataclass
class Grammar:
    """A probabilistic automaton: bits[state, character] and after[state, character]; 256 is the end."""

    bits: np.ndarray
    after: np.ndarray
    lowest: float = -math.inf  # bits a character of typical values
    lengths: tuple[float, float] = (0, math.inf)

    @property
    def states(self) -> int:
        return len(self.bits)

    def score(self, values: list[bytes], ended: np.ndarray | None = None) -> np.ndarray:
        """log2 of each value's likelihood; one character of all values at a time, then the long ones.

        The end is included, but for values that are not ``ended`` as they are only a beginning.
        """
        lengths = np.array([len(v) for v in values], np.int64)
        data = np.frombuffer(b"".join(values) + b"\0", np.uint8)
        at = np.cumsum(lengths) - lengths
        state, total = np.zeros(len(values), np.int64), np.zeros(len(values))
        live = np.flatnonzero(lengths)
        step = 0
        while len(live) > FEW:
            c = data[at[live] + step]
            total[live] += self.bits[state[live], c]
            state[live] = self.after[state[live], c]
            step += 1
            live = live[lengths[live] > step]
        rows: dict[int, tuple[list[float], list[int]]] = {}
        for i in live:
            total[i], state[i] = self._walk(values[i][step:], int(state[i]), float(total[i]), rows)
        last = self.bits[state, END]
        return total + (last if ended is None else np.where(ended, last, 0.0))

    def _walk(self, value: bytes, state: int, total: float, rows: dict) -> tuple[float, int]:
        for c in value:
            if state not in rows:
                rows[state] = self.bits[state].tolist(), self.after[state].tolist()
            bits, after = rows[state]
            total += bits[c]
            state = after[c]
        return total, state

    def inside(self, lengths: np.ndarray) -> np.ndarray:
        """Whether some labelled value of the kind is as short and some is as long."""
        return (lengths >= self.lengths[0]) & (lengths <= self.lengths[1])

    def typical(
        self, values: list[bytes], scores: np.ndarray, lengths: np.ndarray | None = None
    ) -> np.ndarray:
        """Which values are typical; ``lengths`` are the whole ones where ``values`` are beginnings."""
        scored = np.array([len(v) for v in values], np.int64)
        whole = scored if lengths is None else lengths
        return self.inside(whole) & (scores >= self.lowest * (scored + (whole == scored)))


class _Tree:
    """A prefix tree with counts; merged states are forwarded to the state they were folded into.

    What only one value passes is kept as the rest of that value and grown state by state when it is
    looked at, so long values need no state a character. A value that is not ended counts no end.
    """

    def __init__(self, values: Iterable[tuple[bytes, bool]]):
        self.next: list[dict[int, int]] = []
        self.pass_: list[dict[int, int]] = []
        self.ends: list[int] = []
        self.rest: dict[int, tuple[bytes, int, bool]] = {}
        self._state()
        for value, ended in values:
            self._add(0, value, 0, ended)

    def _state(self) -> int:
        self.next.append({})
        self.pass_.append({})
        self.ends.append(0)
        return len(self.ends) - 1

    def _add(self, state: int, value: bytes, at: int, ended: bool) -> None:
        """Counts a value from a place on, from a state on; what no other value passes becomes a rest."""
        for place in range(at, len(value)):
            self.grown(state)
            c = value[place]
            self.pass_[state][c] = self.pass_[state].get(c, 0) + 1
            if c not in self.next[state]:
                new = self._state()
                self.next[state][c] = new
                self.rest[new] = (value, place + 1, ended)
                return
            state = self.next[state][c]
        self.grown(state)
        self.ends[state] += ended

    def grown(self, state: int) -> None:
        """Turns the first character of a state's rest into a state."""
        if state in self.rest:
            value, at, ended = self.rest.pop(state)
            if at == len(value):
                self.ends[state] += ended
            else:
                new = self._state()
                self.next[state][value[at]] = new
                self.pass_[state][value[at]] = 1
                self.rest[new] = (value, at + 1, ended)

    def seen(self, state: int) -> int:
        self.grown(state)
        return self.ends[state] + sum(self.pass_[state].values())

    def compatible(self, one: int, two: int, alpha: float) -> bool:
        """Whether the trees below two states differ by no more than chance allows, state by state."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(one, two)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen(a), self.seen(b)
            if not n or not m or bound >= math.sqrt(m):
                continue  # below ``b`` is a tree, so counts only fall there and the limit stays above 1
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if limit < 1:
                if abs(self.ends[a] / n - self.ends[b] / m) >= limit:
                    return False
                for c in self.pass_[a].keys() | self.pass_[b].keys():
                    if abs(self.pass_[a].get(c, 0) / n - self.pass_[b].get(c, 0) / m) >= limit:
                        return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, into: int, tree: int) -> None:
        """Adds the counts of the tree below a state to those below another."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            if b in self.rest:
                self._add(a, *self.rest.pop(b))
                continue
            self.grown(a)
            self.ends[a] += self.ends[b]
            for c, n in self.pass_[b].items():
                self.pass_[a][c] = self.pass_[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]


def infer(
    values: list[bytes], alpha: float = ALPHA, held_out: int = 5, lengths: list[int] | None = None
) -> Grammar:
    """The grammar of some values; every ``held_out``-th is left out of the fit and sets what is typical.

    States are taken breadth first, in the order of their characters, so equal values give an equal
    grammar. A value shorter than its length in ``lengths`` is only a beginning and teaches no end.
    """
    wholes = [len(v) for v in values] if lengths is None else lengths
    pairs = sorted(zip(values, wholes, strict=True), key=lambda p: (hashlib.sha256(p[0]).digest(), *p))
    told = [(v, len(v) == whole) for v, whole in pairs]
    kept, fitted = told[::held_out], [pair for i, pair in enumerate(told) if i % held_out]
    tree = _Tree(fitted or told)
    red, queue = [0], [(0, c) for c in sorted(tree.next[0])]
    while queue:
        parent, c = queue.pop(0)
        blue = tree.next[parent][c]
        if blue in red:
            continue
        for state in red:
            if tree.compatible(state, blue, alpha):
                before = {r: set(tree.next[r]) for r in red}
                tree.next[parent][c] = state
                tree.fold(state, blue)
                queue += [(r, x) for r in red for x in sorted(set(tree.next[r]) - before[r])]
                break
        else:
            tree.grown(blue)
            red.append(blue)
            queue += [(blue, x) for x in sorted(tree.next[blue])]
    place = {state: i for i, state in enumerate(red)}
    bits = np.empty((len(red), 257))
    after = np.zeros((len(red), 256), np.int64)
    for state, i in place.items():
        n = tree.seen(state)
        counts = np.full(257, 1 / 257)
        counts[END] += tree.ends[state]
        for c, times in tree.pass_[state].items():
            counts[c] += times
            after[i, c] = place[tree.next[state][c]]
        bits[i] = np.log2(counts / (n + 1))
    grammar = Grammar(bits, after)
    ended = np.array([end for _, end in kept])
    rate = grammar.score([v for v, _ in kept], ended) / np.array([len(v) + end for v, end in kept])
    grammar.lowest = float(np.quantile(rate, 0.01)) - SLACK
    grammar.lengths = min(wholes), max(wholes)
    return grammar


class _Kept:
    """Of a kind, the ``EXAMPLES`` values with the least hashes, and the least and greatest length of all."""

    def __init__(self):
        self.values: dict[int, tuple[str, int]] = {}
        self.shortest, self.longest = math.inf, 0

    def add(self, value: str) -> None:
        import xxhash

        self.shortest, self.longest = min(self.shortest, len(value)), max(self.longest, len(value))
        self.values[xxhash.xxh64_intdigest(value.encode()) >> 1] = value[:LEARNT], len(value)
        if len(self.values) >= 4 * EXAMPLES:
            self.values = dict(self.least())

    def least(self) -> list[tuple[int, tuple[str, int]]]:
        return heapq.nsmallest(EXAMPLES, self.values.items())


def labelled(texts: DataFrame) -> DataFrame:
    """(kind, h, value, length, shortest, longest): what the rules find, and ordinary runs, a bounded sample.

    For each kind the ``EXAMPLES`` distinct values with the least hashes, whatever their length and
    whatever task finds them; of a value its first ``LEARNT`` characters and its whole length.
    ``shortest`` and ``longest`` are the lengths of all values of the kind, not of the sample alone.
    """
    schema = "kind string, h long, value string, length long, shortest long, longest long"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, _Kept] = {kind: _Kept() for kind in [*KINDS, ORDINARY]}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                found = rule_spans(text)
                for start, kind, end in found:
                    value = text[start:end]
                    if not kind:
                        value = ASSIGN.fullmatch(value)[2]
                    kept[KINDS[kind]].add(value)
                for start, end in candidates(text, found):
                    kept[ORDINARY].add(text[start:end])
        rows = [
            (kind, h, value, length, all_.shortest, all_.longest)
            for kind, all_ in kept.items()
            for h, (value, length) in all_.least()
        ]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        types = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            ["kind", "h", "value", "length", "shortest", "longest"],
        )

    bounds = [F.min("shortest").alias("shortest"), F.max("longest").alias("longest")]
    found = texts.mapInArrow(run, schema).groupBy("kind", "h", "value", "length").agg(*bounds)
    # two steps, so that no task gets more than a small part of what all tasks kept
    for part in (f"kind, h % {BUCKETS}", "kind"):
        found = found.selectExpr(
            "kind", "h", "value", "length",
            f"min(shortest) over (partition by {part}) as shortest",
            f"max(longest) over (partition by {part}) as longest",
            f"row_number() over (partition by {part} order by h, value) as nth",
        ).where(f"nth <= {EXAMPLES}").drop("nth")
    return found


def train(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> dict[str, Grammar]:
    """A grammar for each kind that has ``FEWEST`` examples in ``docs``, and one of ordinary runs.

    At most ``EXAMPLES`` values a kind come to the driver, of each no more than ``LEARNT`` characters;
    these are the only rows that do. Lengths that a kind may have are those of all its values.
    """
    examples = stored(labelled(docs.select(F.col(text).alias("text"))), "credentials")
    rows: dict[str, list] = {}
    for row in examples.orderBy("kind", "h").collect():
        rows.setdefault(row["kind"], []).append(row)

    def learnt(some: list) -> Grammar:
        grammar = infer([r["value"].encode() for r in some], alpha, lengths=[r["length"] for r in some])
        grammar.lengths = some[0]["shortest"], some[0]["longest"]
        return grammar

    grammars = {k: learnt(some) for k, some in rows.items() if k != ORDINARY and len(some) >= FEWEST}
    ordinary = rows.get(ORDINARY, [])
    values = [r["value"].encode() for r in ordinary]
    lengths = np.array([r["length"] for r in ordinary], np.int64)
    ended = lengths == np.array([len(v) for v in values], np.int64)
    alike = np.zeros(len(ordinary), bool)
    for grammar in grammars.values():
        typical = grammar.typical(values, grammar.score(values, ended), lengths)
        if typical.sum() <= MINORITY * len(ordinary):
            alike |= typical
    ordinary = [r for r, like in zip(ordinary, alike, strict=True) if not like]
    return grammars | ({ORDINARY: learnt(ordinary)} if len(ordinary) >= FEWEST else {})


def _plain() -> Grammar:
    """What ordinary runs are taken for where too few are seen: all credential characters alike."""
    return Grammar(np.full((1, 257), math.log2(1 / 68)), np.zeros((1, 256), np.int64))


def scan(
    docs: DataFrame, grammars: dict[str, Grammar], min_bits: float = MIN_BITS, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, spans): what the rules and the grammars find in every row of ``docs``.

    ``spans`` holds (start, kind, end), by start, then kind as listed, in code points, the end
    exclusive. Kinds are those of the rules, then the same with ``format_`` before the name for runs
    that only a grammar has found; where several fit, the one that explains the run best. Null and
    empty texts have no spans; repeated rows each give a row; other columns are not read. Texts are
    read whole, one at a time, and runs of any length are judged; only those shorter or longer than all
    labelled values of every kind need no score, as they are typical of none.
    """
    fitted = [(f"format_{k}", grammars[k]) for k in KINDS if k in grammars]
    ordinary = grammars.get(ORDINARY) or _plain()
    names = [*KINDS, *[name for name, _ in fitted]]
    lengths = [grammar.lengths for _, grammar in fitted]

    def judged(runs: list[bytes]) -> list[int]:
        """The place in ``names`` of the kind of each run, 0 for none."""
        if not runs or not fitted:
            return [0] * len(runs)
        scores = np.stack([g.score(runs) for _, g in fitted])
        typical = np.stack([g.typical(runs, s) for (_, g), s in zip(fitted, scores, strict=True)])
        fits = (scores - ordinary.score(runs) >= min_bits) & typical
        best = np.where(fits, scores, -np.inf).argmax(0)
        return np.where(fits.any(0), best + len(KINDS), 0).tolist()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            rows, runs, where = [], [], []
            for i, source in enumerate(batch.column(1).to_pylist()):
                found = rule_spans(source) if source else []
                rows.append(found)
                if source:
                    for start, end in candidates(source, found):
                        if any(low <= end - start <= high for low, high in lengths):
                            runs.append(source[start:end].encode())
                            where.append((i, start, end))
            more: dict[int, list] = {}
            for (i, start, end), k in zip(where, judged(runs), strict=True):
                if k:
                    more.setdefault(i, []).append((start, k, end))
            spans = [
                [{"start": s, "kind": names[k], "end": e} for s, k, e in sorted(found + more.get(i, []))]
                for i, found in enumerate(rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id, "spans"])

    kind = docs.schema[id].dataType.simpleString()
    read = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"`{id}` {kind}, spans array<struct<start: bigint, kind: string, end: bigint>>")
