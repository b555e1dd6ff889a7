"""Quality rules by gradient-boosted trees over document statistics.

Statistics are counted for whole Arrow batches in numpy. The trees are fitted on the driver to a
bounded sample of labelled documents and flattened into arrays of nodes, which the tasks walk
for all documents and all trees at once. The score never falls when a statistic in ``RISING``
rises, whatever the sample says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from crewlytics.llm.text_arrays import (
    bytes_of, covered, cut_words, hash_ranges, hash_runs, hash_words, is_space, mix, run_fits, tidy,
)
from crewlytics.llm.tokens import slices

SYMBOLS = b"#*$%&|<>"
END_MARKS = b".!?:;\"'"
REPEAT_WORDS = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "line_words",
    "ended_lines", "digit_share", "upper_share", "distinct_share", "bar_share",
]
RISING = ["symbol_share", "dup_line_share", "repeat_share"]  # more of these never looks better
SAMPLE_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
REJECT_ABOVE = 0.5


def _sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(marks, dtype=np.int64)][bounds])


def _one_of(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[data]


def _first_of(keys: np.ndarray) -> np.ndarray:
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (a row per text, columns COUNTS) and features (columns FEATURES) of a batch."""
    data, offsets = bytes_of(texts)
    words = cut_words(data, offsets)
    n, n_words = words.n_texts, words.counts
    inner = ~is_space(data)
    word_chars = _sums(inner & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _sums(_one_of(data, SYMBOLS), offsets)

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.r_[offsets[:-1], breaks + 1])
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    line_text = np.repeat(np.arange(n), per_text)
    is_last = np.zeros(len(line_start), bool)
    is_last[np.cumsum(per_text) - 1] = True
    line_end = np.empty(len(line_start), np.int64)
    line_end[~is_last], line_end[is_last] = breaks, offsets[1:]
    with_word = np.diff(np.searchsorted(words.starts, np.c_[line_start, line_end]), axis=1)[:, 0] > 0
    line_start, line_end, line_text = (x[with_word] for x in (line_start, line_end, line_text))
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    lines = np.bincount(line_text, minlength=n)
    seen = mix(hash_ranges(data, line_start, line_end) ^ salt[line_text])
    n_dup_lines = lines - np.bincount(line_text[_first_of(seen)], minlength=n)
    last_word = np.searchsorted(words.starts, line_end) - 1
    ended = np.zeros(len(line_text), bool)
    if len(line_text):
        ended = _one_of(data[words.ends[last_word] - 1], END_MARKS)

    hashes, text = hash_words(words), words.text
    windows = np.flatnonzero(run_fits(words, REPEAT_WORDS))
    keys = mix(hash_runs(hashes, REPEAT_WORDS)[windows] ^ salt[text[windows]])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    repeated = np.zeros(len(hashes), bool)
    repeated[windows[order[np.r_[same, False] | np.r_[False, same]] if len(order) else order]] = True
    n_repeat = _sums(covered(repeated, REPEAT_WORDS), words.first)
    distinct = np.bincount(text[_first_of(mix(hashes ^ salt[text]))], minlength=n)

    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], 1).astype(np.int64)
    some = np.maximum(n_words, 1)
    chars = np.maximum(word_chars, 1)
    some_lines = np.maximum(lines, 1)
    features = np.stack(
        [
            np.log1p(n_words), word_chars / some, n_symbols / chars, n_dup_lines / some_lines,
            n_repeat / some, n_words / some_lines,
            np.bincount(line_text[ended], minlength=n) / some_lines,
            _sums((data >= 48) & (data <= 57), offsets) / chars,
            _sums((data >= 65) & (data <= 90), offsets) / chars,
            distinct / some, _sums(data == ord("|"), offsets) / some,
        ],
        1,
    )
    return counts, features


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, features: np.ndarray) -> np.ndarray:
        """The estimated chance that each row is of low quality."""
        out = np.full(len(features), self.base)
        for at in range(0, len(features), 4096):
            rows = features[at : at + 4096]
            node = np.tile(self.root, (len(rows), 1))
            which = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                low = rows[which, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(
    features: np.ndarray, low: np.ndarray, rising: list[int], trees: int = 80, depth: int = 3,
    rate: float = 0.15, bins: int = 48, smoothing: float = 1.0, least_weight: float = 2.0,
) -> Trees:
    """Boosted trees for ``low`` (1: low quality) by second-order gains over binned features."""
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in features.T]
    binned = np.stack([np.searchsorted(e, f, "left") for e, f in zip(edges, features.T, strict=True)], 1)
    share = np.clip(low.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(low), base)
    nodes: list[list] = []
    roots = []

    def grow(rows, level, floor, ceiling, gradient, weight) -> int:
        me = len(nodes)
        g, h = gradient[rows].sum(), weight[rows].sum()
        value = float(np.clip(-g / (h + smoothing), floor, ceiling))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-3, None)
        for f in range(binned.shape[1]) if level < depth else ():
            size = len(edges[f]) + 1
            gl = np.cumsum(np.bincount(binned[rows, f], gradient[rows], size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], weight[rows], size))[:-1]
            if not len(gl):
                continue
            a = np.clip(-gl / (hl + smoothing), floor, ceiling)
            b = np.clip(-(g - gl) / (h - hl + smoothing), floor, ceiling)

            def loss(gs, hs, v):
                return gs * v + 0.5 * (hs + smoothing) * v * v

            gain = loss(g, h, value) - loss(gl, hl, a) - loss(g - gl, h - hl, b)
            fine = (hl >= least_weight) & (h - hl >= least_weight)
            if f in rising:
                fine &= a <= b
            gain = np.where(fine, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, a[k], b[k]))
        if best[1] is None:
            return me
        f, k, a, b = best[1]
        below, above, middle = (floor, ceiling), (floor, ceiling), (a + b) / 2
        if f in rising:
            below, above = (floor, middle), (middle, ceiling)
        goes = binned[rows, f] <= k
        left = grow(rows[goes], level + 1, *below, gradient, weight)
        right = grow(rows[~goes], level + 1, *above, gradient, weight)
        nodes[me] = [f, float(edges[f][k]), left, right, 0.0]
        return me

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(grow(np.arange(len(low)), 0, -4.0, 4.0, chance - low, chance * (1 - chance)))
        table = np.array(nodes, float)
        one = _trees(table, [first], 0.0, depth)
        raw += _raw(one, features)
    return _trees(np.array(nodes, float).reshape(-1, 5), roots, base, depth)


def _trees(table: np.ndarray, roots: list[int], base: float, depth: int) -> Trees:
    f, t, left, right, value = table.T
    whole = [x.astype(np.int64) for x in (f, left, right)]
    return Trees(np.array(roots), whole[0], t, whole[1], whole[2], value, base, depth)


def _raw(trees: Trees, features: np.ndarray) -> np.ndarray:
    chance = trees.score(features)
    return np.log(chance) - np.log1p(-chance)


def labelled(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id: str = "doc_id",
    text: str = "text", label: str = "quality",
) -> tuple[np.ndarray, np.ndarray]:
    """Features and low-quality marks of at most ``sample_rows`` labelled documents.

    The sample is the labelled ids with the smallest hashes, so it is the same at every run.
    Rows with a null id or label are left out, columns other than these three are not read.
    """
    chosen = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    chosen = chosen.groupBy(F.col(id).alias("_id")).agg(F.min(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    read = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = read.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("_id", "_label", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                stats = statistics(batch.column(2))[1]
                columns = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64())]
                columns += [pa.array(f) for f in stats.T]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", *FEATURES])

    schema = "id long, label long, " + ", ".join(f"{f} double" for f in FEATURES)
    found = rows.mapInArrow(run, schema).dropDuplicates(["id"]).toPandas()  # at most sample_rows
    found = found.sort_values("id")
    return found[FEATURES].to_numpy(float), (found["label"].to_numpy() == 0).astype(float)


def train(docs: DataFrame, labels: DataFrame, **options) -> Trees | None:
    """Trees for a corpus, or None when the labels do not hold both classes."""
    features, low = labelled(docs, labels, **options)
    if len(set(low.tolist())) < 2:
        return None
    return fit(features, low, [FEATURES.index(f) for f in RISING])


def verdicts(counts: np.ndarray, features: np.ndarray, trees: Trees | None, above: float):
    """(base_failed, kept) of each text."""
    n_words, n_repeat = counts[:, 0], counts[:, 4]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    bad = trees.score(features) > above if trees is not None else np.zeros(len(failed), bool)
    return failed, ~failed & ~bad


def judge(
    docs: DataFrame, trees: Trees | None, above: float = REJECT_ABOVE, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, counts, base_failed, kept, score) of every row of ``docs``, one row each.

    Null and empty texts count nothing and fail the base rules. Without trees the base rules
    decide alone. Repeated rows and null ids are judged like any others.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                counts, features = statistics(batch.column(1))
                failed, kept = verdicts(counts, features, trees, above)
                score = trees.score(features) if trees is not None else np.zeros(len(failed))
                columns = [batch.column(0), *map(pa.array, counts.T), *map(pa.array, (failed, kept, score))]
                yield pa.RecordBatch.from_arrays(columns, [id, *COUNTS, "base_failed", "kept", "score"])

    fields = [docs.schema[id], *(StructField(c, LongType()) for c in COUNTS)]
    rest = StructType.fromDDL("base_failed boolean, kept boolean, score double").fields
    return docs.select(id, text).mapInArrow(run, StructType(fields + rest))


def keep_good(
    docs: DataFrame, trees: Trees | None, above: float = REJECT_ABOVE, text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all their columns unchanged."""
    at = docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                kept = verdicts(*statistics(batch.column(at)), trees, above)[1]
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
