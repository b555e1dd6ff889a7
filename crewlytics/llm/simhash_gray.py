"""SimHash near-duplicates by an index over fingerprints in Gray order.

1. Every text gets a 64-bit SimHash fingerprint; equal fingerprints are folded to one row.
2. Two fingerprints that differ in at most ``radius`` bits agree on at least one of
   ``radius + 1`` bands of bits, so the fingerprints are dealt to one bucket for each band. A
   bucket of more than ``bucket_rows`` fingerprints is dealt again by bands of its remaining
   bits, ``levels`` times in all; a bucket that is still longer is cut along its Gray order into
   chunks, and chunks meet in pairs unless the bits that each chunk shares already differ in
   more than ``radius`` places. No bucket is cut short and no task holds more than two chunks.
3. Within a bucket the fingerprints are sorted by Gray rank. Eight neighbours form a node that
   holds the bits all of them share, eight nodes form the next one, and what an upper node
   holds is taken out of the lower ones. A search walks down from the root and adds up the
   differences on the way; a node above ``radius`` is left out with all below it.
4. Of the links found in a bucket only a spanning forest is passed on. Components over all
   buckets follow in ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from crewlytics.llm.components import components
from crewlytics.llm.scratch import stored
from crewlytics.llm.text_arrays import tidy
from crewlytics.operators.skew import dealt_anew

BITS = 64
FAN_OUT = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The SimHash of one text as an unsigned number; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words]), 42) for i in range(n)),
        np.uint64,
        n,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        piece = hashes[at : at + 65536].astype("<u8")
        bits = np.unpackbits(piece.view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle_words: int, text: str = "text") -> DataFrame:
    """Adds ``simhash`` (long, the fingerprint's bits); the text column may hold nulls."""
    name = "simhash"
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            prints = np.fromiter(
                (fingerprint(t.as_py(), shingle_words) for t in texts), np.uint64, len(texts)
            )
            column = pa.array(prints.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def band_masks(radius: int, levels: int) -> list[list[int]]:
    """For each level the masks of its tables; each mask extends one of the level above."""
    out, above = [], [[]]
    for _ in range(levels):
        below = []
        for taken in above:
            left = [b for b in range(BITS) if b not in taken]
            if len(left) < radius + 1:
                return out
            below += [taken + band for band in _bands(left, radius + 1)]
        out.append([_mask(bits) for bits in below])
        above = below
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayTree:
    """The index of many buckets at once: rows sorted by bucket and Gray rank."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        self.codes = codes
        self.masks, self.values, self.first = [], [], []
        ones, zeros, of = codes, ~codes, bucket
        single = False
        while not single:
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            place = np.arange(len(of)) - np.repeat(heads, np.diff(np.r_[heads, len(of)]))
            begin = np.flatnonzero(place % FAN_OUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, begin), np.bitwise_and.reduceat(zeros, begin)
            self.first.append(np.r_[begin, len(of)])
            self.masks.append(ones | zeros)
            self.values.append(ones)
            of = of[begin]
            single = len(of) == len(heads)
        self.roots = of
        self.leaf_mask = ~np.repeat(self.masks[0], np.diff(self.first[0]))
        for low in range(len(self.masks) - 1):
            self.masks[low] &= ~np.repeat(self.masks[low + 1], np.diff(self.first[low + 1]))

    def search(self, query: np.ndarray, root: np.ndarray, radius: int):
        """(query, leaf) of all rows within ``radius`` below the root given for each query."""
        who, node = np.arange(len(query)), root
        level = len(self.masks) - 1
        gone = _popcount((query ^ self.values[level][node]) & self.masks[level][node])
        while True:
            alive = gone <= radius
            who, node, gone = who[alive], node[alive], gone[alive]
            begin = self.first[level][node]
            count = self.first[level][node + 1] - begin
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            step = np.arange(total) - np.repeat(ends - count, count)
            node = np.repeat(begin, count) + step
            who, gone = np.repeat(who, count), np.repeat(gone, count)
            if level == 0:
                gone = gone + _popcount((query[who] ^ self.codes[node]) & self.leaf_mask[node])
                near = gone <= radius
                return who[near], node[near]
            level -= 1
            gone = gone + _popcount((query[who] ^ self.values[level][node]) & self.masks[level][node])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` entries is linked to, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while True:
            jump = after[after]
            if (jump == after).all():
                break
            after = jump
        if (after == root).all():
            return root
        root = after


def _links(codes: np.ndarray, bucket: np.ndarray, radius: int, side: np.ndarray | None):
    """A spanning forest of the links inside each bucket, as pairs of codes.

    With ``side``, only links between the two sides of a bucket are searched.
    """
    order = np.lexsort((gray_rank(codes), bucket))
    codes, bucket = codes[order], bucket[order]
    side = None if side is None else side[order]
    tree = GrayTree(codes, bucket)
    root = np.searchsorted(tree.roots, bucket)
    a, b = [], []
    asking = np.arange(len(codes)) if side is None else np.flatnonzero(side == 0)
    for at in range(0, len(asking), 1024):
        ask = asking[at : at + 1024]
        who, leaf = tree.search(codes[ask], root[ask], radius)
        keep = ask[who] < leaf if side is None else side[leaf] == 1
        a.append(ask[who[keep]])
        b.append(leaf[keep])
    a, b = np.concatenate(a or [[]]).astype(np.int64), np.concatenate(b or [[]]).astype(np.int64)
    if not len(a):
        return codes[:0], codes[:0]
    top = _forest(len(codes), a, b)
    linked = np.flatnonzero(top != np.arange(len(codes)))
    return codes[linked], codes[top[linked]]


def _search_sorted(radius: int):
    """Searches a partition that is sorted by bucket, whole buckets at a time."""

    def found(keys, codes, side):
        bucket = np.cumsum(np.r_[False, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        for two_sided in (False, True):
            pick = (side >= 0) == two_sided
            if pick.any():
                a, b = _links(codes[pick], bucket[pick], radius, side[pick] if two_sided else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros((4, 0), np.int64)
        codes, side = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            keys = np.concatenate([keys, np.array(rows[:4]).reshape(4, -1)], axis=1)
            codes = np.concatenate([codes, rows[4].view(np.uint64)])
            side = np.concatenate([side, rows[5]])
            if not len(codes):
                continue
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from found(keys[:, :cut], codes[:cut], side[:cut])
                keys, codes, side = keys[:, cut:], codes[cut:], side[cut:]
        if len(codes):
            yield from found(keys, codes, side)

    return run


def _first_level(codes: DataFrame, masks: list[int]) -> DataFrame:
    """One row for each fingerprint and table, with the bits that the table keeps."""
    tables = [
        F.struct(F.lit(t).alias("tab"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for t, m in enumerate(masks)
    ]
    rows = codes.select("code", F.explode(F.array(*tables)).alias("e"))
    return rows.select("e.tab", "e.bits", "code")


def _next_level(rows: DataFrame, first: int, masks: list[int], parts: int) -> DataFrame:
    """Each row once for every table below its own; ``first`` is the number of the first table
    of the rows' level, ``masks`` are those of the level below, ``parts`` for each table."""
    below = first + len(masks) // parts
    number = (F.col("tab") - first) * parts + F.col("k")
    kept = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), number + 1)
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(parts)])))
    return rows.select((number + below).alias("tab"), F.col("code").bitwiseAND(kept).alias("bits"), "code")


def near_links(
    codes: DataFrame, radius: int, bucket_rows: int = 2048, levels: int = 3
) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` of one another.

    ``codes`` has one row per distinct fingerprint (``code``: long). Two fingerprints are in one
    component of the result if and only if they are in one component of all near pairs; not
    every near pair is listed.
    """
    masks = band_masks(radius, levels)
    todo, first, parts = _first_level(codes, masks[0]), 0, []
    for level, tables in enumerate(masks):
        sizes = todo.groupBy("tab", "bits").agg(F.count("*").alias("n"))
        hot = stored(sizes.where(F.col("n") > bucket_rows).select("tab", "bits"), "hot-buckets")
        if hot.isEmpty():
            parts.append(todo)
            todo = None
            break
        parts.append(todo.join(hot, ["tab", "bits"], "left_anti"))
        todo = todo.join(hot, ["tab", "bits"], "left_semi")
        if level + 1 < len(masks):
            todo = _next_level(todo, first, masks[level + 1], radius + 1)
            first += len(tables)
    met = None
    for part in parts:
        part = part.select(
            "tab", "bits", F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"),
            "code", F.lit(-1).alias("side"),
        )
        met = part if met is None else met.union(part)
    if todo is not None:
        met = met.union(_chunk_pairs(todo, radius, bucket_rows))
    keys = ["tab", "bits", "one", "two"]
    met = met.repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(_search_sorted(radius), "a long, b long")


def _chunk_pairs(hot: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """Oversize buckets cut along their Gray order, and the chunk pairs that may hold a link."""
    rank = F.col("code")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    order = ["tab", "bits", "rank"]
    ranked = hot.withColumn("rank", rank.bitwiseXOR(F.lit(-(1 << 63))))
    ranked = ranked.repartitionByRange(*order).sortWithinPartitions(*order)

    @tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = (TaskContext.get().partitionId() << 32) - 1
        last, filled = None, 0
        for batch in batches:
            tab, bits = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            out = np.zeros(batch.num_rows, np.int64)
            change = np.r_[True, (tab[1:] != tab[:-1]) | (bits[1:] != bits[:-1])]
            heads = np.flatnonzero(change)
            for at, end in zip(heads, np.r_[heads[1:], len(tab)], strict=True):
                if (tab[at], bits[at]) != last:
                    last, filled, chunk = (tab[at], bits[at]), 0, chunk + 1
                place = filled + np.arange(end - at)
                out[at:end] = chunk + place // bucket_rows
                chunk, filled = chunk + (filled + end - at) // bucket_rows, (
                    filled + end - at
                ) % bucket_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out), batch.column(2)],
                ["tab", "bits", "chunk", "code"],
            )

    chunks = ranked.select("tab", "bits", "code").mapInArrow(
        number, "tab int, bits long, chunk long, code long"
    )
    chunks = stored(chunks, "chunks")
    roots = chunks.groupBy("tab", "bits", "chunk").agg(
        F.bit_and("code").alias("ones"), F.bit_and(F.bitwise_not("code")).alias("zeros")
    )
    one = roots.select("tab", "bits", F.col("chunk").alias("one"), F.col("ones").alias("a"), F.col("zeros").alias("na"))
    two = roots.select("tab", "bits", F.col("chunk").alias("two"), F.col("ones").alias("b"), F.col("zeros").alias("nb"))
    differ = F.expr("bit_count(a & nb) + bit_count(b & na)")
    pairs = one.join(two, ["tab", "bits"]).where((F.col("one") <= F.col("two")) & (differ <= radius))
    pairs = pairs.select("tab", "bits", "one", "two")
    sides = F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("chunk"), F.lit(-1).alias("side")))).otherwise(
        F.array(
            F.struct(F.col("one").alias("chunk"), F.lit(0).alias("side")),
            F.struct(F.col("two").alias("chunk"), F.lit(1).alias("side")),
        )
    )
    pairs = pairs.withColumn("e", F.explode(sides)).select("tab", "bits", "one", "two", "e.chunk", "e.side")
    return chunks.join(pairs, ["tab", "bits", "chunk"]).select("tab", "bits", "one", "two", "code", "side")


def simhash_groups(
    docs: DataFrame,
    shingle_words: int = 4,
    radius: int = 4,
    id: str = "doc_id",
    text: str = "text",
    bucket_rows: int = 2048,
    levels: int = 3,
) -> DataFrame:
    """(id, simhash, component, root, text_hash): the group that each document belongs to.

    ``root`` is a fingerprint that names the group, also where groups share an id or have none;
    ``text_hash`` tells rows with one id apart. ``component`` is the smallest id that is reached over links of at most ``radius`` differing
    bits. Every input row gives one row, repeated rows and rows with a null id included; a row
    with a null id may link others, and a group in which no row has an id has a null component.
    Null and empty texts have fingerprint 0, which is linked like any other. Texts are hashed as
    a whole whatever their length; other columns of ``docs`` are not read.
    """
    prints = with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), shingle_words)
    prints = stored(prints.select("id", "simhash", F.xxhash64("text").alias("text_hash")), "fingerprints")
    codes = prints.groupBy(F.col("simhash").alias("code")).agg(F.min("id").alias("low"))
    codes = stored(codes, "codes")
    found = components(near_links(codes.select("code"), radius, bucket_rows, levels))
    rooted = codes.join(found, codes.code == found.node, "left").select(
        "code", "low", F.coalesce("root", "code").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    classes = rooted.join(dealt_anew(lowest, ["root"]), "root").select(F.col("code").alias("simhash"), "component", "root")
    return prints.join(classes, "simhash").select(F.col("id").alias(id), "simhash", "component", "root", "text_hash")


def keep_one(docs: DataFrame, groups: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: in each group the document with the smallest id.

    Of several rows with that id in a group, the one with the smallest text hash; where two groups
    have one smallest id, each keeps its own row. Rows with a null id cannot be named by a group
    and always stay.
    """
    heads = groups.where(F.col(id) == F.col("component")).groupBy("root", F.col(id).alias("head"))
    heads = heads.agg(F.min("text_hash").alias("text")).select("head", "text")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # apart from the columns named here
    rows = docs.select(whole, docs[id].alias("id"), F.xxhash64(docs[text]).alias("hash"))
    kept = rows.join(heads, (F.col("id") == F.col("head")) & (F.col("hash") == F.col("text")))
    order = Window.partitionBy("id", "hash").orderBy(F.lit(1))
    kept = kept.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")
    return kept.union(docs.where(F.col(id).isNull()))
