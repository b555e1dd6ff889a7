"""Phrases whose words belong together, counted by dynamic itemset counting.

The documents are dealt to shards, which are scanned in turn, round and round. Words are counted
from the first shard on. A longer phrase is activated as soon as both of its shorter parts (all
words but the last, all but the first) have reached the threshold, whatever shard that happens in,
and is counted from the next shard on until it has seen each shard once; so in one scan words,
pairs and triples are counted side by side. A part occurs at least as often as the phrase, so
every phrase that reaches the threshold is activated in time and its count is exact.

Tasks learn of parts that have reached the threshold from two arrays of a fixed size: a part's hash
names two positions, each of which holds the first scan after which some part there had reached
it. A clash of positions activates a phrase early, which costs work but changes no count: a
phrase's first scan is a function of the arrays alone, the same in every task, and each phrase is
counted for one full round. A word is told from others, and from the same word in another language,
by a 64-bit hash; a phrase is a row of such hashes, and the texts of words are kept beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlytics.llm.scratch import discard, stored
from crewlytics.llm.text_arrays import bytes_of, cut_runs, hash_ranges, mix, tidy
from crewlytics.llm.tokens import slices

SHARDS = 2  # more make phrases active earlier, but the counts so far are dealt out once per scan
POSITIONS = 1 << 23  # bytes of each array that a task gets; a power of two below 2**31
NEVER = 255
SLICE_BYTES = 4 << 20
BUCKETS = 64
TAG = 256  # a row's tag is its number of words times this, plus the scan that it is counted from
ROWS = "tag int, word string, w1 long, w2 long, w3 long, c long"
KEY = ["tag", "word", "w1", "w2", "w3"]
BREAKS = b".,;:!?\n\x0b\x0c\r"
U64 = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _reached(where: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The scan after which each part had reached the threshold, as far as its positions tell."""
    low = U64(len(where) - 1)
    return np.maximum(where[h & low], where[(h >> U64(32)) & low])


def _pair_hash(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return w1 ^ ((w2 << U64(21)) | (w2 >> U64(43)))


def _positions(positions: int) -> list[Column]:
    """The same two positions of a part in a table of counts."""
    pair = "w1 ^ (shiftleft(w2, 21) | shiftrightunsigned(w2, 43))"
    h = f"case when tag < {2 * TAG} then w1 else {pair} end"
    return [F.expr(f"({h}) & {positions - 1}L"), F.expr(f"shiftrightunsigned({h}, 32) & {positions - 1}L")]


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct tuple is, and how many there are.

    Tuples are sorted by one hash of all their parts; should two of a slice share it, by the parts.
    """
    joint = mix(keys[0].astype(U64) + U64(0x9E3779B97F4A7C15))
    for key in keys[1:]:
        joint = mix(joint ^ key.astype(U64)) * U64(0xC4CEB9FE1A85EC53)
    order = np.argsort(joint)
    changes = joint[order][1:] != joint[order][:-1]

    def told_apart() -> np.ndarray:
        told = np.zeros(len(changes), bool)
        for key in keys:
            told |= key[order][1:] != key[order][:-1]
        return told

    if (told_apart() != changes).any():
        order = np.lexsort(keys)
        changes = told_apart()
    heads = np.flatnonzero(np.r_[np.ones(min(1, len(order)), bool), changes])
    return order[heads], np.diff(np.r_[heads, len(order)])


class Slice:
    """The words of some texts: hash, language and piece of each, and where each begins and ends."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        import xxhash

        data, offsets = bytes_of(texts)
        capital = (data >= 65) & (data <= 90)
        self.data = np.where(capital, data | 32, data).astype(np.uint8)
        breaks = np.isin(self.data, np.frombuffer(BREAKS, np.uint8))
        words = cut_runs(self.data, offsets, ~(breaks | (data == 32) | (data == 9)))
        self.starts, self.ends = words.starts, words.ends
        text = words.text
        self.piece = np.cumsum(breaks)[self.starts] + text  # both parts only grow
        codes = langs.dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[text]
        seeds = np.array([xxhash.xxh64_intdigest(name.encode()) for name in self.langs], U64)
        self.hash = mix(hash_ranges(self.data, self.starts, self.ends) ^ seeds[self.lang])

    def runs(self, size: int) -> np.ndarray:
        """Where ``size`` words of one piece begin."""
        last = len(self.piece) - size + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:last] == self.piece[size - 1 :])

    def counts(self, size: int, at: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        """One row per distinct phrase that begins at one of the places ``at``."""
        keys = [self.hash[at + k] for k in range(size)]
        first, n = _grouped(keys)
        rows = len(first)
        if size == 1:
            raw, where = self.data.tobytes(), at[first]
            spans = zip(self.lang[where].tolist(), self.starts[where].tolist(), self.ends[where].tolist(), strict=True)
            words = pa.array([f"{self.langs[x]}\t{raw[a:b].decode()}" for x, a, b in spans], pa.string())
        else:
            words = pa.nulls(rows, pa.string())
        columns = [_signed(np.ascontiguousarray(key[first])) for key in keys]
        columns += [pa.array(np.zeros(rows, np.int64))] * (3 - size)
        tag = pa.array((start[first] + size * TAG).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [tag, words, *columns, pa.array(n.astype(np.int64))], ["tag", "word", "w1", "w2", "w3", "c"]
        )


def scan(docs: DataFrame, step: int, shards: int, reached) -> DataFrame:
    """Counts of ``docs`` (lang, text) in scan ``step``: of the phrases that are active in it.

    ``reached`` is a broadcast pair of position arrays, for words and for pairs.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = reached.value
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                part = Slice(batch.column(0), batch.column(1))
                if step < shards:
                    every = np.arange(len(part.hash))
                    yield part.counts(1, every, np.zeros(len(every), np.int64))
                of_word = _reached(words, part.hash).astype(np.int64)
                at = part.runs(2)
                start = 1 + np.maximum(of_word[at], of_word[at + 1])
                on = (start <= step) & (step < start + shards)
                yield part.counts(2, at[on], start[on])
                at = part.runs(3)
                if (pairs != NEVER).any():
                    joint = _pair_hash(part.hash[:-1], part.hash[1:]) if len(part.hash) else part.hash
                    of_pair = _reached(pairs, joint).astype(np.int64)
                    start = 1 + np.maximum(of_pair[at], of_pair[at + 1])
                    on = (start <= step) & (step < start + shards)
                    yield part.counts(3, at[on], start[on])

    return docs.mapInArrow(run, ROWS)


def _mark(counts: DataFrame, at_least: int, reached: tuple[np.ndarray, np.ndarray], step: int) -> bool:
    """Notes in the arrays which parts have reached the threshold; tells whether any position is new.

    What comes to the driver are bitmaps of the positions, at most one bit for each.
    """
    parts = counts.where(f"tag < {3 * TAG} and c >= {at_least}")
    places = parts.select(F.expr(f"tag div {TAG}").alias("size"), F.explode(F.array(*_positions(len(reached[0])))).alias("p"))
    number, bit = F.expr("bitmap_bucket_number(p + 1)"), F.expr("bitmap_bit_position(p + 1)")
    maps = places.groupBy("size", number.alias("b")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    news = False
    for size, bucket, bits in maps.toLocalIterator():
        on = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
        at = on + (bucket - 1) * 8 * len(bits)
        fresh = at[reached[size - 1][at] == NEVER]
        reached[size - 1][fresh] = step
        news |= bool(len(fresh))
    return news


def phrase_counts(
    docs: DataFrame, at_least: int, shards: int = SHARDS, positions: int = POSITIONS,
    lang: str = "lang", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of up to three words that occur ``at_least`` times, and words per language.

    The first table has (size, word, w1, w2, w3, c): words by hash and text, which is the language, a
    tab and the word, phrases by the hashes of their words. The second has (lang, n), all words of a
    language.
    """
    if not 1 <= shards <= 80:
        raise ValueError("shards must be between 1 and 80")
    if positions & (positions - 1) or not 1 <= positions <= 1 << 30:
        raise ValueError("positions must be a power of two up to 2**30")
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    shard = F.pmod("row", F.lit(shards)).cast("int").alias("shard")
    dealt = stored(rows.repartition("row").select("lang", "text", shard), "shards", "shard")
    reached = np.full(positions, NEVER, np.uint8), np.full(positions, NEVER, np.uint8)
    running, done, totals = None, [], None
    for step in range(3 * shards):
        sent = spark.sparkContext.broadcast(reached)
        found = scan(dealt.where(F.col("shard") == step % shards).select("lang", "text"), step, shards, sent)
        both = found if running is None else found.union(running.where(f"tag % {TAG} > {step - shards}"))
        merged = stored(both.groupBy(*KEY).agg(F.sum("c").alias("c")), "phrases")
        if running is not None:
            discard(running)
        running = merged
        sent.unpersist()
        if step == shards - 1:
            words = merged.where(f"tag < {2 * TAG}").select(_lang(), "c")
            totals = stored(words.groupBy("lang").agg(F.sum("c").alias("n")), "words")
        if step >= shards - 1:
            over = merged.where(f"tag % {TAG} = {step - shards + 1} and c >= {at_least}")
            size = F.expr(f"tag div {TAG}").alias("size")
            done.append(stored(over.select(size, "word", "w1", "w2", "w3", "c"), "counted"))
        reached = reached[0].copy(), reached[1].copy()
        news = _mark(merged, at_least, reached, step)
        if step >= shards - 1 and not news and merged.where(f"tag % {TAG} > {step - shards + 1}").isEmpty():
            break
    discard(running)
    discard(dealt)
    counted = done[0]
    for table in done[1:]:
        counted = counted.union(table)
    return counted, totals


def _lang() -> Column:
    return F.expr("substring(word, 1, length(word) - length(substring_index(word, '\\t', -1)) - 1)").alias("lang")


def _whole(name: str) -> Column:
    return F.col(name).cast("decimal(14,0)")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 37 digits."""
    top = F.lit(1_000_000).cast("decimal(7,0)") * (_whole(a) * _whole(a))
    return F.call_function("div", top, _whole(left) * _whole(right))


def collocations(
    docs: DataFrame, at_least: int = 10, inside_percent: int = 50, top: int = 2000,
    shards: int = SHARDS, positions: int = POSITIONS, lang: str = "lang", text: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words per language.

    A phrase of ``a`` >= ``at_least`` occurrences scores floor(1000000 a a / (l r)) at its worst cut,
    ``l`` and ``r`` being the occurrences of what is left and right of it; of equal cuts the first
    counts. A pair inside a triple that has ``inside_percent`` or more of its occurrences is left out.
    Ranked by score, ``a`` and the phrase's bytes. Null and empty texts have no words, a null
    language is ``und``; repeated rows count each time; other columns are not read; an empty table
    gives an empty result. Texts of any length are read whole, one at a time.
    """
    counted, totals = phrase_counts(docs, at_least, shards, positions, lang, text)
    words = counted.where("size = 1").select(
        _lang(), F.col("w1").alias("w"), F.substring_index("word", "\t", -1).alias("t"), F.col("c").alias("f")
    )
    pairs = counted.where("size = 2").select("w1", "w2", "c")
    triples = counted.where("size = 3").select("w1", "w2", "w3", "c")

    def with_word(df: DataFrame, k: int, *more: str) -> DataFrame:
        side = words.select(F.col("w").alias(f"w{k}"), F.col("t").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *more)
        return df.join(side, f"w{k}")

    longer = triples.select("c", F.expr("inline(array(struct(w1 as x, w2 as y), struct(w2 as x, w3 as y)))"))
    longer = longer.toDF("m", "w1", "w2").groupBy("w1", "w2").agg(F.max("m").alias("m"))
    kept = pairs.join(longer, ["w1", "w2"], "left").where(f"m is null or 100 * m < {inside_percent} * c")
    kept = with_word(with_word(kept, 1, "lang"), 2)
    two = kept.select(
        "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("c").alias("a"), F.col("f1").alias("l"),
        F.col("f2").alias("r"), score("c", "f1", "f2").alias("score"),
    )
    head = pairs.select("w1", "w2", F.col("c").alias("f12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("c").alias("f23"))
    cut = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
    cut = with_word(with_word(with_word(cut, 1, "lang"), 2), 3)
    cut = cut.withColumns({"s1": score("c", "f1", "f23"), "s2": score("c", "f12", "f3")})
    three = cut.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("c").alias("a"),
        F.expr("if(s1 <= s2, f1, f12)").alias("l"), F.expr("if(s1 <= s2, f23, f3)").alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    every = stored(two.union(three), "collocations")
    # in two steps, so that the task that ranks a language gets a bounded number of rows
    order = "order by score desc, a desc, phrase"
    part = f"partition by lang, pmod(xxhash64(phrase), {BUCKETS})"
    some = every.withColumn("rank", F.expr(f"row_number() over ({part} {order})")).where(f"rank <= {top}")
    ranked = some.withColumn("rank", F.expr(f"row_number() over (partition by lang {order})")).where(f"rank <= {top}")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
