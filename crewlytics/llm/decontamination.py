"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased; shingles have ``shingle`` words (fewer where an
item is shorter). All steps are DataFrame operations.

1. A window like an item (weighted shingle similarity of ``similarity`` or more) has at least that
   share of the item's shingles. So of the item's shingles a share of a little over
   ``1 - similarity`` is enough as seeds: such a window has one of them. A document's words meet
   the longest word of each seed; windows of the item's size around a seed are the ones to judge.
2. Each window gets a 64-bit SimHash of its shingles. Windows and items of one size are dealt to
   ``radius + 1`` blocks of bits; two fingerprints within ``radius`` agree on one block at least,
   so the join of the blocks misses none of them. An item that repeats a shingle skips this step:
   its windows are all those around one of its own seeds.
3. Each candidate is verified by its exact weighted similarity: shared shingles over all, with
   their counts.

At a similarity of 0.8 fingerprints of distinct shingles differ in about 10 bits, with a deviation
of 3, so the default radius of 20 is more than three deviations out. With few shingles that repeat
they can differ in far more, which is why such items skip the fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlytics.llm.scratch import stored

BITS = 64
BROADCAST_ROWS = 500_000  # seeds or item blocks up to this number are sent to all tasks
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
GAP = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; one empty word where there are none."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), EDGE, ""), GAP, -1)


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is short enough; it has to be a stored table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingles(words: str, n: str, w: str) -> str:
    return f"transform(sequence(0, {n} - {w}), o -> xxhash64(array_join(slice({words}, o + 1, {w}), ' ')))"


def prepared_items(items: DataFrame, shingle: int, id: str, text: str) -> DataFrame:
    """(item, words, m, w, sh): the items that have a word, with their shingles' hashes."""
    rows = items.select(F.col(id).alias("item"), words_of(F.col(text)).alias("words"))
    rows = rows.where("words[0] <> ''").withColumn("m", F.size("words"))
    rows = rows.withColumn("w", F.least("m", F.lit(shingle)))
    return rows.withColumn("sh", F.expr(_shingles("words", "m", "w")))


def _chosen(items: DataFrame, similarity: float) -> DataFrame:
    """(item, m, w, s): enough shingles ``s`` of each item; those with the longest words, as the rarest."""
    part = "slice(words, o + 1, w)"
    longest = f"array_max(transform({part}, x -> length(x)))"
    one = f"struct({longest} as size, o as o, array_join({part}, ' ') as run, {part} as part)"
    count = f"cast(floor((1 - {similarity}D) * size(sh) + 1e-9) as int) + 1"
    chosen = f"slice(sort_array(transform(sequence(0, m - w), o -> {one}), false), 1, {count})"
    return items.select("item", "m", "w", F.explode(F.expr(chosen)).alias("s"))


def seeds_of(items: DataFrame, similarity: float) -> DataFrame:
    """(word, back, run, w, m): enough shingles of each item, found by their longest word.

    ``run`` is the shingle's text and ``back`` the place of the word in it.
    """
    rows = _chosen(items, similarity)
    back = "array_position(transform(s.part, x -> length(x)), s.size) - 1"
    rows = rows.select("m", "w", F.expr(f"cast({back} as int)").alias("back"), "s.run", F.col("s.part").alias("part"))
    return rows.select(F.expr("part[back]").alias("word"), "back", "run", "w", "m").distinct()


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the hashes in ``h``, over the rows of each key: 32 sums of two counters each."""
    lanes = 2
    sums = [
        F.sum(F.expr(" + ".join(f"((shiftright(h, {lane * 32 + q}) & 1L) * {1 << (32 * lane)}L)" for lane in range(lanes)))).alias(f"s{q}")
        for q in range(32)
    ]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("k"), *sums)
    bits = " | ".join(
        f"shiftleft(cast(2 * {f'(s{q} & 4294967295L)' if lane == 0 else f'shiftright(s{q}, 32)'} > k as long), {lane * 32 + q})"
        for q in range(32)
        for lane in range(lanes)
    )
    return counted.select(*keys, F.expr(bits).alias("fp"))


def _blocks(rows: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once per block, with the block's bits."""
    cuts = [BITS * b // (radius + 1) for b in range(radius + 2)]
    parts = [
        F.struct(F.lit(b).alias("block"), F.expr(f"shiftrightunsigned(fp, {low}) & {(1 << (high - low)) - 1}L").alias("bits"))
        for b, (low, high) in enumerate(zip(cuts, cuts[1:]))
    ]
    return rows.withColumn("b", F.explode(F.array(*parts))).select("*", "b.block", "b.bits").drop("b")


def _numbered(sh: str) -> str:
    """Hashes told apart by how often they came before, so that sets count repeats."""
    again = f"size(filter(slice({sh}, 1, i + 1), y -> y = x))"
    return f"case when size(array_distinct({sh})) = size({sh}) then {sh} else transform({sh}, (x, i) -> xxhash64(x, {again})) end"


def contaminated(
    docs: DataFrame, items: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20,
    id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, id, item id, start_word, n_words, similarity): every document like an item, and where.

    One row per document and item, for the most similar window (the first of several). Windows have
    the item's number of words; a shorter document is one window. ``key`` is a hash of id and text
    that tells rows with one id apart; equal rows have one key and give one row. Null or empty
    texts and items without a word are like nothing. Other columns are not read.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("id", "text"))
    wanted = stored(prepared_items(items, shingle, item_id, item_text), "items")
    seeds = _bounded(stored(seeds_of(wanted, similarity), "seeds"))

    cut = docs.select("key", words_of(F.col("text")).alias("words"))
    met = cut.select("key", "words", F.posexplode("words").alias("pos", "word")).join(seeds, "word")
    met = met.withColumn("at", F.expr("pos - back")).where("at >= 0 and at + w <= size(words)")
    met = met.where("array_join(slice(words, at + 1, w), ' ') = run")
    hits = stored(met.select("key", F.size("words").alias("n"), "at", "w", "m").distinct(), "seed-hits")

    names = stored(hits.select("key").distinct(), "documents-with-seeds")
    near = docs.join(names, "key").dropDuplicates(["key"])
    near = near.select("key", "id", words_of(F.col("text")).alias("words"))
    sizes = hits.select("key", "w").distinct()
    near = near.join(sizes, "key").select("key", "id", "w", F.expr(_shingles("words", "size(words)", "w")).alias("doc_sh"))
    near = stored(near, "shingled")

    starts = F.expr("sequence(greatest(0, least(at + w - m, n - m)), greatest(0, least(at, n - m)))")
    windows = hits.select("key", "w", "m", F.least("n", "m").alias("size"), F.explode(starts).alias("start")).distinct()
    windows = windows.join(near, ["key", "w"])
    keys = ["key", "w", "m", "size", "start"]
    hashes = windows.select(*keys, F.explode(F.expr("slice(doc_sh, start + 1, size - w + 1)")).alias("h"))
    prints = _fingerprint(hashes, keys)
    distinct = "size(array_distinct(sh)) = size(sh)"
    item_prints = _fingerprint(wanted.where(distinct).select("item", "m", F.explode("sh").alias("h")), ["item", "m"])
    item_blocks = _bounded(stored(_blocks(item_prints.withColumnRenamed("fp", "item_fp").withColumn("fp", F.col("item_fp")), radius).drop("fp"), "item-blocks"))

    pairs = _blocks(prints, radius).join(item_blocks, ["m", "block", "bits"])
    pairs = pairs.where(f"bit_count(fp ^ item_fp) <= {radius}").select(*keys, "item").distinct()
    again = _chosen(wanted.where(f"not ({distinct})"), similarity)
    again = stored(again.select("item", "m", "w", F.xxhash64("s.run").alias("h")).distinct(), "seeds-of-repeats")
    if not again.isEmpty():
        around = hits.join(near, ["key", "w"]).withColumn("h", F.expr("doc_sh[at]"))
        around = around.join(_bounded(again), ["m", "w", "h"])
        more = around.select("key", "w", "m", F.least("n", "m").alias("size"), F.explode(starts).alias("start"), "item")
        pairs = pairs.union(more.select(*keys, "item").distinct())
    pairs = pairs.join(near, ["key", "w"]).withColumn("win", F.expr("slice(doc_sh, start + 1, size - w + 1)"))
    pairs = pairs.join(wanted.select("item", "sh"), "item")
    shared = F.expr(f"size(array_intersect({_numbered('win')}, {_numbered('sh')}))")
    pairs = pairs.withColumn("shared", shared)
    alike = pairs.withColumn("similarity", F.expr("shared / (size(win) + size(sh) - shared)"))
    best = alike.where(F.col("similarity") >= similarity).groupBy("key", "item").agg(
        F.first("id").alias("id"),
        F.min(F.struct((-F.col("similarity")).alias("s"), "start", "size")).alias("best"),
    )
    return best.select(
        "key", F.col("id").alias(id), F.col("item").alias(item_id), F.col("best.start").alias("start_word"),
        F.col("best.size").alias("n_words"), (-F.col("best.s")).alias("similarity"),
    )


def drop_contaminated(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``found`` does not name, with all their columns."""
    keys = stored(found.select(F.col("key").alias("_key")).distinct(), "contaminated")
    return docs.join(keys, F.xxhash64(id, text) == keys["_key"], "left_anti")
