from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from crewlytics.llm import simhash_gray, substring_rlz
from crewlytics.llm.components import _stars, components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_query(run, rows):
    docs = rows("documents")
    prints = [fingerprint(r["text"]) for r in docs]
    roots, low = groups(prints, 4), {}
    for r, g in zip(docs, roots, strict=True):
        low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    expected = {r["doc_id"]: (f"{p:016x}", low[g]) for r, p, g in zip(docs, prints, roots, strict=True)}
    found = run("op4_simhash_gray")
    assert len(found) == len(docs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == expected


@pytest.mark.parametrize(("bucket_rows", "levels"), [(2048, 3), (6, 1), (6, 2), (3, 3)])
def test_links_of_a_crowded_neighbourhood(spark, bucket_rows, levels):
    """One dense cluster, so that buckets overflow at every level and chunks have to meet."""
    pick = random.Random(5)
    centre = pick.getrandbits(64)
    codes = {centre}
    for _ in range(150):
        code = centre
        for _ in range(pick.randrange(1, 9)):
            code ^= 1 << pick.randrange(64)
        codes.add(code)
    codes |= {pick.getrandbits(64) for _ in range(60)}
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    links = simhash_gray.near_links(df, 4, bucket_rows, levels)
    root = dict(components(links).collect())
    expected = groups(codes, 4)
    pairs = {(root.get(s, s), g) for s, g in zip(signed, expected, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(expected))


def test_simhash_of_odd_rows(odd, none):
    found = simhash_gray.simhash_groups(odd)
    rows = [(r["doc_id"], r["simhash"], r["component"]) for r in found.collect()]
    assert len(rows) == odd.count()
    by_id = collections.defaultdict(set)
    for i, _, c in rows:
        by_id[i].add(c)
    assert by_id[1] == by_id[2] == by_id[3] == {1}
    assert by_id[8] == {7} and by_id[None] == {None}
    kept = simhash_gray.keep_one(odd, found)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7", "9", "None", "None"]
    assert simhash_gray.simhash_groups(none).count() == 0


def test_groups_that_share_an_id(spark):
    """Rows of one id in two groups are each kept for their group; copies in a group are not."""
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b"))
    rows = [(8, one), (8, two), (8, two), (9, one), (10, two), (11, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash_gray.keep_one(docs, simhash_gray.simhash_groups(docs))
    found = sorted((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert found == [(8, one), (8, two), (11, "")]


def test_components(spark):
    pick = random.Random(3)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)]
    links += [(1000 + k, 1001 + k) for k in range(40)] + [(0, k) for k in range(300, 600)] + [(5, None), (7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in root if find(x) != x} | {
        x: found[x] for x in found if find(x) == x and found[x] == x
    }
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_a_hot_node_are_split(spark, tmp_path):
    """The join on the node that most links share is split at run time."""
    links = spark.range(1, 60_000).selectExpr("if(id % 3 = 0, id, id div 500 + 100000) as root", "id + 200000 as node")
    hot = spark.range(1, 40_000).selectExpr("7 as root", "id + 500000 as node")
    links.union(hot).selectExpr("cast(node as long) as node", "cast(root as long) as root").repartition(8).write.parquet(
        str(tmp_path / "links")
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        after = _stars(spark.read.parquet(str(tmp_path / "links")))
        found = after.collect()
        assert "SortMergeJoin(skew=true)" in after._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["root"] == 7 for r in found) == 39_999


def cut(docs: list[dict], window: int = 13) -> dict:
    words = {r["doc_id"]: WORDS.findall(r["text"] or "") for r in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_query(run, rows):
    found = run("op2_substring_rlz")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == cut(rows("documents"))


def test_substrings_over_many_chunks(spark, monkeypatch):
    """Tiny chunks, so that every passage is found across reference blocks, also at factor ends."""
    monkeypatch.setattr(substring_rlz, "CHUNK_BYTES", 300)
    pick = random.Random(1)
    passages = [[f"p{k}_{i}" for i in range(pick.randrange(8, 40))] for k in range(12)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(pick.randrange(1, 5)):
            passage = pick.choice(passages)
            a = pick.randrange(len(passage))
            words += passage[a:] + [f"own{pick.randrange(30)}" for _ in range(pick.randrange(3))]
        docs.append({"doc_id": 7 * i % 61, "text": " ".join(words)})
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").repartition(5)
    expected = cut(docs)
    for r in substring_rlz.remove_repeats(df).collect():
        kept = hashlib.sha256(" ".join(WORDS.findall(r["text"])).encode()).hexdigest()
        assert (r["n_words"], r["n_removed"], kept) == expected[r["doc_id"]]


def test_substrings_of_odd_rows(odd, none):
    found = substring_rlz.remove_repeats(odd.withColumnRenamed("rank", "n_words"))
    rows = found.collect()
    assert found.columns == ["doc_id", "text", "component", "n_words", "n_removed"] and len(rows) == odd.count()
    removed = collections.Counter((r["doc_id"], r["n_removed"]) for r in rows if r["n_removed"])
    assert removed == {(8, 60): 2}
    assert {r["text"] for r in rows if r["doc_id"] == 8} == {""}
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in (1, 3, 6)} == {
        r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] in (1, 3, 6)
    }
    assert substring_rlz.remove_repeats(none).count() == 0


def test_keep_one_beside_columns_of_any_name(spark):
    rows = [(1, "one two three four five", "a", 1), (2, "one two three four five", "b", 2), (3, "another text here", "c", 3)]
    for names in (("_head", "_nth"), ("_text", "hash"), ("row", "head"), ("root", "component")):
        docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
        kept = simhash_gray.keep_one(docs, simhash_gray.simhash_groups(docs))
        assert kept.columns == docs.columns
        assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
