from __future__ import annotations

import collections
import random
import re

import pytest

from crewlytics.llm import collocations


def expected(rows, at_least=10, inside=50, top=2000):
    """The phrases by counting every one, from (lang, text)."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, *words[i : i + size]] += 1
    found, gone = [], set()
    for (lang, *w), a in f.items():
        if len(w) == 1 or a < at_least:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        found.append((lang, w, a, f[lang, *w[:k]], f[lang, *w[k:]], score))
        if len(w) == 3:
            gone |= {(lang, *part) for part in (w[:2], w[1:]) if 100 * a >= inside * f[lang, *part]}
    by = collections.defaultdict(list)
    for lang, w, a, left, right, score in found:
        if (lang, *w) not in gone:
            by[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, all_ in by.items()
        for i, (s, a, p, left, right) in enumerate(sorted(all_)[:top], 1)
    }


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("shards", "positions"), [(1, 1 << 10), (2, 1 << 16), (3, 4), (5, 1 << 12)])
def test_counts_do_not_depend_on_shards_and_positions(spark, shards, positions):
    """Few positions clash all the time and activate phrases early; the counts stay exact."""
    pick = random.Random(shards)
    words = ["a", "B", "b", "the", "É", "new", "york", "new york", "x.y", "city!", ";", "\t", "\n", "wörd"]
    rows = [(pick.choice(["en", "de", None]), " ".join(pick.choices(words, k=pick.randrange(40)))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = found(collocations.collocations(docs, 3, 50, 25, shards, positions))
    assert got == expected(rows, 3, 50, 25)


def test_phrases_that_arrive_late(spark):
    """Parts that reach the threshold in the last shard, phrases that occur before and after."""
    rows = [("en", "alpha beta gamma")] * 9 + [("en", "filler")] * 50 + [("en", "alpha beta gamma, alpha beta gamma")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = found(collocations.collocations(docs, 15, 50, 10, 4, 1 << 10))
    assert got == expected(rows, 15, 50, 10)
    assert got == {("en", 1, "alpha beta gamma", 15, 15, 15, 95, 1_000_000)}


def test_odd_rows(spark, odd, none):
    docs = odd.selectExpr("*", "cast(null as string) as lang", "'x' as w1", "1 as c", "1 as shard")
    rows = [(None, r["text"]) for r in odd.collect()]
    assert found(collocations.collocations(docs, 2, 50, 100)) == expected(rows, 2, 50, 100)
    assert collocations.collocations(none.selectExpr("*", "'en' as lang")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(none.selectExpr("*", "'en' as lang"), positions=1000)


def test_ties_follow_the_bytes_of_the_phrase(spark):
    rows = [("x", f"{a} {b}.") for a, b in (("z", "z"), ("é", "a"), ("a", "é"), ("b", "a")) for _ in range(3)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(found(collocations.collocations(docs, 3, 50, 3)), key=lambda r: r[1])
    assert {tuple(r) for r in got} == expected(rows, 3, 50, 3) and len(got) == 3


def test_scores_pass_64_bits(spark):
    a, left, right = 4_000_000_000_000, 5_000_000_000_000, 9_000_000_000_000
    one = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    score = one.select(collocations.score("a", "l", "r").alias("s")).first()["s"]
    assert score == 1_000_000 * a * a // (left * right)
