from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from crewlytics.llm.scratch import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    """Each stage against what its operator says of the stage's own input."""
    from test_dedup import cut, fingerprint, groups
    from test_documents import alike, base
    from test_tokens import ids_of

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, FOLDER), name)
        rows = {r["doc_id"]: r for r in after.collect()}
        assert set(rows) <= set(before)
        if name != "packed":
            assert after.columns == docs.columns and after.count() == len(rows)
        if name == "quality":
            assert not any(base(r["text"])[-1] for r in rows.values())
            assert len(rows) > 0.7 * len(before)
        if name == "near_duplicates":
            ids = sorted(before)
            roots = groups([fingerprint(before[i]["text"]) for i in ids], 4)
            assert set(rows) == {ids[g] for g in roots}
        if name == "substrings":
            expected = cut([{"doc_id": i, "text": r["text"]} for i, r in before.items()])
            assert set(rows) == set(before)
            for i, r in rows.items():
                assert len(r["text"].split()) == expected[i][0] - expected[i][1]
                assert r["text"] == before[i]["text"] or expected[i][1]
        if name == "decontaminated":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            gone = set(before) - set(rows)
            assert {i for i, _ in alike([(i, before[i]["text"]) for i in gone], items, 0.8)} == gone
        if name == "packed":
            tokens = collections.Counter()
            for r in after.collect():
                tokens[r["doc_id"]] += r["length"]
            ids = sorted(before)
            assert tokens == {i: len(x) + 1 for i, x in zip(ids, ids_of("leading", [before[i]["text"] for i in ids]), strict=True)}
        docs, before = after, rows
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


@pytest.mark.parametrize("rows", [0, 5])
def test_odd_inputs(spark, rows):
    odd = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x " * 40000, "en", "s", 5),
           (3, " ".join(f"word{i}," for i in range(50)), "en", "s", 1), (3, " ".join(f"word{i}," for i in range(50)), "en", "s", 1)]
    docs = spark.createDataFrame(odd[:rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
    assert [r["doc_id"] for r in docs.collect()] == ([3] if rows else [])
