from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from crewlytics.llm import pattern_packing, token_files
from crewlytics.llm.queries import tokenizer_path
from crewlytics.llm.tokens import Encoder

FILES = {"leading": "byte_bpe_50k.json", "dropped": "word_bpe_49k.json"}


def ids_of(spaces: str, texts: list) -> list[list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(FILES[spaces]))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("spaces", FILES)
def test_pieces_give_the_library_s_ids(spaces):
    pick = random.Random(2)
    alphabet = ["a", "Word", "'s", " ", "  ", "\n", " \n", "\t", "é", "\u00a0", "\u2003", "e\u0301", ".", "12", "ß", "\u0301",
                "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "\x1c", "\u3000", "Σ", "\r\n", "中文", "😀", "don't"]
    texts = ["".join(pick.choices(alphabet, k=pick.randrange(30))) for _ in range(400)] + [None, "", " ", "\n\n", "a ", " a"]
    encoder = Encoder(tokenizer_path(FILES[spaces]), spaces)
    for _ in range(2):  # the second time from memory
        found = encoder.encode(pa.array(texts, pa.string()))
        got = [found.flat[a:b].tolist() for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
        assert got == ids_of(spaces, texts)


def test_token_file_query(run, rows):
    docs = sorted(rows("documents"), key=lambda r: r["doc_id"])
    expected, start = {}, 0
    for r, ids in zip(docs, ids_of("dropped", [r["text"] for r in docs]), strict=True):
        expected[r["doc_id"]] = (start, len(ids) + 1, crc([*ids, 2]))
        start += len(ids) + 1
    found = run("op7_token_files")
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == expected


def test_token_files_of_odd_rows(spark, odd, none, tmp_path):
    path = tokenizer_path(FILES["dropped"])
    token_files.write_tokens(odd, str(tmp_path / "a"), path, "dropped", 2)
    meta = token_files.read_metadata(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in meta] == [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(meta, meta[1:]))
    some = token_files.read_tokens(spark, str(tmp_path / "a"), [2, 7])
    assert {r["doc_id"]: len(r["tokens"]) for r in some.collect()}[2] == 1
    plan = token_files.read_tokens(spark, str(tmp_path / "a"), [2, 7]).select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]
    token_files.write_tokens(none, str(tmp_path / "b"), path, "dropped", 2)
    assert token_files.read_metadata(spark, str(tmp_path / "b")).count() == 0


def pieces(ids: list[int], size: int = 2048):
    head = len(ids) - (-(-len(ids) // size) - 1) * size
    bounds = [0, *range(head, len(ids) + 1, size)]
    return [(a, ids[a:b]) for a, b in zip(bounds, bounds[1:])]


def check_places(rows: list[dict], size: int) -> int:
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_packing_query(run, rows):
    docs = rows("documents")
    expected = {}
    for r, ids in zip(docs, ids_of("leading", [r["text"] for r in docs]), strict=True):
        for n, (start, part) in enumerate(pieces([*ids, 0])):
            expected[r["doc_id"], n] = (start, len(part), crc(part))
    found = run("op3_pattern_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == expected
    assert len(found) == len(expected)
    bound = -(-sum(r["length"] for r in found) // 2048)
    assert check_places(found, 2048) <= bound * 1.02 + 2


def test_packing_of_odd_rows(odd, none):
    path = tokenizer_path(FILES["leading"])
    rows = [r.asDict() for r in pattern_packing.pack(odd, path, 64, 0, keep_ids=True).collect()]
    check_places(rows, 64)
    assert all(len(r["ids"]) == r["length"] and crc(r["ids"]) == r["ids_crc32"] for r in rows)
    texts = [r["text"] for r in odd.collect()]
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in ids_of("leading", texts))
    assert pattern_packing.pack(none, path).count() == 0


@pytest.mark.parametrize("size", [16, 100, 2048])
def test_plans_place_every_piece(size):
    pick = np.random.default_rng(size)
    for scale in (1, 40, 3000):
        counts = pick.poisson(scale * pick.random(size + 1) ** 3)
        counts[0] = 0
        plan = pattern_packing.best_plan(counts, size)
        placed = np.zeros(size + 1, np.int64)
        for n, room, held in plan.groups:
            assert n > 0 and sum(length * copies for length, copies in held) + room == size
            for length, copies in held:
                placed[length] += n * copies
        assert (placed == counts).all()
        pairless = int(counts[size // 2 + 1 :].sum())  # no two of these share a sequence
        bound = max(-(-int((counts * np.arange(size + 1)).sum()) // size), pairless)
        assert bound <= plan.sequences <= 1.16 * bound + 1


def test_least_squares_against_projected_gradients():
    pick = np.random.default_rng(4)
    a, b = pick.random((20, 35)), pick.random(20) * 9
    x = pattern_packing.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope[x > 0]).max() < 1e-6
