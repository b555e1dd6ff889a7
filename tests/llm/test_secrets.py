from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest

from crewlytics.llm import secret_grammar

RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]
LETTERS = string.ascii_letters + string.digits


def base(text: str | None):
    """The rules read one after the other, as they are stated."""
    spans = []
    for order, (kind, rule) in enumerate(RULES):
        for m in re.finditer(rule, text or "", re.A):
            long = len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)
            if long:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s[2] for s in sorted(spans)]


def value(pick, before: str, letters: str, n: int) -> str:
    return before + "".join(pick.choices(letters, k=n))


def ordinary(pick) -> str:
    return "".join(pick.choice(["thing", "ent", "ion", "re", "de", "der", "un", "str", "ed", "ly"]) for _ in range(8))


def test_query(run, rows):
    found = {r["doc_id"]: r for r in run("op11_secret_grammar")}
    docs = rows("documents")
    assert len(found) == len(docs)
    for doc in docs:
        spans, r = base(doc["text"]), found[doc["doc_id"]]
        counts = [sum(s.startswith(kind) for s in spans) for kind, _ in RULES]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        listed = r["spans"].split(",") if r["spans"] else []
        assert [s for s in listed if not s.startswith("format_")] == spans
        at = [(int(a), int(b)) for _, a, b in (s.split(":") for s in listed)]
        assert [a for a, _ in at] == sorted(a for a, _ in at)


PARTS = ["token", "TOKEN", "ſecret", "toKen", "api_key", "apikey", "passwd", "=", ":", " ", "  ", '"', "'", "\t", "abc", "abcdef",
         "AKIA", "AKIA" + "A1" * 8, "0" * 10, "deadbeef", "f" * 24, "é", ".", "-", "/", "x" * 16, "\n"]


def test_rules_against_their_statement():
    pick = random.Random(5)
    for _ in range(4000):
        text = "".join(pick.choices(PARTS, k=pick.randrange(14)))
        got = [f"{secret_grammar.KINDS[k]}:{s}:{e}" for s, k, e in secret_grammar.rule_spans(text)]
        assert got == base(text), text


def test_candidates_overlap_nothing_found():
    pick = random.Random(6)
    for _ in range(3000):
        text = "".join(pick.choices(PARTS, k=pick.randrange(14)))
        found = secret_grammar.rule_spans(text)
        runs = [m for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text)]
        wanted = []
        for m in runs:
            start = m.start() + len(m[0]) - len(m[0].lstrip(".-"))
            end = max(start, m.end() - (len(m[0]) - len(m[0].rstrip(".-"))))
            if end - start >= 16 and not any(s < end and e > start for s, _, e in found):
                wanted.append((start, end))
        assert secret_grammar.candidates(text, found) == wanted, text


def test_grammar_of_a_known_language():
    """(ab)* with an end after half of the pairs: two states, and the probabilities that made it."""
    pick = random.Random(1)
    values = []
    for _ in range(4000):
        n = 1
        while pick.random() < 0.5:
            n += 1
        values.append(b"ab" * n)
    g = secret_grammar.infer(values)
    assert g.states <= 3
    for n in range(1, 7):
        likelihood = 2 ** g.score([b"ab" * n])[0]
        assert likelihood == pytest.approx(0.5**n, rel=0.25)
    assert g.score([b"ba"])[0] < -15
    again = secret_grammar.infer(values[::-1])
    assert np.array_equal(again.bits, g.bits) and np.array_equal(again.after, g.after)


def test_likelihoods_by_walking_the_automaton():
    pick = random.Random(2)
    g = secret_grammar.infer([value(pick, "ghp_", LETTERS, 20).encode() for _ in range(300)])
    assert np.allclose((2.0**g.bits).sum(1), 1)
    values = [value(pick, pick.choice(["ghp_", "x", ""]), LETTERS, pick.randrange(40)).encode() for _ in range(50)]
    for v, score in zip(values, g.score(values), strict=True):
        state, total = 0, 0.0
        for c in v:
            total += g.bits[state, c]
            state = int(g.after[state, c])
        assert math.isclose(score, total + g.bits[state, 256])


@pytest.fixture(scope="module")
def corpus(spark):
    """Credentials with a name before them, the same formats bare, and ordinary long words."""
    pick = random.Random(3)
    formats = [("ghp_", LETTERS, 36), ("AKIA", string.ascii_uppercase + string.digits, 16), ("", "0123456789abcdef", 40)]
    rows, planted = [], {}
    for i in range(300):
        rows.append((i, f"the {ordinary(pick)} token = {value(pick, *formats[i % 3])}, {ordinary(pick)} ."))
    for i in range(300, 400):
        secret = value(pick, "ghp_", LETTERS, 36)
        planted[i] = f"{ordinary(pick)} \U0001f511 {secret}."
        rows.append((i, planted[i]))
    for i in range(400, 700):
        rows.append((i, f"{ordinary(pick)} www.{ordinary(pick)}.org/path {pick.randrange(10**15, 10**16)}"))
    return spark.createDataFrame(rows, "doc_id long, text string"), planted


def test_bare_credentials_are_found_by_their_format(corpus):
    docs, planted = corpus
    grammars = secret_grammar.train(docs)
    assert {"assign", "ordinary"} <= set(grammars)
    found = {r["doc_id"]: r["spans"] for r in secret_grammar.scan(docs, grammars).collect()}
    caught = 0
    for i, text in planted.items():
        at = text.index("ghp_")
        caught += [(s["start"], s["end"], s["kind"][:7]) for s in found[i]] == [(at, at + 40, "format_")]
    assert caught >= 95
    assert not any(found[i] for i in range(400, 700))
    assert all(any(s["kind"] == "assign" for s in found[i]) for i in range(300))


def test_odd_rows(spark, odd, none):
    docs = odd.selectExpr("*", "'x' as spans", "'y' as kind", "1 as h")
    grammars = secret_grammar.train(docs)
    rows = secret_grammar.scan(docs, grammars).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert len(rows) == 12 and texts
    assert all(not r["spans"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert secret_grammar.train(none) == {}
    assert secret_grammar.scan(none, {}).count() == 0


def test_examples_are_bounded_and_do_not_depend_on_partitions(spark, monkeypatch):
    pick = random.Random(9)
    rows = [(f"secret: {value(pick, '', LETTERS, 30)}",) for _ in range(500)]
    docs = spark.createDataFrame(rows, "text string")
    monkeypatch.setattr(secret_grammar, "EXAMPLES", 40)
    one = {tuple(r) for r in secret_grammar.labelled(docs.repartition(1)).collect()}
    many = {tuple(r) for r in secret_grammar.labelled(docs.repartition(7)).collect()}
    assert one == many and len(one) == 40


def test_long_credentials_are_learnt_and_found(spark, monkeypatch):
    """Bare values far longer than 200 characters, some longer than what a grammar is learnt from."""
    monkeypatch.setattr(secret_grammar, "LEARNT", 600)
    pick = random.Random(12)
    rows = [(i, f"token = {value(pick, 'eyJh.', LETTERS, pick.randrange(250, 900))} end") for i in range(120)]
    rows += [(120 + i, f"token = {value(pick, 'eyJh.', LETTERS, n)} end") for i, n in enumerate([250, 5000])]
    rows += [(i, f"www.{'/'.join(ordinary(pick) for _ in range(pick.randrange(1, 30)))}") for i in range(200, 400)]
    bare = {i: value(pick, "eyJh.", LETTERS, n) for i, n in enumerate([250, 300, 595, 596, 900, 1800, 4990], 400)}
    rows += [(i, f"bare {secret} end") for i, secret in bare.items()]
    rows.append((500, f"bare {value(pick, 'eyJh.', LETTERS, 5100)} end"))  # longer than all labelled ones
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grammars = secret_grammar.train(docs)
    assert grammars["assign"].lengths[1] == 5005
    found = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secret_grammar.scan(docs, grammars).collect()}
    for i, secret in bare.items():
        assert found[i] == [(5, "format_assign", 5 + len(secret))], len(secret)
    assert not any(found[i] for i in [*range(200, 400), 500])


def test_lengths_of_a_kind_are_those_of_all_its_values(spark, monkeypatch):
    """The sample that teaches a grammar does not bound the runs that are judged."""
    monkeypatch.setattr(secret_grammar, "EXAMPLES", 30)
    pick = random.Random(13)
    lengths = [pick.randrange(20, 3000) for _ in range(400)]
    rows = [(f"secret: {value(pick, '', LETTERS, n)}",) for n in lengths]
    docs = spark.createDataFrame(rows, "text string").repartition(5)
    found = secret_grammar.labelled(docs).collect()
    assert len(found) == 30
    assert {(r["shortest"], r["longest"]) for r in found} == {(min(lengths), max(lengths))}
    assert secret_grammar.train(docs)["assign"].lengths == (min(lengths), max(lengths))
