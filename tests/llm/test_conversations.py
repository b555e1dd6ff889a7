from __future__ import annotations

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest

from crewlytics.llm import conversation_repair as repair

LEGAL = re.compile(r"(s?(ua)+)?")


def by_trying(rows: tuple) -> tuple[int, str]:
    """Cheapest repair of (initial, fault) rows by looking at all of them, written from the rules."""
    rows = list(rows)

    @functools.cache
    def best(i: int, kept: str) -> tuple[int, str]:
        """``kept`` is all that matters of the roles so far: "", "s", "u" or "a" as the last one."""
        options = [(0, "")] if i == len(rows) and kept in ("", "a") else []
        befores, last = [(0, "", kept)], kept
        for n in (1, 2):
            last = "a" if last == "u" else "u"
            befores.append((3 * n, "I" * n, last))
        if i == len(rows):
            return min(options + [(c, a) for c, a, k in befores if k in ("", "a")], default=(10**9, ""))
        initial, fault = rows[i]
        for cost, audit, last in befores:
            ways = [(4, "D", last)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (last, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    ways.append((more, "K", initial))
                ways.append((3 + more, "R", "a" if last == "u" else "u"))
            for price, letter, now in ways:
                rest = best(i + 1, now)
                options.append((cost + price + rest[0], audit + letter + rest[1]))
        return min(options)

    return best(0, "")


FAULTS = ["", "blank", "duplicate", "truncated"]


def coded(rows) -> bytes:
    return bytes("sua".find(i) % 4 + 4 * FAULTS.index(f) for i, f in rows)


def test_lattice_against_all_repairs():
    pick = random.Random(1)
    for n in [0] + [1] * 40 + [2] * 150 + [3] * 300 + [6] * 900 + [10] * 600 + [25] * 60:
        rows = tuple((pick.choice("suuaax"), pick.choice(["", "", "", *FAULTS])) for _ in range(n))
        assert repair.cheapest(coded(rows)) == by_trying(rows), rows


def test_lattice_of_many_rows():
    pick = random.Random(2)
    rows = [(pick.choice("ua"), pick.choice(["", "", "truncated"])) for _ in range(3000)]
    cost, audit = repair.cheapest(coded(rows))
    assert sum(c != "I" for c in audit) == 3000
    halves = [repair.cheapest(coded(part)) for part in (rows[:1500], rows[1500:])]
    assert cost <= halves[0][0] + halves[1][0]


def expected(rows: list[tuple]) -> dict:
    """conv_id to figures, audit and hash, from (conv_id, turn, role, text) by the rules."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, held in by.items():
        kept = []
        for turn, role, text in held:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            hit = zlib.crc32(key.encode()) % 20
            if hit:
                text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
                kept += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, seen = [], set()
        for _, role, text in kept:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = by_trying(tuple(zip(initials, faults)))
        said, last, i = [], "", 0
        for letter in audit:
            if letter != "I":
                _, role, text = kept[i]
                i += 1
            if letter == "D":
                continue
            new = "assistant" if last == "u" else "user"
            said.append(f"{role}:{text}" if letter == "K" else f"{new}:" if letter == "I" else f"{new}:{text}")
            last = said[-1][0]
        assert LEGAL.fullmatch("".join(s[0] for s in said))
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in FAULTS[1:]), illegal, cost, audit, digest)
    return out


def found(df) -> dict:
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_by_the_rules(run, rows):
    got = {r["conv_id"]: tuple(r.values())[1:] for r in run("op12_conversation_repair")}
    assert got == expected([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in rows("conversations")])


def damaged_and_repaired(spark, rows, parts=3):
    df = spark.createDataFrame(
        [(*r, "z", "z") for r in rows], "conv_id long, turn int, role string, text string, head string, audit string"
    )
    return repair.digests(repair.repair(repair.damage(df.repartition(parts)), gone="gone"))


def test_odd_rows(spark):
    pick = random.Random(4)
    texts = ["Yes.", "no", "", " \t\n", None, "Really?!", "long " * 60000 + ".", "ends  ", "ü.", "🙂"]
    rows = [
        (pick.choice([None, 1, 2, 3, 4, *range(20, 60)]), pick.choice([None, *range(12)]),
         pick.choice(["user", "assistant", "system", "tool", "", None]), pick.choice(texts))
        for _ in range(700)
    ]
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)]
    assert found(damaged_and_repaired(spark, rows)) == expected(rows)
    assert damaged_and_repaired(spark, []).count() == 0


def test_repeated_rows_and_conversations_without_rows(spark):
    gone = next(c for c in range(100, 10000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(100, 10000) if zlib.crc32(f"{c}:0".encode()) % 20 == 9)
    rows = [(gone, 0, "user", "Hi."), (whole, 0, "user", "Hi."), (whole, 0, "user", "Hi.")]
    got = found(damaged_and_repaired(spark, rows))
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[whole][2] == 1 and got[whole][6] == "KDI"


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 3, "user", "Hello?"), (1, 4, "assistant", "Yes."), (2, 0, "tool", "x.")]
    df = spark.createDataFrame(rows, "c long, t int, r string, x string")
    out = repair.repair(df, "c", "t", "r", "x").collect()
    one = [(r["place"], r["role"], r["text"]) for r in out if r["c"] == 1 and r["place"] is not None]
    assert one == [(0, "system", "Be kind."), (1, "user", "Hi."), (2, "assistant", ""), (3, "user", "Hello?"), (4, "assistant", "Yes.")]
    heads = {r["c"]: (r["gaps"], r["illegal"], r["cost"], r["audit"]) for r in out if r["place"] is None}
    assert heads == {1: (1, 1, 3, "KKIKK"), 2: (0, 0, 4, "D")}


@pytest.mark.parametrize("parts", [1, 7])
def test_result_does_not_depend_on_partitions(spark, rows, parts):
    given = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in rows("conversations")]
    assert found(damaged_and_repaired(spark, given, parts)) == expected(given)
