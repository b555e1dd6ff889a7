from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import zlib

import pytest

from crewlytics.llm import preference_chat, url_reputation, warc
from crewlytics.llm.queries import RULES, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    result = duck.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    expected = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: repr(sorted(r.items()))
    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(expected, key=key)


def test_archive_query(run, rows):
    first = {}
    for r in rows("pages"):
        body = (r["html"] or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        first.setdefault(digest, []).append((r["page_id"], len(body)))
    expected = set()
    for digest, held in first.items():
        low = min(held)[0]
        for i, n in held:
            again = n >= 100 and i != low
            expected.add((i, n, digest, "revisit" if again else "response", low if again else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert {tuple(r[n] for n in names) for r in run("op6_warc")} == expected


def test_archives_of_odd_rows(spark, tmp_path):
    long, big = "<p>" + "same " * 40, "x" * (20 << 20)
    rows = [(2, "http://a/ b\r\nc", long), (1, None, long), (1, "u", long), (None, "u", long), (3, "u", None), (4, "u", ""),
            (None, None, "short"), (5, "u", "short"), (None, "n", "n" * 200), (6, "u", big), (7, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_pages(pages, str(tmp_path / "a"))
    found = [r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()]
    assert len(found) == len(rows) and all(r["gap"] is None for r in found)
    got = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    n = len(long)
    assert got == sorted([
        ("urn:page:2", "revisit", "urn:page:1", n), ("urn:page:1", "response", None, n), ("urn:page:1", "response", None, n),
        ("urn:page:None", "revisit", "urn:page:1", n), ("urn:page:3", "response", None, 0), ("urn:page:4", "response", None, 0),
        ("urn:page:None", "response", None, 5), ("urn:page:5", "response", None, 5), ("urn:page:None", "response", None, 200),
        ("urn:page:6", "response", None, len(big)), ("urn:page:7", "revisit", "urn:page:6", len(big)),
    ])
    for file in (tmp_path / "a").glob("part-*"):
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n") or not file.stat().st_size
    warc.write_pages(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def made(i: int, body: bytes = b"") -> bytes:
    body = body or b"body %d WARC/1.1 inside \x1f\x8b\x08 " % i * 5
    return warc.record("response", f"urn:page:{i}", "u", body, hashlib.sha256(body).hexdigest(), None)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    """Records around damage come back, and gaps name exactly the bytes between."""
    parts = [warc.member(made(i)) if packed else made(i) for i in range(6)]
    whole = b"".join(parts)
    found = list(warc.salvage(whole))
    assert [r["fields"]["warc-record-id"] for _, _, r, _ in found] == [f"<urn:page:{i}>" for i in range(6)]
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    harmed = bytearray(whole)
    harmed[starts[1] + len(parts[1]) // 2] ^= 0x55  # inside one record
    harmed[starts[4] : starts[4] + 4] = b"junk"  # at the start of another
    broken = bytes(harmed)[:-3]  # the last one cut off
    found = list(warc.salvage(broken))
    ids = [r["fields"]["warc-record-id"] for _, _, r, _ in found if r]
    assert ids == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    gaps = [(a, b) for a, b, r, _ in found if r is None]
    assert gaps == [(starts[1], starts[2]), (starts[4], len(broken))]
    assert all(why for _, _, r, why in found if r is None)
    noise = b"\0\0noise" + whole + b"tail"
    assert [(a, b) for a, b, r, _ in warc.salvage(noise) if r is None] == [(0, 7), (7 + starts[6], len(noise))]


def ids_of(found):
    return [int(r["fields"]["warc-record-id"][10:-1]) for _, _, r, _ in found if r]


def test_salvage_inside_a_member():
    """One bad record of a member that unpacks costs that record alone."""
    parts = [made(i) for i in range(3)]
    a, b = len(parts[0]), len(parts[0] + parts[1])
    harmed = bytearray(b"".join(parts))
    harmed[b - 20] ^= 1
    whole = warc.member(made(7)) + warc.member(bytes(harmed)) + warc.member(made(8))
    found = list(warc.salvage(whole))
    assert ids_of(found) == [7, 0, 2, 8]
    begin, end = len(warc.member(made(7))), len(whole) - len(warc.member(made(8)))
    assert [f[:2] + f[3:] for f in found if f[2] is None] == [
        (begin, end, f"block digest; bytes {a} to {b} of the unpacked member at {begin}")
    ]
    for cut, left in ((bytes(harmed[:b]), [0]), (bytes(harmed[a:]), [2]), (bytes(harmed[a:b]), [])):
        found = list(warc.salvage(warc.member(cut) + warc.member(made(8))))
        assert ids_of(found) == [*left, 8] and sum(r is None for _, _, r, _ in found) == 1
    long = made(3, random.Random(1).randbytes(9 << 20))  # goes on in a second member with more records
    joined = warc.member(long)
    last = zlib.compressobj(6, zlib.DEFLATED, 31)
    rest = last.compress(long[warc.MEMBER_BYTES :] + bytes(harmed)) + last.flush()
    first = joined[: len(joined) - len(warc.member(long[warc.MEMBER_BYTES :]))]
    assert ids_of(warc.salvage(first + rest + warc.member(made(8)))) == [3, 0, 2, 8]
    spoilt = bytearray(first + rest)
    spoilt[1 << 20] ^= 1
    assert ids_of(warc.salvage(bytes(spoilt) + warc.member(made(8)))) == [0, 2, 8]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_of_one_stream(level):
    """Of a member that does not unpack to its end, the records come back that are whole before the damage."""
    pick = random.Random(level)
    records = [made(i, pick.randbytes(3000) + b"words " * 500) for i in range(40)]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(b"".join(records)) + packer.flush()
    half = bytearray(packed)
    half[len(half) // 2] ^= 0x55
    for harmed, least in ((bytes(half), 18), (packed[: len(packed) * 3 // 4], 28), (packed[:-6], 40), (packed[:-8] + b"x" * 8, 40)):
        whole = warc.member(made(90)) + harmed + warc.member(made(91))
        found = list(warc.salvage(whole))
        ids = ids_of(found)
        assert ids[0] == 90 and ids[-1] == 91 and ids[1:] == sorted(set(ids[1:])) and ids[1 : least + 1] == list(range(least))
        by_id = {int(r["fields"]["warc-record-id"][10:-1]): r for _, _, r, _ in found if r}
        assert all(by_id[i]["payload"] == records[i].partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4] for i in ids[1:-1])
        gaps = [f for f in found if f[2] is None]
        assert gaps and all("of the unpacked member at" in why for *_, why in gaps)
        assert ids_of(warc.salvage(harmed)) == ids[1:-1]
    plain = [r.replace(b"sha256:", b"none:") for r in records]  # nothing proves these once the check sum fails
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(b"".join(plain)) + packer.flush()
    assert ids_of(warc.salvage(packed)) == list(range(40))
    assert len(ids_of(warc.salvage(packed[: len(packed) // 2]))) in (19, 20)


@pytest.mark.parametrize("coded", [base64.b32encode, base64.b64encode, base64.b16encode])
def test_digests_that_are_not_hex(coded):
    body = b"some words"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    sha1 = lambda data: b"sha1:" + coded(hashlib.sha1(data).digest())

    def one(kind, block, paid):
        head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Type: application/http\r\n" % kind
        head += b"WARC-Block-Digest: %s\r\nWARC-Payload-Digest: %s\r\n" % (sha1(block), sha1(paid))
        return head + b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)

    chunks = b"4\r\nsome\r\n6;x\r\n words\r\n0\r\n\r\n"
    sound = [one(b"response", http + chunks, body), one(b"response", http + chunks, chunks),
             one(b"request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b""), one(b"resource", body, body)]
    assert ids_of(warc.salvage(b"".join(sound))) == [1] * 4
    harmed = sound[3].replace(b"some words\r", b"some wards\r")
    found = list(warc.salvage(sound[0] + harmed + sound[1]))
    assert ids_of(found) == [1, 1]
    assert [f[:2] + f[3:] for f in found if f[2] is None] == [(len(sound[0]), len(sound[0] + harmed), "block digest")]
    assert not ids_of(warc.salvage(one(b"resource", body, b"other")))


def test_salvage_of_files(spark, tmp_path):
    good = b"".join(warc.member(made(i)) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(good + b"\xff" * 9 + warc.member(made(9)))
    (tmp_path / "b.warc").write_bytes(made(5) + made(6)[:-20])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["record_id"] for r in rows if r["gap"] is None) == [f"urn:page:{i}" for i in (0, 1, 2, 5, 9)]
    gaps = sorted((r["path"].rpartition("/")[2], r["end"] - r["begin"]) for r in rows if r["gap"])
    assert gaps == [("a.warc.gz", 9), ("b.warc", len(made(6)) - 20)]


URLS = [
    ("http://Sub.Example.ORG/es/x?q", "sub.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org", "example.org", "", None, None),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("x://a.com/de/?y", "a.com", "/de/", "com/de/", "block"),
    ("x://a.com?://b/fr/", "a.com", "", None, None),
    ("//a.com/de/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://org/", "org", "/", "org/", "allow"),
]


def test_rules_and_hosts(spark):
    df = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, n string")
    none = spark.createDataFrame([], "id long, bad int")
    rows = {r["page_id"]: r for r in url_reputation.judge_urls(df, none, RULES).collect()}
    for i, (_, host, path, rule, said) in enumerate(URLS):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, rule, said or "allow")
    assert url_reputation.judge_urls(df.limit(0), none, RULES).count() == 0


def test_reputation_shrinks(spark):
    """A host with much bad history is blocked, one with a single bad page is not; against plain sums."""
    data = [("bad.x.net", 1)] * 60 + [("ok.x.net", 0)] * 200 + [("one.y.net", 1)] + [("z.co.uk", 0)] * 30
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, (h, _) in enumerate(data)] + [(999, "http://new.x.net/"), (None, "http://bad.x.net/")],
                                  "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(data)] + [(0, 0), (None, 1)], "id long, bad int")
    verdict = {r["host"]: r["verdict"] for r in url_reputation.judge_urls(pages, outcomes, []).collect()}
    assert verdict == {"bad.x.net": "block", "ok.x.net": "allow", "one.y.net": "allow", "z.co.uk": "allow", "new.x.net": "allow"}
    counts = url_reputation.host_counts(url_reputation.with_host(pages.withColumnRenamed("page_id", "id")), outcomes)
    rows = [r.asDict() for r in counts.collect()]
    assert {(r["host"], r["domain"], r["suffix"], r["n"], r["bad"]) for r in rows} >= {
        ("bad.x.net", "x.net", "net", 60, 60), ("z.co.uk", "z.co.uk", "co.uk", 30, 0), ("new.x.net", "x.net", "net", 0, 0),
    }

    def shrunk(members, level, prior):
        total = {}
        for r in members:
            n, bad = total.get(r[level], (0, 0))
            total[r[level]] = (n + r["n"], bad + r["bad"])
        parent = {r[level]: prior(r) for r in members}
        over = sum((b - n * parent[k]) ** 2 - n * parent[k] * (1 - parent[k]) for k, (n, b) in total.items())
        under = sum(n * (n - 1) * parent[k] * (1 - parent[k]) for k, (n, _) in total.items())
        strength = round(1 / min(max(over / under, 0.001), 0.5) - 1, 6)
        return {k: (b + strength * parent[k], n - b + strength * (1 - parent[k])) for k, (n, b) in total.items()}

    share = (sum(r["bad"] for r in rows) + 0.5) / (sum(r["n"] for r in rows) + 1)
    mean = lambda ab: ab[0] / sum(ab)
    suffixes = shrunk(rows, "suffix", lambda r: share)
    domains = shrunk(rows, "domain", lambda r: mean(suffixes[r["suffix"]]))
    hosts = shrunk(rows, "host", lambda r: mean(domains[r["domain"]]))
    for r in url_reputation.reputation(counts).collect():
        a, b = hosts[r["host"]]
        assert r["mean"] == pytest.approx(a / (a + b))
        assert r["low_bound"] == pytest.approx(a / (a + b) - 1.645 * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1)))


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_preference_pairs(spark):
    chosen = {
        1: [("system", "s"), ("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "yes")],
        2: [("user", "q"), ("assistant", "same")],
        3: [("user", None), ("assistant", "a")],
        4: [("user", "other start"), ("assistant", "a")],
        5: [("user", "q")],
        6: [("user", "only chosen")],
    }
    rejected = {
        1: [("system", "s"), ("user", "q"), ("assistant", "bad")],
        2: [("user", "q"), ("assistant", "same")],
        3: [("user", None), (None, None), ("assistant", "é😀")],
        4: [("user", "start"), ("assistant", "a")],
        5: [("user", "q"), ("assistant", "added")],
        7: [("user", "only rejected")],
    }

    def frame(conversations):
        rows = [(k, n, *t, "x") for k, ts in conversations.items() for n, t in enumerate(ts)] + [(None, 0, "user", "?", "x")]
        return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, side string").repartition(3)

    found = {r["pair_id"]: r for r in preference_chat.preference_pairs(frame(chosen), frame(rejected)).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    for k, r in found.items():
        a, b = chosen[k], rejected[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert r["n_prompt_turns"] == n and r["prompt"] == render(a[:n])
        for name, turns in (("chosen", a[n:]), ("rejected", b[n:])):
            assert r[name] == render(turns)
            learned = [r[name][s["start"] : s["start"] + s["length"]] for s in r[f"{name}_spans"]]
            assert learned == [f"{t or ''}<|end|>\n" for role, t in turns if role == "assistant"]
    empty = frame({})
    assert preference_chat.preference_pairs(empty, empty).count() == 0


def test_headers_longer_than_a_member(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/" + "x" * (9 << 20), "<p>one</p>"), (2, "http://b/", "<p>two</p>")],
        "page_id long, url string, html string",
    )
    warc.write_pages(pages, str(tmp_path / "long"))
    found = warc.read_archives(spark, str(tmp_path / "long")).collect()
    assert sorted(r["record_id"] for r in found) == ["urn:page:1", "urn:page:2"]
    assert all(r["gap"] is None for r in found)


def test_a_header_without_an_end_costs_one_member():
    good = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = b"WARC/1.0\r\nWARC-Type: resource\r\nX: " + b"y" * (2 << 20)
    archive = gzip.compress(good) + gzip.compress(bad) + gzip.compress(good) * 3
    found = list(warc.salvage(archive))
    assert [record is not None for _, _, record, _ in found] == [True, False, True, True, True]
