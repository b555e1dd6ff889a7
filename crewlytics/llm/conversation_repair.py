"""Repair of conversations to an optional system turn followed by user and assistant in turns.

Each row of a conversation is kept, given another role or deleted, and empty turns are inserted.
The ways to do so are the paths of a lattice: a node is the number of rows dealt with and the kind
of the last turn kept, an edge is one edit. The cheapest path is found by Dijkstra's algorithm from
both ends: a forward heap from the start, a reverse heap from the two ends, until the sum of what
both would settle next exceeds the best crossing. By then every path of that cost runs through
settled nodes only, so all equal crossings are known; of their audits (the initials of the edits in
order) the least one is walked.

Spark deals with the rows: a skeleton of a few bytes per row is sorted by conversation for the
lattice, then the audits meet the texts in a second sort, where a task reads one turn after the
other. A task holds a byte per row of one conversation for the lattice, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlytics.llm.text_arrays import tidy

# fixed values: costs of the edits, and the roles a turn can get
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
USER, ASSISTANT = "user", "assistant"
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, ASKED, ANSWERED = range(4)  # what the last turn kept was
NEXT = {START: ASKED, SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
KEPT = {(START, 0): SYSTEM, (START, 1): ASKED, (SYSTEM, 1): ASKED, (ASKED, 2): ANSWERED, (ANSWERED, 1): ASKED}
FAR = 1 << 60
KNOWN_ROWS, KNOWN = 64, 50_000  # what a task remembers; no effect on results
BATCH = 1 << 20  # characters of text in a batch of repaired turns

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = [part.split()[0] for part in REPORT.split(", ")]


def edits(row: int, kind: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows taken, kind after) of the edits at a row after a turn of some kind.

    ``row`` is the role (0 system, 1 user, 2 assistant, 3 other) plus four times the fault (0 none,
    1 blank, 2 duplicate, 3 truncated); -1 stands for the end. In ascending order of the initial.
    """
    out = []
    if row >= 0:
        out.append(("D", DELETE, 1, kind))
    out.append(("I", INSERT, 0, NEXT[kind]))
    if row >= 0 and row // 4 not in (1, 2):
        extra = TRUNCATED if row // 4 == 3 else 0
        if (kind, row % 4) in KEPT:
            out.append(("K", extra, 1, KEPT[kind, row % 4]))
        out.append(("R", REROLE + extra, 1, NEXT[kind]))
    return out


EDITS = {row: [edits(row, kind) for kind in range(4)] for row in range(-1, 16)}
BACK = {
    row: [
        [(cost, taken, kind) for kind in range(4) for _, cost, taken, after in EDITS[row][kind] if after == target]
        for target in range(4)
    ]
    for row in range(-1, 16)
}


def cheapest(rows: bytes) -> tuple[int, str]:
    """The cost of the cheapest repair and its audit, the least of equal ones, of coded rows."""
    n = len(rows)
    size = 4 * (n + 1)
    ahead, behind = array("q", [FAR]) * size, array("q", [FAR]) * size
    done_ahead, done_behind = bytearray(size), bytearray(size)
    ahead[START] = 0
    forward, reverse, best = [START], [], FAR
    settled = []
    for kind in (START, ANSWERED):
        behind[4 * n + kind] = 0
        heappush(reverse, 4 * n + kind)
    if n == 0:
        best = 0
    # a heap entry is cost * size + node
    while forward and reverse and forward[0] // size + reverse[0] // size <= best:
        if forward[0] // size <= reverse[0] // size:
            cost, node = divmod(heappop(forward), size)
            if done_ahead[node]:
                continue
            done_ahead[node] = 1
            settled.append(node)
            i, kind = divmod(node, 4)
            for _, price, taken, after in EDITS[rows[i] if i < n else -1][kind]:
                other, now = 4 * (i + taken) + after, cost + price
                if now < ahead[other]:
                    ahead[other] = now
                    heappush(forward, now * size + other)
                if now + behind[other] < best:
                    best = now + behind[other]
        else:
            cost, node = divmod(heappop(reverse), size)
            if done_behind[node]:
                continue
            done_behind[node] = 1
            i, after = divmod(node, 4)
            into = [(cost + p, 4 * i + k) for p, taken, k in BACK[-1][after] if not taken]
            if i:
                into += [(cost + p, 4 * (i - 1) + k) for p, taken, k in BACK[rows[i - 1]][after] if taken]
            for now, other in into:
                if now < behind[other]:
                    behind[other] = now
                    heappush(reverse, now * size + other)
                if now + ahead[other] < best:
                    best = now + ahead[other]

    def steps(node: int):
        """Edits of a settled node that stay on a cheapest path, and whether they cross over."""
        i, kind = divmod(node, 4)
        for initial, price, taken, after in EDITS[rows[i] if i < n else -1][kind]:
            other = 4 * (i + taken) + after
            if done_behind[other] and ahead[node] + price + behind[other] == best:
                yield initial, other, True
            elif done_ahead[other] and ahead[node] + price == ahead[other]:
                yield initial, other, False

    ends = bytearray(size)  # settled nodes from which a cheapest path goes on
    for node in sorted(settled, key=lambda x: (-ahead[x], -x)):
        at_end = node // 4 == n and node % 4 in (START, ANSWERED) and ahead[node] == best
        ends[node] = at_end or any(crosses or ends[other] for _, other, crosses in steps(node))
    audit, node, crossed = [], START, bool(done_behind[START] and behind[START] == best)
    while True:
        i, kind = divmod(node, 4)
        if not crossed:
            if i == n and kind in (START, ANSWERED) and ahead[node] == best:
                break
            initial, node, crossed = next(s for s in steps(node) if s[2] or ends[s[1]])
        else:
            if i == n and kind in (START, ANSWERED):
                break
            for initial, price, taken, after in EDITS[rows[i] if i < n else -1][kind]:
                other = 4 * (i + taken) + after
                if done_behind[other] and price + behind[other] == behind[node]:
                    break
            node = other
        audit.append(initial)
    return best, "".join(audit)


def solve(rows: bytes, known: dict[bytes, tuple[int, str]]) -> tuple[int, str]:
    """``cheapest``, remembering short conversations; many have the same roles and faults."""
    if len(rows) > KNOWN_ROWS:
        return cheapest(rows)
    if rows not in known:
        if len(known) >= KNOWN:
            known.clear()
        known[rows] = cheapest(rows)
    return known[rows]


def _told_apart() -> list[Column]:
    return [F.xxhash64("role", "text"), F.xxhash64("text", "role")]


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h1").asc(), F.col("h2").asc()]


def _skeleton(rows: DataFrame) -> DataFrame:
    """(conv, turn, code) of every row, code -1 for rows that are gone, dealt and sorted by conversation."""
    said = F.expr(f"trim(trailing '{BLANKS}' from text)")
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    ends = F.substring(said, -1, 1).isin(".", "!", "?")
    told = rows.withColumns({"initial": role, "blank": said == "", "ends": ends}).drop("text")
    nth = "row_number() over (partition by conv, h1, h2, gone order by turn asc nulls first)"
    fault = F.expr("case when blank then 1 when nth > 1 then 2 when not ends then 3 else 0 end")
    code = F.when(F.col("gone"), -1).otherwise(F.col("initial") + 4 * fault)
    rows = told.withColumn("nth", F.expr(nth))
    coded = rows.select("conv", "turn", "role", "h1", "h2", code.cast("int").alias("code"))
    return coded.repartition("conv").sortWithinPartitions("conv", *_order()).select("conv", "turn", "code")


def _report(turns: list[int], codes: bytes, known: dict) -> tuple:
    """The figures of one conversation, its turns without nulls in ascending order."""
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    faults = [c // 4 for c in codes]
    legal = ((0, 1), (1, 2), (2, 1))
    illegal = sum((a % 4, b % 4) not in legal for a, b in zip(codes, codes[1:]))
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, *solve(codes, known))


def _reports(skeleton: DataFrame) -> DataFrame:
    """(conv, report) of the sorted skeleton."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def finished(convs: list, found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(convs, kind)]
            for part, values in zip(REPORT.split(", "), zip(*found, strict=True), strict=True):
                columns.append(pa.array(values, pa.string() if part.endswith("string") else pa.int64()))
            return pa.RecordBatch.from_arrays(columns, ["conv", *COUNTS])

        kind, now, codes, turns = None, None, None, []
        known: dict[bytes, tuple[int, str]] = {}
        for batch in batches:
            kind = batch.schema.field(0).type
            convs, found = [], []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for conv, group in groupby(rows, key=lambda r: r[0]):
                if codes is None or conv != now:
                    if codes is not None:
                        convs.append(now)
                        found.append(_report(turns, bytes(codes), known))
                    now, codes, turns = conv, bytearray(), []
                for _, turn, code in group:
                    if code >= 0:
                        codes.append(code)
                        if turn is not None and (not turns or turns[-1] != turn):
                            turns.append(turn)
            if convs:
                yield finished(convs, found)
        if codes is not None:
            yield finished([now], [_report(turns, bytes(codes), known)])

    kind = skeleton.schema["conv"].dataType.simpleString()
    return skeleton.mapInArrow(run, f"conv {kind}, {REPORT}")


def damage(
    rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(id, turn, role, text, gone) of rows with faults put in by the crc32 of ``id:turn`` modulo 20.

    0 marks the row as gone, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it,
    4 sets the role user. A null counts as one space, in the key as in role and text.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    rows = rows.select(
        F.col(id).alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), (F.crc32(key) % 20).alias("hit"),
    )
    marks = F.regexp_replace("text", "[.!?]", "")
    changed = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, marks).otherwise(F.col("text"))
    copies = F.explode(F.expr("if(hit = 3, array(0, 1), array(0))"))
    rows = rows.withColumn("copy", copies)
    return rows.select(
        F.col("id").alias(id), F.col("turn").alias(turn),
        F.when(F.col("hit") == 4, USER).otherwise(F.col("role")).alias(role), changed.alias(text),
        (F.col("hit") == 0).alias("gone"),
    )


def repair(
    rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    gone: str | None = None,
) -> DataFrame:
    """The repaired conversations, each after a head row with its report: (id, place, role, text, report).

    A conversation's rows are taken by turn, nulls first; rows with one turn by role and then by a
    hash of role and text, so equal rows lie side by side. ``place`` counts the turns of the repaired
    conversation from 0 and is null in the head row, which alone holds the report: ``gaps`` in the
    turn numbers, ``blank``, ``duplicate`` and ``truncated`` rows (the first fault of each counts),
    ``illegal`` neighbours, ``cost`` and ``audit``. A null role or text is one space; a null id is one
    conversation. A row whose column ``gone`` is true only names its conversation; one without other
    rows has an empty audit. Other columns are not read; an empty table gives an empty result. Rows
    come sorted inside their partition, the head first, then by place.
    """
    space = F.lit(" ")
    base = rows.select(
        F.col(id).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )
    base = base.withColumns(dict(zip(("h1", "h2"), _told_apart(), strict=True)))
    reports = _reports(_skeleton(base))
    heads = reports.withColumn("head", F.lit(True))
    turns = base.where("not gone").drop("gone").withColumn("head", F.lit(False))
    both = heads.unionByName(turns, allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", F.col("head").desc(), *_order())
    both = both.select("conv", "head", "role", "text", *COUNTS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, kind, place, now = "", 0, START, 0, None
        out: list[tuple] = []

        def turns_until(stop: bool):
            """Inserted turns, up to the edit of the next row or to the end."""
            nonlocal at, kind, place
            while at < len(audit) and audit[at] == "I":
                kind = NEXT[kind]
                out.append((now, place, USER if kind == ASKED else ASSISTANT, "", None))
                at, place = at + 1, place + 1
            if stop and at < len(audit):
                raise RuntimeError("an audit without its rows")

        for batch in batches:
            fields = {f.name: f.type for f in batch.schema}
            held = 0
            columns = [batch.column(i).to_pylist() for i in range(4)]
            numbers = batch.select(COUNTS).to_pylist() if any(columns[1]) else []
            for i, (conv, head, role_now, said) in enumerate(zip(*columns, strict=True)):
                if head:
                    turns_until(True)
                    now, audit, at, kind, place = conv, numbers[i]["audit"], 0, START, 0
                    out.append((conv, None, None, None, numbers[i]))
                    continue
                turns_until(False)
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    kind = NEXT[kind]
                    role_now = USER if kind == ASKED else ASSISTANT
                else:
                    first = "sua".find(role_now[:1])
                    kind = KEPT[kind, first]
                out.append((conv, place, role_now, said, None))
                place += 1
                held += len(said)
                if held > BATCH:
                    yield _turns(out, fields)
                    out, held = [], 0
            yield _turns(out, fields)
            out = []
        turns_until(True)
        if out:
            yield _turns(out, fields)

    kind = both.schema["conv"].dataType.simpleString()
    return both.mapInArrow(run, f"`{id}` {kind}, place long, role string, text string, {REPORT}")


def _turns(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    convs, places, roles, texts, reports = zip(*rows, strict=True) if rows else ([],) * 5
    columns = [pa.array(convs, fields["conv"]), pa.array(places, pa.int64()), pa.array(roles, pa.string()),
               pa.array(texts, pa.string())]
    columns += [pa.array([r and r[name] for r in reports], fields[name]) for name in COUNTS]
    return pa.RecordBatch.from_arrays(columns, ["conv", "place", "role", "text", *COUNTS])


def digests(repaired: DataFrame, id: str = "conv_id") -> DataFrame:
    """(id, report, repaired_sha256): one row per conversation of the result of ``repair``.

    The hash is over ``role:text`` of its turns, joined by newlines. It has to be given that result
    as it is, as it relies on the order inside partitions.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, so_far = None, hashlib.sha256()
        schema = None

        def finished(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            if schema is None:
                fields = [batch.schema.field(i) for i in (0, *range(4, 4 + len(COUNTS)))]
                schema = pa.schema([*fields, pa.field("repaired_sha256", pa.string())])
            rows, names = [], schema.names
            places, roles, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, place in enumerate(places):
                if place is None:
                    if head is not None:
                        rows.append(head | {"repaired_sha256": so_far.hexdigest()})
                    head = {name: batch.column(name)[i].as_py() for name in names[:-1]}
                    so_far = hashlib.sha256()
                else:
                    so_far.update((f"\n{roles[i]}:{texts[i]}" if place else f"{roles[i]}:{texts[i]}").encode())
            if rows:
                yield finished(rows)
        if head is not None:
            yield finished([head | {"repaired_sha256": so_far.hexdigest()}])

    kind = repaired.schema[0].dataType.simpleString()
    return repaired.mapInArrow(run, f"`{id}` {kind}, {REPORT}, repaired_sha256 string")
