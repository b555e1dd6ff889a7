"""WARC archives: a deduplicating writer and a reader that salvages damaged files.

Archives are gzip members, one record each, written through Spark's text sink, so any file
system that Spark writes to will do. The sink ends each row with a separator; a gzip member
shorter than 16 MiB always ends in a zero byte, so that byte is the separator and is left out of
the row. A longer record is cut into several members.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlytics.llm.scratch import stored
from crewlytics.llm.text_arrays import tidy

# fixed values: names that the format defines
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER_BYTES = 8 << 20
LEAST_REVISIT = 100
RECORDS_PER_FILE = 20_000
DATE = "2000-01-01T00:00:00Z"


def member(record: bytes) -> bytes:
    """The record as gzip members of at most MEMBER_BYTES each, level 6."""
    out = []
    for at in range(0, max(len(record), 1), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(record[at : at + MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


def record(kind: str, name: str, uri: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One record; a revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    block = http % len(payload) + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if kind == "revisit":
        head += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{refers}>")]
    head += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def write_pages(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Writes one record per row of ``pages`` to archives below ``folder``.

    Of rows with equal payloads of at least 100 bytes, those with the smallest id are responses
    and the others revisits of it; a group without ids is all responses, as are all shorter
    payloads. Null html is an empty payload, a null url gives no target. Other columns are not
    read. Payload digests are grouped beforehand; the list of repeated ones is written first, so
    Spark knows its size and joins it without moving pages where it is short.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.length("payload") >= LEAST_REVISIT)
    shared = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = stored(shared.where("n > 1 and first is not null").drop("n"), "payloads")
    rows = rows.join(shared, "digest", "left").select("id", "url", "payload", "digest", "first")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                page, uri, body, digest, first = (c[i].as_py() for c in batch.columns)
                kind = "response" if first is None or page == first else "revisit"
                made = record(kind, f"urn:page:{page}", uri, body, digest, f"urn:page:{first}")
                out.append(member(made)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    written = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    writer = written.write.option("lineSep", "\0").option("compression", "none")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower().decode("utf-8")] = value.strip().decode("utf-8")
    return fields


def _digest_fits(said: str | None, *data: bytes) -> bool | None:
    """Whether a digest field is that of one of ``data``; None where it cannot be judged.

    The value may be hex, base32 or base64. Methods other than sha256 and sha1 are not judged.
    """
    method, _, value = (said or "").partition(":")
    method, value = method.strip().lower(), value.strip().rstrip("=")
    if method not in ("sha256", "sha1") or not value:
        return None
    for one in data:
        right = hashlib.new(method, one).digest()
        if value.lower() == right.hex() or value.upper() == base64.b32encode(right).decode().rstrip("="):
            return True
        if value.replace("-", "+").replace("_", "/") == base64.b64encode(right).decode().rstrip("="):
            return True
    return False


_CHUNK = re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n")


def _unchunked(body: bytes) -> bytes:
    """The body without the chunk lines of HTTP; as far as it has any."""
    out, at = [], 0
    while (m := _CHUNK.match(body, at)) and int(m[1], 16):
        at = m.end() + int(m[1], 16)
        out.append(body[m.end() : at])
        at += 2
    return b"".join(out)


def _parse(data: bytes, at: int, proven: bool = True) -> tuple[dict | None, int]:
    """The record at ``at`` and where it ends; (None, end) if the data stop before that end.

    Where the end of the header is not there yet, the end is one byte more than there is. Data
    that are not ``proven`` by a check sum need a digest that fits.
    """
    if not data.startswith(b"WARC/", at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, len(data) + 1
    fields = _fields(data[at:stop])
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("header without length or type")
    begin, end = stop + 4, stop + 4 + int(fields["content-length"])
    if len(data) < end + 4:
        return None, end + 4
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record without its end mark")
    block = data[begin:end]
    block_fits = _digest_fits(fields.get("warc-block-digest"), block)
    if block_fits is False:
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    payload_fits = None
    if fields["warc-type"] != "revisit":
        payload_fits = _digest_fits(fields.get("warc-payload-digest"), payload)
        if payload_fits is False and fields.get("content-type", "").lower().startswith("application/http"):
            # some writers take the digest of a request's body, or of what the chunks of a body hold
            body = block.partition(b"\r\n\r\n")[2]
            payload_fits = _digest_fits(fields.get("warc-payload-digest"), body, _unchunked(body))
        if payload_fits is False:
            raise ValueError("payload digest")
    if not (proven or block_fits or payload_fits):
        raise ValueError("no digest in a damaged member")
    said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    fields["payload-bytes"] = int(said[1]) if said and fields["warc-type"] == "revisit" else len(payload)
    return {"fields": fields, "payload": payload}, end + 4


_GZIP = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_VERSION = re.compile(rb"WARC/[0-9]")
CUT_OFF = "member without an end"


def _member(content: bytes, at: int) -> tuple[bytes, int, str]:
    """The member at ``at`` unpacked, where it ends and what is wrong with it, if anything.

    Takes small bites, so no rest is copied. Of a damaged member comes what was unpacked before
    the error: the bite that fails is taken byte by byte once more.
    """
    view, least = memoryview(content), None
    while True:
        unpacker, out, place, bite = zlib.decompressobj(31), [], at, 4096
        while not unpacker.eof:
            step = bite if least is None or place < least else 1
            part = view[place : place + step]
            if not len(part):
                return b"".join(out), place, CUT_OFF
            try:
                out.append(unpacker.decompress(part))
            except zlib.error as wrong:
                if least is not None:
                    return b"".join(out), place, str(wrong)
                least = place
                break
            place, bite = place + len(part), min(2 * bite, 1 << 20)
        else:
            return b"".join(out), place - len(unpacker.unused_data), ""


def _packed_end(content: bytes, at: int, size: int) -> int:
    """Where the first ``size`` unpacked bytes of the member at ``at`` end in the archive.

    The last of them is left in the unpacker, which would go on to a damaged check sum behind it.
    """
    unpacker, view, bite = zlib.decompressobj(31), memoryview(content), 4096
    size -= 1
    while size:
        part = view[at : at + bite]
        size -= len(unpacker.decompress(part, size))
        at, bite = at + len(part) - len(unpacker.unconsumed_tail), min(2 * bite, 1 << 20)
    return at


def _joined(content: bytes, rest: bytes, need: int, end: int) -> tuple[dict, bytes, int, int]:
    """The record that begins ``rest`` and goes on in the members from ``end`` on.

    Returns the record, the unpacked bytes, the record's end in them and the last member's end.
    A header may go on over any number of members, but not past one that begins a record.
    """
    parts, size = [rest], len(rest)
    while True:
        while size < need:
            if not content.startswith(_GZIP, end):
                raise ValueError("record without its rest")
            part, end, wrong = _member(content, end)
            if wrong:
                raise ValueError(f"record without its rest, {wrong}")
            if need == size + 1 and part.startswith(b"WARC/"):
                raise ValueError("header without an end")
            parts.append(part)
            size += len(part)
        parts = [b"".join(parts)]
        one, need = _parse(parts[0], 0)
        if one is not None:
            return one, parts[0], need, end


def _records(content: bytes, at: int) -> tuple[list[tuple[dict | None, str]], int, str]:
    """What the member at ``at`` holds, where it ends, and what is wrong behind its last record.

    After a failed check the unpacked bytes are searched for the next version line whose record
    passes; the bytes between are a gap, named by their places in the unpacked bytes. Of a
    damaged member the end is that of its last record, and ``at`` if nothing in it counts.
    """
    held, end, wrong = _member(content, at)
    proven = not wrong or wrong == CUT_OFF
    found, place, sound, bad, why, before = [], 0, 0, None, "", 0
    while place < len(held):
        try:
            one, after = _parse(held, place, proven)
            if one is None:
                if wrong:
                    raise ValueError(wrong)
                one, rest, after, end = _joined(content, held[place:], after - place, end)
                before, held, place = before + place, rest, 0
        except ValueError as failed:
            if bad is None:
                bad, why = before + place, str(failed)
            start = _VERSION.search(held, place + 1)
            place = start.start() if start else len(held)
            continue
        if bad is not None:
            found.append((None, f"{why}; bytes {bad} to {before + place} of the unpacked member at {at}"))
            bad = None
        found.append((one, ""))
        place = sound = after
    if wrong and (not found or len(found) == 1 and sound == len(held)):
        return [], at, wrong  # the check sum of a member with one record is a check of that record
    if wrong:
        return found, _packed_end(content, at, sound), f"{wrong}; from byte {sound} of the unpacked member at {at}"
    if bad is not None and found:
        found.append((None, f"{why}; bytes {bad} to {before + len(held)} of the unpacked member at {at}"))
    return found, end, "" if found else why


def salvage(content: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(begin, end, record, reason) for every record and every gap of an archive, in order.

    A gap has no record and names what was wrong. After a failed check the search goes on at the
    next byte that may start a gzip member or a version line, and a place counts only when its
    record passes all checks. A member may hold many records: those before and after damage come
    back, also from a member that unpacks only in part, and a gap between them has the bytes of
    the member and in its reason its place in the unpacked bytes. Where the member's own check
    sum fails, only records with a digest that fits count. Members that hold a part of a record
    are joined with the next ones.
    """
    at, gap, why = 0, None, ""
    while at < len(content):
        found, end, wrong = [], at, ""
        if content.startswith(_GZIP, at):
            found, end, wrong = _records(content, at)
        else:
            try:
                one, end = _parse(content, at)
                if one is None:
                    raise ValueError("record without an end")
                found.append((one, ""))
            except ValueError as failed:
                end, wrong = at, str(failed)
        if gap is not None and found:
            yield gap, at, None, why
            gap = None
        for one, reason in found:
            yield at, end, one, reason
        if wrong:
            if gap is None:
                gap, why = end if found else at, wrong
            start = _START.search(content, max(end, at + 1))
            end = start.start() if start else len(content)
        at = end
    if gap is not None:
        yield gap, len(content), None, why


SCHEMA = (
    "path string, begin long, end long, gap string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives below ``folder``.

    A gap has its byte range and in ``gap`` the reason; its other columns are null. An empty
    folder or file gives no rows. A task holds one archive, so archives of other origin should
    have the usual size of about 1 GB or less. ``payloads=False`` leaves the bytes out.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", *re.findall(r"(\w+) (?:string|long|binary)", SCHEMA)[1:]]
        kinds = {"begin": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names
            )

        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for begin, end, one, why in salvage(content):
                    if one is None:
                        rows.append((path, begin, end, why, *[None] * 7))
                        continue
                    f, payload = one["fields"], one["payload"]
                    digest = f.get("warc-payload-digest", "").partition(":")[2]
                    if f["warc-type"] != "revisit":
                        digest = hashlib.sha256(payload).hexdigest()
                    rows.append(
                        (path, begin, end, None, f["warc-type"], f.get("warc-record-id", "").strip("<>"),
                         f.get("warc-target-uri"), f.get("warc-refers-to", "").strip("<>") or None, digest,
                         f["payload-bytes"], payload if payloads else None)
                    )
                    held += len(payload) if payloads else 200
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where("length > 0 and path not like '%/\\\\_SUCCESS'").select("path", "content")
    return files.mapInArrow(run, SCHEMA)
