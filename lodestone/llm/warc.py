"""WARC archives of pages: a writer, and a reader that salvages damaged archives.

Each record is a gzip member of its own. The reader checks every member and record (gzip
check sum, version line, header block, Content-Length, trailing line breaks, payload
digest). After a failed check it searches for the next member that decodes to a version
line, or in an uncompressed run for the next version line, goes on from there, and logs
the bytes between as a quarantined gap with its reason.

Of records with equal payloads the one with the largest page id holds the payload; the
others are revisits that refer to it.

Defined results: a null html is the empty payload. A null url leaves the target out. A
null page id comes before all others and reads back as null. Rows repeated in full are
all responses where their page id is the largest of their payload. An empty table gives
no archive. Long payloads are written and read whole; an archive is read into memory, and
holds at most one record beyond the size at which it is closed. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import filestore, shared

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_ID = "urn:x-page:"
_LINE_BREAK = re.compile(r"[\x00-\x20\x7f]")
FOUND = "kind string, archive string, at long, size long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One whole record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _LINE_BREAK.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time stamp."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Damaged(ValueError):
    """A record or member that fails a check."""


def _fields(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        found[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def _page(text: str | None) -> int | None:
    got = re.fullmatch(rf"<{_ID}(-?\d+)>", text or "")
    return int(got[1]) if got else None


def parse(data: bytes | memoryview, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at`` and where it ends; Damaged if a check fails."""
    data = bytes(data) if isinstance(data, memoryview) else data
    if not _VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    top = data.find(b"\r\n\r\n", at)
    if top < 0:
        raise Damaged("header block without an end")
    head = _fields(data[data.index(b"\r\n", at) + 2 : top])
    if not head.get("content-length", "").isdigit():
        raise Damaged("no Content-Length")
    begin, end = top + 4, top + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("Content-Length doesn't lead to a record's end")
    block = data[begin:end]
    if (said := head.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest_of(block):
        raise Damaged("block digest differs")
    kind = head.get("warc-type", "")
    http, gap, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        n, payload = int(length[1]) if length else 0, None
    else:
        n, got = len(payload), digest_of(payload)
        if said and said != got:
            raise Damaged("payload digest differs")
        said = got
    return {
        "kind": "record",
        "page_id": _page(head.get("warc-record-id")),
        "url": head.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")),
        "payload_bytes": n,
        "payload_digest": said,
        "payload": payload,
    }, end + 4


def _plain(data: bytes, base: int, whole: int) -> Iterator[dict]:
    """Records and gaps of what the member at ``base``, of ``whole`` bytes, holds. Both are
    placed by the member, which is the least range of the file that has them."""
    at = 0
    while at < len(data):
        try:
            found, end = parse(data, at)
            yield found | {"at": base, "size": whole}
        except Damaged as why:
            nxt = _VERSION_LINE.search(data, at + 1)
            end = nxt.start() if nxt else len(data)
            yield {"kind": "gap", "at": base, "size": whole, "reason": str(why)}
        at = end


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """What the member at ``at`` holds and where it ends."""
    expand, out, step = zlib.decompressobj(31), [], 1 << 16
    while not expand.eof:
        if at >= len(data):
            raise Damaged("member is cut off")
        try:
            out.append(expand.decompress(data[at : at + step]))
        except zlib.error as why:
            raise Damaged(f"member doesn't decode: {why}") from None
        at += min(step, len(data) - at)
    return b"".join(out), at - len(expand.unused_data)


def _promising(data: memoryview, at: int) -> bool:
    """Whether the bytes at ``at`` begin a member that decodes to a version line."""
    expand = zlib.decompressobj(31)
    try:
        got = expand.decompress(data[at : at + 4096], 64)
    except zlib.error:
        return False
    return bool(_VERSION_LINE.match(got))


def _next(raw: bytes, data: memoryview, at: int) -> int:
    """Where the next version line, or member that decodes to one, begins."""
    line = _VERSION_LINE.search(raw, at)
    plain = line.start() if line else len(raw)
    gz = raw.find(b"\x1f\x8b\x08", at, plain)
    while gz >= 0 and not _promising(data, gz):
        gz = raw.find(b"\x1f\x8b\x08", gz + 1, plain)
    return plain if gz < 0 else gz


def salvage(raw: bytes) -> Iterator[dict]:
    """Every record that can be read, and every quarantined gap, in order. What begins at
    a place is checked first; only after a failed check the next beginning is sought, so
    that an intact record keeps whatever its payload holds."""
    data, at = memoryview(raw), 0
    while at < len(raw):
        try:
            if raw[at : at + 5] == b"WARC/":
                found, end = parse(raw, at)
                yield found | {"at": at, "size": end - at}
            else:
                held, end = _inflate(data, at)
                yield from _plain(held, at, end - at)
        except Damaged as why:
            end = _next(raw, data, at + 1)
            yield {"kind": "gap", "at": at, "size": end - at, "reason": str(why)}
        at = end


def write(pages: DataFrame, least: int = 0, roll: int = 32 << 20) -> DataFrame:
    """Write a record for each row of (page_id, url, html); (archive, n) of each archive
    written. Payloads of under ``least`` bytes are never revisits. An archive is closed
    once it has ``roll`` bytes."""
    folder = shared.fresh(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", shared.text_of("html").alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    held = (
        rows.filter(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "holder")
    )
    marked = rows.join(held, "digest", "left").select("page_id", "url", "html", "holder", (F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, written = filestore.Rolling(folder, ".warc.gz", roll), {}
        for batch in batches:
            for page_id, url, html, holder, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, _ = out.put(member(record(page_id, url, html.encode(), holder, bool(revisit))))
                written[name] = written.get(name, 0) + 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(written.keys(), pa.string()), pa.array(written.values(), pa.int64())], ["archive", "n"])

    return shared.cut(marked.mapInArrow(run, "archive string, n long"), "warc-list")


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """FOUND: the records and gaps of the archives named in column ``archive``. Without
    ``payloads`` that column is null."""
    schema = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = filestore.opened(name)
                with fs.open_input_file(path) as f:
                    raw = f.read()
                rows, size = [], 0
                for found in salvage(raw):
                    size += len(found.get("payload") or b"") if payloads else 200
                    rows.append(found | {"archive": name} | ({} if payloads else {"payload": None}))
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive").mapInArrow(run, FOUND)
