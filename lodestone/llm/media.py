"""Media columns: payloads in tar shards under the name of their digest.

A writer task stores each distinct payload once in its own shards and returns, for each
row, digest, shard, offset and length. The directory then names one place for each
digest over all tasks, so that equal payloads share one address. Metadata columns come
from range reads of the header alone; decoding reads the stored bytes.

The stored form is a grey PNG, 64 samples wide, a payload byte a sample.

Defined results: a null text is empty, and an empty payload is one row of zeros. Null ids
and repeated rows keep a row each and share the payload's place. An empty table gives no
shard and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import filestore, shared

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the header chunk with its length, name and check sum.
HEADER_BYTES = 33
_END = bytes(1024)
STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DECODED = "digest string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DECODED = pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def padded(body: bytes) -> bytes:
    """body and zeros up to a positive multiple of 64."""
    return body + bytes(-len(body) % WIDTH) if body else bytes(WIDTH)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(payload: bytes, level: int = 6) -> bytes:
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">II", head[16:24])


def unpng(media: bytes) -> bytes:
    """The samples of what png() made."""
    width, rows = png_size(media[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        name, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + body):
            raise ValueError("PNG chunk is damaged")
        if name == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """64 bits in hex: which of the 64 columns are above the mean sample."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = lines.sum(0, dtype=np.int64) * WIDTH > lines.sum(dtype=np.int64)
    return np.packbits(columns).tobytes().hex()


def store(docs: DataFrame, roll: int = 64 << 20) -> DataFrame:
    """Write the payloads of (doc_id, text) to tar shards of about ``roll`` bytes; STORED,
    where each row has the place its own task wrote."""
    folder = shared.fresh(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, places = filestore.Rolling(folder, ".tar", roll, _END), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = (text.as_py() or "").encode()
                payload = padded(body)
                digest = hashlib.sha256(payload).digest()
                if digest not in places:
                    media = png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    shard, at = out.put(head, media, bytes(-len(media) % 512))
                    places[digest] = (shard, at + len(head), len(media))
                rows.append((doc_id, len(body), digest.hex(), *places[digest]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _STORED.types, strict=True)], schema=_STORED)
        out.close()

    return shared.cut(docs.select("doc_id", "text").mapInArrow(run, STORED), "media-rows")


def directory(stored: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one place for each digest."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")


def _ranges(batch: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[str, bytes]]:
    """The bytes at each row's place, or the first ``most`` of them; one open a shard."""
    rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True))
    name, f = None, None
    for shard, offset, length, digest in rows:
        if shard != name:
            if f is not None:
                f.close()
            fs, path = filestore.opened(shard)
            name, f = shard, fs.open_input_file(path)
        yield digest, f.read_at(min(length, most or length), offset)
    if f is not None:
        f.close()


def headers(places: DataFrame) -> DataFrame:
    """The directory with width and height, by range reads of HEADER_BYTES bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = {d: png_size(head) for d, head in _ranges(batch, HEADER_BYTES)}
            got = [sizes[d] for d in batch.column("digest").to_pylist()]
            yield batch.append_column("width", pa.array([w for w, _ in got], pa.int32())).append_column("height", pa.array([h for _, h in got], pa.int32()))

    return places.select("digest", "shard", "offset", "length").mapInArrow(run, "digest string, shard string, offset long, length long, width int, height int")


def decode(places: DataFrame) -> DataFrame:
    """DECODED: what the stored bytes of each digest hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = dict(zip(batch.column("digest").to_pylist(), zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True), strict=True))
            rows = []
            for digest, media in _ranges(batch):
                payload = unpng(media)
                rows.append((digest, *size[digest], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, _DECODED.types, strict=True)], schema=_DECODED)

    return places.mapInArrow(run, DECODED)
