"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing: each partition packs its own pieces best-fit and emits
the bins that are nearly full; underfull bins go up a tree as items of their own, and
every level packs them best-fit again. A level is dealt over as many tasks as keep a
task at ``block`` items, so no task grows with the input. Once a level merges hardly
anything, only bins that are at most half full go further up, until one task has had them
all: then no two of them are left that fit together.

Defined results: a null text is the empty text, whose only id is the end mark. Null
doc_ids and repeated rows are packed like any other row. An empty table gives no rows.
Other columns are ignored. Equal lengths are taken in the order of doc_id and piece. A
very long text is encoded by itself and takes some 60 bytes of memory a byte. With the
ids kept, rows that agree in all columns have one set of ids.
"""

from __future__ import annotations

import contextlib
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bytescan, shared

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
LAYOUT = f"{PIECES}, sequence_id long, offset long"
_BINS = "level int, task int, fill int, members binary"
#: Text encoded at once, and rows that a task hands to its Python worker at once.
BATCH_BYTES, BATCH_ROWS = 512 << 10, 1000
#: One packed piece; ``has`` is 0 for a null doc_id.
_PIECE = np.dtype([("doc_id", "<i8"), ("has", "<i4"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])

def _flags(*members: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes that are white space, or may be to some: ASCII controls and the space.
_BLANK = _flags(*range(33), 127)
#: Lead bytes of the characters of two and three bytes among which there is white space.
_LEAD_2, _LEAD_3 = _flags(0xC2), _flags(0xE1, 0xE2, 0xE3)
_OPEN = _BLANK | _LEAD_2 | _LEAD_3
_ASCII_LETTER = _flags(*range(65, 91), *range(97, 123))
#: Lead bytes of two-byte characters that are letters, but for two signs under 0xC3.
_LETTER_LEAD, _SIGN = _flags(0xC3, 0xD0, 0xD1), _flags(0x97, 0xB7)
#: ASCII marks that part words for a byte-level pre-tokenizer; the apostrophe may not.
_MARK = _flags(*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127))
_PLACES = _MARK | _flags(10, 32)
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xd0\xd1][\x80-\xbf])+")


def unit_bounds(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the bytes of a batch may be parted so that each part has the ids it has in
    its text: before a space between two characters that are no white space, on both
    sides of one or two line breaks between such, between a letter and an ASCII mark other
    than the apostrophe, and between texts. Where a neighbour
    might be white space (its lead byte allows it) nothing is parted."""
    n = len(body)
    cut, edge = np.zeros(n + 1, bool), np.zeros(n + 4, bool)
    cut[offsets] = edge[offsets] = True
    at = np.flatnonzero(_PLACES[body])
    body = np.concatenate([np.zeros(3, np.uint8), body, np.zeros(3, np.uint8)])
    own, one, two, three = body[at + 3], body[at + 2], body[at + 1], body[at]
    after, later = body[at + 4], body[at + 5]
    closed = ~(_BLANK[one] | _LEAD_2[two] | _LEAD_3[three] | edge[at])  # no white space ends here
    open_ = closed & ~(_OPEN[after] | edge[at + 1])
    cut[at[open_ & (own <= 32)]] = True
    line = own == 10
    cut[at[open_ & line] + 1] = True
    pair = at[line & closed & (after == 10) & ~(_OPEN[later] | edge[at + 1] | edge[at + 2])]
    for i in range(3):
        cut[pair + i] = True
    mark = _MARK[own]
    cut[at[mark & (_ASCII_LETTER[one] | _LETTER_LEAD[two] & ~(_SIGN[one] & (two == 0xC3)))]] = True
    cut[at[mark & (_ASCII_LETTER[after] | _LETTER_LEAD[after] & ~(_SIGN[later] & (after == 0xC3)))] + 1] = True
    return np.flatnonzero(cut)


def _characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it
    is printable, else one of those from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_CHARACTERS = _characters()


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file. Where its pre-tokenizer is the plain
    byte-level one, a batch is parted into units, which have the same ids by themselves;
    each distinct unit of the batch is encoded or looked up once, and the ids of the texts
    are gathered from there. At most ``most`` units are kept for later batches."""

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.marks = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.most = most
        self.units = pa.array([], pa.large_binary())  # those kept, and where their ids are
        self.flat, self.size = np.empty(0, "<u4"), np.empty(0, np.int32)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, unit: bytes) -> bytes:
        if _WORD.fullmatch(unit):  # one word to the pre-tokenizer: straight to the model
            return np.array([t.id for t in self.tokenizer.model.tokenize(unit.decode("latin-1").translate(_CHARACTERS))], "<u4").tobytes()
        return self._ids(unit.decode())

    def _known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): where the ids of each of these distinct units are."""
        held = pc.index_in(units, value_set=self.units)
        new = units.filter(held.is_null())
        found = list(map(self._unit, new.to_pylist()))
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        size = np.concatenate([self.size, np.fromiter(map(len, found), np.int32, len(found)) // 4])
        first = np.cumsum(size, dtype=np.int32) - size
        which = held.fill_null(-1).to_numpy()
        which = np.where(which >= 0, which, len(self.units) - 1 + np.cumsum(which < 0))
        room = max(0, self.most - len(self.units))
        if room and len(new):
            self.units = pa.concat_arrays([self.units, new.slice(0, room)])
            self.size = size[: len(self.units)].copy()
            self.flat = flat[: self.size.sum()].copy()
        return flat, first[which], size[which]

    def batch(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids[bounds[i]:bounds[i + 1]] are those of text i."""
        raw = body.tobytes()
        if not self.by_unit or any(m in raw for m in self.marks):
            parts = [np.frombuffer(self._ids(raw[a:z].decode()), "<u4") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate(parts) if parts else np.empty(0, "<u4"), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        cut = unit_bounds(body, offsets)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)])
        coded = units.dictionary_encode()
        flat, first, size = self._known(coded.dictionary)
        which = coded.indices.to_numpy()
        many = size[which]
        ends = np.cumsum(many, dtype=np.int64)
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
        return flat[np.repeat(first[which] - (ends - many), many) + place], np.append(0, ends)[np.searchsorted(cut, offsets)]

    def encode(self, text: str) -> bytes:
        """The ids of one text, as little-endian 32-bit bytes."""
        body = np.frombuffer(text.encode(), np.uint8)
        return self.batch(body, np.array([0, len(body)], np.int64))[0].astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process; later tasks of the process find its cache filled."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what is over."""
    return [(a, m) for _, _, a, m in zip(*(x.tolist() for x in _cut(np.array([n], np.int64), most)), strict=True)]


def _cut(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length) of the pieces of texts of these sizes, none of them 0:
    the first piece takes what is over."""
    n = -(-sizes // most)
    text = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    head = (sizes - (n - 1) * most)[text]
    return text, piece, np.where(piece == 0, 0, head + (piece - 1) * most), np.where(piece == 0, head, most)


def pieces(docs: DataFrame, path: str, end_id: int, max_tokens: int, keep_ids: bool = False) -> DataFrame:
    """Rows of PIECES, with the ids as an array where ``keep_ids`` is set."""
    schema = PIECES + (", ids array<long>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            body, offsets = bytescan.buffers(batch.column(1))
            for i, j in bytescan.pieces(offsets, BATCH_BYTES):
                part = offsets[i : j + 1]
                ids, bounds = enc.batch(body[part[0] : part[-1]], part - part[0])
                # each text's ids and the end mark after them
                ended = np.insert(ids.astype("<u4"), bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                text, piece, start, length = _cut(np.diff(bounds), max_tokens)
                at, raw = bounds[text] + start, memoryview(ended.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                own = batch.column(0).slice(i, j - i).take(pa.array(text))
                columns = [own, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:  # the pieces of a batch lie one after the other
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ended)).astype(np.int32)), pa.array(ended.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that takes it. Bins are
    stacked by what they have left; a bit mask of the stacks in use finds the best."""
    bins: list[list[int]] = []
    left: list[list[int]] = [[] for _ in range(room + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = used >> size
        if above and size <= room:
            at = size + ((above & -above).bit_length() - 1)
            b = left[at].pop()
            if not left[at]:
                used ^= 1 << at
            bins[b].append(i)
        else:
            at, b = room, len(bins)
            bins.append([i])
        if at - size > 0:
            if not left[at - size]:
                used |= 1 << (at - size)
            left[at - size].append(b)
    return bins


def _packed(members: list[np.ndarray], fills: np.ndarray, room: int, level: int, task: int) -> pa.RecordBatch:
    found = best_fit(fills, room)
    total = [int(fills[b].sum()) for b in found]
    blobs = [b"".join(members[i].tobytes() for i in b) for b in found]
    return pa.RecordBatch.from_arrays(
        [pa.array([level] * len(found), pa.int32()), pa.array([task] * len(found), pa.int32()), pa.array(total, pa.int32()), pa.array(blobs, pa.binary())],
        ["level", "task", "fill", "members"],
    )


def _leaves(room: int, block: int):
    """Pack the pieces of a partition, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["piece"], rows["doc_id"], rows["has"]))]
            held.clear()
            return _packed(list(rows), rows["length"].astype(np.int64), room, 0, task)

        for batch in batches:
            rows = np.zeros(batch.num_rows, _PIECE)
            ids = batch.column(0)
            rows["has"] = ids.is_valid().to_numpy(zero_copy_only=False)
            rows["doc_id"] = ids.fill_null(0).to_numpy()
            for name, column in zip(("piece", "start", "length", "crc"), batch.columns[1:], strict=True):
                rows[name] = column.to_numpy()
            held.append(rows)
            if sum(map(len, held)) >= block:
                yield flush()
        if held:
            yield flush()

    return run


def _merges(room: int, level: int):
    """Pack the underfull bins of a task as items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        members: list[bytes] = []
        for batch in batches:
            members += batch.column("members").to_pylist()
        if members:
            members.sort()  # whatever order the shuffle gave them
            rows = [np.frombuffer(m, _PIECE) for m in members]
            fills = np.array([int(r["length"].sum()) for r in rows], np.int64)
            yield _packed(rows, fills, room, level, TaskContext.get().partitionId())

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of each bin, at its place in the bin."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [np.frombuffer(m, _PIECE) for m in batch.column("members").to_pylist()]
        rows = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(rows["length"].astype(np.int64))
        begins = ends - rows["length"]
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows["doc_id"], mask=rows["has"] == 0),
                pa.array(rows["piece"]),
                pa.array(rows["start"]),
                pa.array(rows["length"].astype(np.int64)),
                pa.array(rows["crc"].astype(np.int64)),
                pa.array(np.repeat(batch.column("sequence_id").to_numpy(), sizes)),
                pa.array(begins - begins[first]),
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS, as texts in them are held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pack(docs: DataFrame, path: str, end_id: int = 2, max_tokens: int = 1024, full_at: int | None = None, block: int = 16_384, keep_ids: bool = False) -> DataFrame:
    """Lay all documents out in sequences of at most ``max_tokens`` ids.

    path: a ``tokenizers`` file that every executor has. Each document is its ids and
    then ``end_id``; only longer ones are cut. A bin of ``full_at`` ids or more (by
    default all but 1/128) is emitted at once; others are merged further up. Returns
    LAYOUT, a row for each piece, and with ``keep_ids`` the ids themselves.
    """
    full_at = full_at or max_tokens - max_tokens // 128
    with _small_batches(docs.sparkSession):
        cutup = shared.cut(pieces(docs, path, end_id, max_tokens, keep_ids), "pieces")
    whole = cutup.filter(F.col("length") == max_tokens).select(*LAYOUT_NAMES[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cutup.filter(F.col("length") < max_tokens).select(*LAYOUT_NAMES[:5])
    bins = shared.cut(rest.mapInArrow(_leaves(max_tokens, block), _BINS), "bins-0")
    done, level, least = [bins.filter(F.col("fill") >= full_at)], 0, full_at
    under = bins.filter(F.col("fill") < full_at)
    n = under.count()
    while n > 1:
        level += 1
        tasks, before = -(-n // block), n
        bins = shared.cut(under.repartition(tasks, F.xxhash64("members")).mapInArrow(_merges(max_tokens, level), _BINS), f"bins-{level}")
        if least == full_at and bins.filter(F.col("fill") < full_at).count() > 0.98 * before:
            least = max_tokens // 2 + 1  # of two bins that fit together one is at most half full
        done.append(bins.filter(F.col("fill") >= least))
        under = bins.filter(F.col("fill") < least)
        n = under.count()
        if tasks == 1:  # no task leaves two bins that are at most half full
            break
    done.append(under)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    ids = every.withColumn("sequence_id", F.monotonically_increasing_id())
    laid = ids.select("members", "sequence_id").mapInArrow(_unpacked, LAYOUT).unionByName(whole)
    if keep_ids:
        own = cutup.select(*[F.col(c).alias(f"_{c}") for c in LAYOUT_NAMES[:5]], "ids").dropDuplicates([f"_{c}" for c in LAYOUT_NAMES[:5]])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LAYOUT_NAMES[:5]]
        laid = laid.join(own, functools.reduce(lambda x, y: x & y, same), "left").select(*LAYOUT_NAMES, "ids")
    return laid


LAYOUT_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
