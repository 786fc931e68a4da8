"""Removal of repeated byte strings, by counting hashed representatives.

Wanted are all starts p whose string of ``length`` bytes also starts earlier. This isn't
prefix doubling: no pair of ranks is sorted and no length doubles. Plain prefix doubling,
a row a byte, shuffles 31 times the input in its first round and 61 times in all (measured
on the 2.5 MB of documents at scale 0.01), more than the disk that is allowed. Starts are
handled in runs here and leave as soon as they are unique:

1.  Each start is represented by the least-named quarter-length string within its own
    string, a function of that string alone. Starts next to each other mostly share it, so
    a document has about one run for every 35 bytes. Spark counts the names of these
    representatives; runs with a unique one are done.
2.  Runs that agree in all bytes their starts can see are one class, whose first member
    stays and whose others are removed; representatives of one class only are done.
3.  What is left is named again by more bytes: runs are cut into blocks of starts at fixed
    distances from the representative, named by the bytes that all starts of a block share
    (88 of 100), and unique blocks are done; then start by start, at the full length.

Names are 64 bits derived from the bytes, so none is fetched by a shuffle. Two different
strings get one name with a probability of about 2**-60.

Every step is an equi join or a partial aggregate over (name, class, document, place)
rows; no group is gathered in one task, and texts move twice, by document.

Defined results: a null or empty text has no bytes. Rows with a null doc_id are neither
changed nor looked up. Rows that share doc_id and text are one document. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bytescan, shared

U64 = np.uint64
BLOCK = 13
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
# A run is packed as first << 16 | (last - first) << 8 | (representative - first).


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(body: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, name, class, first, last, representative) of every run of a batch; places
    count from the begin of the batch."""
    quarter = length // 4
    if len(body) < length:
        return (np.empty(0, np.int64), np.empty(0, U64), np.empty(0, U64), *[np.empty(0, np.int64)] * 3)
    sums = bytescan.prefix_sums(body)
    names = bytescan.window_names(body, quarter, sums)
    ranked = (names & U64(0xFFFFFFFF00000000)) | np.arange(len(names), dtype=U64)
    chosen = (_least(ranked, length - quarter + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    own = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    first, last, own, text = start[at], start[np.append(at[1:], len(start)) - 1] if len(at) else start[at], own[at], text[at]
    _, down = bytescan.powers(len(body) + 1)
    seen = bytescan.mix((sums[last + length] - sums[first]) * down[first])
    return text, names[own], seen ^ bytescan.mix(((own - first) << 16 | (last - first)).astype(U64) + U64(1)), first, last, own


def scan(docs: DataFrame, length: int) -> DataFrame:
    """(name, class, doc, run) of every run of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            body, offsets = bytescan.buffers(batch.column(1))
            for i, j in bytescan.pieces(offsets):
                part = offsets[i : j + 1]
                text, name, seen, first, last, own = runs(body[part[0] : part[-1]], part - part[0], length)
                begin = first - (part - part[0])[text]
                packed = begin << 16 | (last - first) << 8 | (own - first)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(seen.view(np.int64)), pa.array(ids[i + text]), pa.array(packed)], ["name", "class", "doc", "run"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "name long, class long, doc long, run long")


def _split(rows: DataFrame, length: int, first: Column, span: Column) -> tuple[DataFrame, DataFrame]:
    """Of rows (name, class, doc, run): the byte ranges (doc, begin, end) of members that
    aren't the first of their class, and the first members of names with several classes.
    ``first`` and ``span`` give a row's first start and the distance to its last."""
    classes = shared.cut(rows.groupBy("name", "class").agg(F.min(F.struct("doc", "run")).alias("head"), F.count(F.lit(1)).alias("n")), "classes")
    several = classes.filter("n > 1").select("name", "class", F.col("head.doc").alias("hd"), F.col("head.run").alias("hr"))
    removed = rows.join(several, ["name", "class"]).filter("doc <> hd or run <> hr").select("doc", first.alias("begin"), (first + span + length).alias("end"))
    mixed = classes.groupBy("name").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("name")
    heads = classes.join(mixed, "name").select("name", "head.doc", "head.run")
    return shared.cut(removed, "removed"), shared.cut(heads, "heads")


def _bodies(docs: DataFrame, heads: DataFrame, length: int) -> DataFrame:
    """(doc, run, body) with the bytes that the starts of each run see."""
    places = heads.groupBy("doc").agg(F.collect_set("run").alias("runs"))  # at most a document's own runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                body = text.as_py().encode()
                packed = np.sort(held.values.to_numpy())
                begin, span = packed >> 16, packed >> 8 & 255
                parts = [body[b : b + s + length] for b, s in zip(begin.tolist(), span.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), doc)), pa.array(packed), pa.array(parts, pa.binary())], ["doc", "run", "body"])

    return docs.select(F.col("doc_id").alias("doc"), "text").join(places, "doc").select("doc", "text", "runs").mapInArrow(run, "doc long, run long, body binary")


def _spread(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(sums, powers, begin of body, run) of a batch of bodies."""
    body, offsets = bytescan.buffers(batch.column(2))
    return bytescan.prefix_sums(body), bytescan.powers(len(body) + 1)[1], offsets[:-1], batch.column(1).to_numpy()


def blocks(bodies: DataFrame, length: int, width: int = BLOCK) -> DataFrame:
    """(name, class, doc, run) of the blocks of starts of each run; here ``run`` packs the
    block as first start << 8 | last - first, and ``of`` is the run it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums, down, base, packed = _spread(batch)
            first, span, own = packed >> 16, packed >> 8 & 255, packed & 255
            low, high = (own - span) // width, own // width  # blocks count by the distance before the representative
            n = high - low + 1
            row = np.repeat(np.arange(len(n)), n)
            block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
            far, near = np.minimum(own[row], block * width + width - 1), np.maximum(own[row] - span[row], block * width)
            mine = base[row] + own[row]
            a, z = mine - block * width, mine - block * width - width + 1 + length  # what all its starts share
            core = bytescan.mix((sums[z] - sums[a]) * down[a]) + bytescan.mix(block.astype(U64) + U64(77))
            a, z = mine - far, mine - near + length
            seen = bytescan.mix((sums[z] - sums[a]) * down[a]) ^ bytescan.mix((far << 16 | near).astype(U64) + U64(7))
            start = first[row] + own[row] - far
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(seen.view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(start << 8 | (far - near)), pa.array(packed[row])], ["name", "class", "doc", "run", "of"])

    return bodies.mapInArrow(run, "name long, class long, doc long, run long, of long")


def starts(bodies: DataFrame, length: int) -> DataFrame:
    """(name, doc, at) of the starts in ``wanted`` blocks of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums, down, base, packed = _spread(batch)
            wanted = batch.column(3)
            held = wanted.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            n = (held & 255) + 1
            which = np.repeat(np.arange(len(held)), n)
            at = (held >> 8)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            row = row[which]
            a = base[row] + at - (packed >> 16)[row]
            name = bytescan.mix((sums[a + length] - sums[a]) * down[a])
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(at)], ["name", "doc", "at"])

    return bodies.mapInArrow(run, "name long, doc long, at long")


def removed_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, begin, end): byte ranges whose union is what has to go."""
    if length % 4 or not 4 * BLOCK <= length <= 255:
        raise ValueError("length is a multiple of 4, 52 to 252")
    every = shared.cut(scan(docs, length), "runs")
    again = every.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    live = shared.cut(every.join(again, "name"), "live")
    shared.discard(every)
    del again
    shared.release(docs.sparkSession)
    whole, heads = _split(live, length, F.shiftright("run", 16), F.shiftright("run", 8).bitwiseAND(F.lit(255)))
    shared.discard(live)
    bodies = shared.cut(_bodies(docs, heads, length), "bodies")
    cut_up = shared.cut(blocks(bodies, length), "blocks")
    again = cut_up.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    kept = shared.cut(cut_up.join(again, "name"), "live")
    shared.discard(cut_up)
    part, heads = _split(kept, length, F.shiftright("run", 8), F.col("run").bitwiseAND(F.lit(255)))
    # a block's head is named by document and start; its run is looked up again
    of = kept.select("doc", "run", "of").join(heads.select("doc", "run").distinct(), ["doc", "run"], "left_semi").distinct()
    wanted = of.groupBy("doc", F.col("of").alias("r")).agg(F.collect_set("run").alias("wanted"))  # at most a run's blocks
    single = shared.cut(starts(bodies.join(wanted.withColumnRenamed("r", "run"), ["doc", "run"]).select("doc", "run", "body", "wanted"), length), "starts")
    shared.discard(kept)
    shared.discard(bodies)
    heads = single.groupBy("name").agg(F.min(F.struct("doc", "at")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.col("head.doc").alias("hd"), F.col("head.at").alias("ha"))
    last = shared.cut(single.join(heads, "name").filter("doc <> hd or at <> ha").select("doc", F.col("at").alias("begin"), (F.col("at") + length).alias("end")), "removed")
    shared.discard(single)
    return whole.unionAll(part).unionAll(last)


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the union of ranges."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return begin[at], reach[np.append(at[1:], len(begin)) - 1]


def _kept(body: bytes, ranges: pa.Scalar) -> tuple[list[bytes], int, int]:
    """(kept parts, bytes removed, maximal runs removed)."""
    if not ranges.is_valid or not len(ranges.values):
        return [body], 0, 0
    begin, end = _merged(ranges.values.field("begin").to_numpy(), ranges.values.field("end").to_numpy())
    edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(body)]
    return [body[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)], int((end - begin).sum()), len(begin)


def dedup(docs: DataFrame, length: int = 100, texts: bool = False) -> DataFrame:
    """RESULT for each row of docs (doc_id, text), and with ``texts`` the kept bytes."""
    docs = docs.select("doc_id", shared.text_of().alias("text"))
    ranges = removed_ranges(docs, length).groupBy("doc").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))  # at most a document's own starts
    both = docs.join(ranges, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                body = text.as_py().encode()
                parts, n, spans = _kept(body, own)
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                rows.append((doc, len(body), n, spans, digest.hexdigest()))
                if texts:
                    held.append(b"".join(parts))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _RESULT.types, strict=True)], schema=_RESULT)
            yield out.append_column("kept", pa.array(held, pa.binary())) if texts else out

    return both.mapInArrow(run, RESULT + (", kept binary" if texts else ""))
