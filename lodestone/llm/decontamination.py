"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if the seeds that they share, runs of ``seed``
words or of ``least`` where that is fewer, cover ``coverage`` of the item's words. A tile
consists of shared seeds, so no pair that tiling would report is left out. Tiling then marks the longest runs of words that both have, longest first and
never overlapping: Karp-Rabin names of all unmarked runs of the search length find the
matches, which are extended, marked by falling length, and the search length falls until
``least``. As tiles may lie in any order, a reordered passage is covered as well. A
document holds an item if the tiles cover ``coverage`` of the item's words.

Words are runs of ASCII letters and digits and of any other characters; ASCII marks and
white space part words; case is folded for ASCII and Latin-1 letters.

Documents are scanned where they lie, with no shuffle. Benchmark items go to the tasks in
blocks of at most ``BLOCK_BYTES`` of text, however many blocks that takes.

Defined results: null and empty texts share nothing. An item without words is never
found. A document that repeats an item is reported once. Rows repeated in full are
reported as often as they occur. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bytescan

BLOCK_BYTES = 32 << 20
#: Places of shared seeds in items that are looked at together.
PLACES = 1 << 22
FOUND = "doc_id long, item_id long, coverage double, tiles int, longest int"
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())])


def folded(body: np.ndarray) -> np.ndarray:
    """Latin-1 capitals in UTF-8 (0xC3 0x80 to 0x9E) as small letters."""
    out = body.copy()
    if len(out) > 1:
        capital = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def runs(names: np.ndarray, free: np.ndarray, k: int) -> np.ndarray:
    """Where unmarked runs of k words begin."""
    if len(names) < k:
        return np.empty(0, np.int64)
    blocked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(blocked[k:] == blocked[:-k])


def _matches(doc, item, free_doc, free_item, k: int) -> list[tuple[int, int, int]]:
    """(length, place in doc, place in item) of maximal unmarked matches of k or more."""
    at_item, at_doc = runs(item, free_item, k), runs(doc, free_doc, k)
    if not len(at_item) or not len(at_doc):
        return []
    held: dict[int, list[int]] = {}
    for j, name in zip(at_item.tolist(), bytescan.shingle_names(item, k)[at_item].tolist(), strict=True):
        held.setdefault(name, []).append(j)
    names = bytescan.shingle_names(doc, k)[at_doc]
    keep = np.isin(names, np.fromiter(held, np.uint64, len(held)))
    out, ends = [], {}
    for i, name in zip(at_doc[keep].tolist(), names[keep].tolist(), strict=True):
        for j in held[name]:
            if ends.get(i - j, -1) > i:  # inside a match of this diagonal
                continue
            n = k
            while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                n += 1
            out.append((n, i, j))
            ends[i - j] = i + n - k + 1
    return out


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in doc, place in item), longest first."""
    least = max(1, min(least, len(item)))
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles, k = [], max(least, min(len(item), 20))
    while True:
        found = _matches(doc, item, free_doc, free_item, k)
        longest = max(found, default=(0,))[0]
        if longest > 2 * k:
            k = longest
            continue
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_doc[i : i + n].all() and free_item[j : j + n].all():
                free_doc[i : i + n] = free_item[j : j + n] = False
                tiles.append((n, i, j))
        # what a longer tile has covered in part is searched again at this length
        if found and any(free_doc[i : i + n].any() and free_item[j : j + n].any() for n, i, j in found) and _matches(doc, item, free_doc, free_item, k):
            continue
        if k == least or not free_item.any():
            return tiles
        k = max(least, k // 2)


class Items:
    """Benchmark items ready to be sought."""

    def __init__(self, rows: list[tuple[int, str]], seed: int):
        body, offsets = bytescan.buffers(pa.array([t for _, t in rows], pa.string()))
        names, bounds, *_ = bytescan.words(folded(body), offsets, marks=True)
        self.ids = [i for i, _ in rows]
        self.words = [names[bounds[i] : bounds[i + 1]] for i in range(len(rows))]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.seeds = {}
        for k in sorted({min(seed, len(w)) for w in self.words} - {0}):
            own = [(i, bytescan.shingle_names(w, k)) for i, w in enumerate(self.words) if min(seed, len(w)) == k]
            named = np.concatenate([n for _, n in own])
            item = np.repeat([i for i, _ in own], [len(n) for _, n in own])
            place = np.concatenate([np.arange(len(n)) for _, n in own])
            order = np.argsort(named, kind="stable")
            keys, first = np.unique(named[order], return_index=True)
            table = np.zeros(1 << 20, bool)
            table[keys >> np.uint64(44)] = True
            self.seeds[k] = (keys, np.append(first, len(order)), item[order], place[order], table)

    def sought(self, body: np.ndarray, offsets: np.ndarray, coverage: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, the text's words) for each pair whose shared seeds cover enough."""
        names, bounds, *_ = bytescan.words(folded(body), offsets, marks=True)
        pairs: list[tuple[int, int]] = []
        for k, (keys, first, item, place, table) in self.seeds.items():
            shingles = bytescan.shingle_names(names, k)
            at = np.flatnonzero(table[shingles >> np.uint64(44)])
            key = np.minimum(np.searchsorted(keys, shingles[at]), len(keys) - 1)
            same = keys[key] == shingles[at]
            at, key = at[same], key[same]
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + k <= bounds[text + 1]
            found = np.unique(text[inside] * len(keys) + key[inside])  # once a text
            text, key = found // len(keys), found % len(keys)
            many = first[key + 1] - first[key]
            for i, j in self._slices(text, many):
                pairs += self._covered(k, text[i:j], first[key[i:j]], many[i:j], item, place, coverage)
        for text, item in sorted(pairs):
            yield text, item, names[bounds[text] : bounds[text + 1]]

    @staticmethod
    def _slices(text: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of whole texts with about ``PLACES`` places in items, or one text."""
        i, ends = 0, np.append(np.flatnonzero(np.diff(text)) + 1, len(text))
        total = np.concatenate([[0], np.cumsum(many)])
        while i < len(text):
            fit = ends[(ends > i) & (total[ends] <= total[i] + PLACES)]
            j = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, i, "right")])
            yield i, j
            i = j

    def _covered(self, k: int, text, first, many, item, place, coverage: float) -> list[tuple[int, int]]:
        """The (text, item) pairs where enough of the item's words lie in shared seeds."""
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(first, many) + step
        pair, where = np.repeat(text, many) * len(self.ids) + item[at], place[at]
        order = np.lexsort((where, pair))
        pair, where = pair[order], where[order]
        if not len(pair):
            return []
        words = np.full(len(pair), k)
        again = pair[1:] == pair[:-1]
        words[:-1][again] = np.minimum(k, np.diff(where)[again])
        starts = np.flatnonzero(np.append(True, ~again))
        pair, words = pair[starts], np.add.reduceat(words, starts)
        enough = words / self.sizes[pair % len(self.ids)] >= coverage
        return [divmod(p, len(self.ids)) for p in pair[enough].tolist()]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    if n <= 1:
        return [benchmark]
    n *= 2  # room for uneven blocks
    return [benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)]


def _hits(items: Items, texts: pa.Array, least: int, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    body, offsets = bytescan.buffers(texts)
    for first, last in bytescan.pieces(offsets):
        part = offsets[first : last + 1]
        for text, item, words in items.sought(body[part[0] : part[-1]], part - part[0], coverage):
            tiles = tile(words, items.words[item], least)
            share = sum(n for n, *_ in tiles) / len(items.words[item])
            if share >= coverage:
                yield first + text, items.ids[item], share, len(tiles), max(tiles)[0]


def _rows(block: DataFrame) -> list[tuple[int, str]]:
    return [(r.item_id, r.text) for r in block.select("item_id", "text").filter("text is not null").toLocalIterator()]


def find(docs: DataFrame, benchmark: DataFrame, seed: int = 5, least: int = 3, coverage: float = 0.8) -> DataFrame:
    """FOUND: a row for each document (doc_id, text) and item (item_id, text) that it holds."""
    out = None
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(_rows(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, min(seed, max(1, least)))
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *rest) for i, *rest in _hits(items, batch.column(1), least, coverage)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _FOUND.types, strict=True)], schema=_FOUND)

        found = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, least: int = 3, coverage: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(_rows(block))
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, min(seed, max(1, least)))
            for batch in batches:
                held = {i for i, *_ in _hits(items, batch.column(at), least, coverage)}
                keep = np.ones(batch.num_rows, bool)
                keep[list(held)] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
