"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct k-word shingles. Under one order of all shingles, rare
ones first, two sets whose Jaccard similarity reaches the threshold share l shingles or
more of their l-prefixes, the first n - ceil(threshold * n) + l of a set of n. A longer
prefix costs more postings but leaves fewer candidates, so each document takes the l
with the least estimated cost, from the true posting counts of its prefix shingles. A
pair is verified on whole sets if it shares at least the smaller of both l.

The order is (estimated frequency, name). The estimate is a table of ``SLOTS`` counters
over all shingles of all documents; any deterministic order gives the same result.

Only connections are asked for, which keeps groups of many near copies from being
expanded into all pairs: equal sets are one node; rounds of leaders first link each node
to the candidate it shares most with and give both one label; then a shingle whose
postings all have one label needs no pair, and the others give the pairs of different
labels, so that no link between components is missed.

Defined results: a null or empty text, or one without words, has an empty set and is
linked with nothing. A document with fewer than k words has the whole sequence as its
only shingle. Rows that share a doc_id are told apart: each has the component of its own
text, and a component's name is the least doc_id of its rows. A null doc_id is linked with
nothing and has a null component. An empty table gives no rows. Other columns are
ignored. A very long text is handled whole, some 40 bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bytescan, graph, shared

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
_BLOCK = 1 << 12
#: Size of the filter that tells tasks which documents to compute sets of.
FILTER_BITS = 25
#: Prefixes are lengthened by at most this many shared shingles.
MOST_MATCHES = 4
#: Cost of verifying a candidate, in postings, for each shingle of the document.
VERIFY_COST = 0.25


def document_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle names."""
    body, offsets = bytescan.buffers(texts)
    for first, last in bytescan.pieces(offsets):
        part = offsets[first : last + 1]
        names, bounds, *_ = bytescan.words(body[part[0] : part[-1]], part - part[0])
        shingles = bytescan.shingle_names(names, k)
        for i in range(last - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= k:
                own = np.sort(shingles[a : b - k + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield bytescan.shingle_names(np.concatenate([names[a:b], np.full(1, b - a, np.uint64)]), b - a + 1)
            else:
                yield np.empty(0, np.uint64)


def counters(docs: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each slot occur, over all documents: SLOTS counters,
    summed on the executors in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            body, offsets = bytescan.buffers(batch.column(0))
            for first, last in bytescan.pieces(offsets):
                part = offsets[first : last + 1]
                names, bounds, *_ = bytescan.words(body[part[0] : part[-1]], part - part[0])
                at = bytescan.shingle_names(names, k) >> np.uint64(64 - SLOT_BITS)
                total += np.bincount(at.astype(np.int64), minlength=SLOTS)
        yield _as_blocks(total, TaskContext.get().partitionId() % 64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(held, "<u4").astype(np.int64)
                sums[block] = sums[block] + own if block in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([_small(v) for v in sums.values()], pa.binary())], ["block", "part", "counts"])

    schema = "block int, part int, counts binary"
    first = docs.select("text").mapInArrow(count, schema)
    some = first.repartition("block", "part").mapInArrow(add, schema)
    whole = some.repartition("block").mapInArrow(add, schema)
    total = np.zeros(SLOTS, np.uint32)
    for row in whole.toLocalIterator():  # SLOTS counters, whatever the input
        total[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, "<u4")
    return total


def _small(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes()


def _as_blocks(total: np.ndarray, part: int) -> pa.RecordBatch:
    n = SLOTS // _BLOCK
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([_small(total[b * _BLOCK : (b + 1) * _BLOCK]) for b in range(n)], pa.binary())], ["block", "part", "counts"])


def required(n: int, threshold: Fraction) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-n * threshold.numerator // threshold.denominator)


def prefixes(docs: DataFrame, k: int, threshold: Fraction, order: np.ndarray) -> DataFrame:
    """(doc_id, n, sig, prefix): the set's size, its digest and its longest prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = sent.value
        for batch in batches:
            sizes, sigs, heads = [], [], []
            for own in document_sets(batch.column(1), k):
                n = len(own)
                sizes.append(n)
                sigs.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                most = min(n, n - required(n, threshold) + MOST_MATCHES)
                heads.append(own[np.argsort(frequency[own >> np.uint64(64 - SLOT_BITS)], kind="stable")[:most]].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n", "sig", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, prefix array<long>")


def _hashed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each id in a filter."""
    at = bytescan.mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
    return (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8)


def id_filter(nodes: DataFrame) -> np.ndarray:
    """A bit map of 2**FILTER_BITS bits with the bit of every node set, gathered from the
    executors' own maps. More nodes make it let more through, never less."""
    n, size = 1 << FILTER_BITS - 15, 1 << 12

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits = np.zeros(n * size, np.uint8)
        for batch in batches:
            at, bit = _hashed(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at, bit)
        blocks = bits.reshape(n, size)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), TaskContext.get().partitionId() % 64), pa.int32()), pa.array([blocks[b].tobytes() for b in used], pa.binary())], ["block", "part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(bits, np.uint8)
                held[block] = held[block] | own if block in held else own
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "part", "bits"])

    schema = "block int, part int, bits binary"
    merged = nodes.select("node").mapInArrow(mark, schema).repartition("block", "part").mapInArrow(merge, schema).repartition("block").mapInArrow(merge, schema)
    out = np.zeros((n, size), np.uint8)
    for row in merged.toLocalIterator():  # one map, whatever the number of nodes
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, set) of the documents named in nodes. Tasks compute the sets of documents
    that pass the filter of nodes; the join drops those it passed by chance."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = _hashed(batch.column(0).to_numpy())
            batch = batch.filter(pa.array((sent.value[at] & bit) > 0))
            own = [s.view(np.int64) for s in document_sets(batch.column(1), k)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
            flat = np.concatenate(own) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "set"])

    passed = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(run, "node long, set array<long>")
    return passed.join(nodes.hint("merge"), "node", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, compared whole. The joins are
    sort-merge joins whatever the size, so that volumes grow with the pairs."""
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = shared.cut(nodes, "nodes")
    sets = shared.cut(sets_of(docs, nodes, k), "sets")
    shared.discard(nodes)
    left = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = both.withColumn("i", F.size(F.array_intersect("sa", "sb"))).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))
    edges = shared.cut(common.filter(F.col("i") * threshold.denominator >= F.col("u") * threshold.numerator).select("a", "b"), "links")
    shared.discard(sets)
    return edges


def _fits(a: str, b: str, threshold: Fraction) -> F.Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(a, b) * threshold.denominator >= F.greatest(a, b) * threshold.numerator


def _reachable(pos_a: str, pos_b: str, a: str, b: str, threshold: Fraction) -> F.Column:
    """Whether the pair can reach the threshold if its first common shingle is at these
    places: none before them is common."""
    most = F.least(F.col(a) - F.col(pos_a), F.col(b) - F.col(pos_b))
    return most * (threshold.numerator + threshold.denominator) >= (F.col(a) + F.col(b)) * threshold.numerator


def _chosen(live: DataFrame) -> DataFrame:
    """The postings of each document's cheapest prefix, with its l as ``need``."""
    from pyspark.sql import Window

    own = Window.partitionBy("node")
    for l in range(1, MOST_MATCHES + 1):
        live = live.withColumn(f"c{l}", F.sum(F.when(F.col("pos") < F.col("base") + (l - 1), F.col("df") - 1).otherwise(0)).over(own).cast("double"))
    cost = [F.when(F.lit(l) <= F.col("most"), F.col(f"c{l}") + F.col(f"c{l}") / l * F.col("n") * VERIFY_COST) for l in range(1, MOST_MATCHES + 1)]
    need = F.coalesce(*[F.when(cost[l - 1] == F.least(*cost), F.lit(l)) for l in range(1, MOST_MATCHES + 1)])
    return live.withColumn("need", need).filter(F.col("pos") < F.col("base") + F.col("need") - 1).select("token", "node", "n", "need", "pos")


def _leaders(live: DataFrame, last: bool, threshold: Fraction) -> DataFrame:
    """(a, b, la, lb): for each label la its best pair with another label lb. A shingle's
    leader is the node with the fewest rarer shingles, so of near copies one that has
    little of its own, or in other rounds the last node; of all pairs with leaders, the
    one that meets most often counts."""
    lead = live.groupBy("token").agg(F.max(F.struct("node", "n", "pos", "label")).alias("lead") if last else F.min(F.struct("pos", "node", "n", "label")).alias("lead"))
    met = live.join(lead.hint("merge"), "token").select("node", "n", "pos", "label", F.col("lead.node").alias("other"), F.col("lead.n").alias("m"), F.col("lead.pos").alias("at"), F.col("lead.label").alias("theirs"))
    met = met.filter("label <> theirs").filter(_fits("n", "m", threshold)).filter(_reachable("pos", "at", "n", "m", threshold))
    counted = met.groupBy("node", "other").agg(F.count(F.lit(1)).alias("met"), *[F.first(c).alias(c) for c in ("label", "theirs")])
    best = counted.groupBy(F.col("label").alias("la")).agg(F.max(F.struct("met", F.col("node").alias("a"), F.col("other").alias("b"), F.col("theirs").alias("lb"))).alias("p"))
    return best.select("p.a", "p.b", "la", "p.lb")


def _labelled(live: DataFrame, moves: DataFrame) -> DataFrame:
    """live with the labels that have moved: moves (la, lb) has a row for each such la.
    Of two labels that move to each other the lesser stays, and one step further is
    looked ahead; labels only save comparisons, so they needn't be whole components."""
    to = moves.select(F.col("la").alias("x"), F.col("lb").alias("y"))
    back = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
    one = to.hint("merge").join(back.hint("merge"), "y", "left").select("x", F.when(F.col("z") == F.col("x"), F.least("x", "y")).otherwise(F.col("y")).alias("y"))
    two = one.hint("merge").join(one.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select(F.col("x").alias("label"), F.coalesce("z", "y").alias("now"))
    return live.join(two.hint("merge"), "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")


def _repeats(docs: DataFrame) -> bool:
    """Whether rows share a doc_id."""
    return not docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def join(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), leader_rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    if not _repeats(docs):
        return _joined(docs, k, threshold, leader_rounds)
    numbered = shared.cut(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
    found = shared.cut(_joined(_by_row(numbered), k, threshold, leader_rounds), "joined")
    owned = found.select(F.col("doc_id").alias("row"), "n_shingles", "component_id").join(numbered.select("row", "doc_id"), "row")
    named = owned.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    known = owned.join(named, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return known.unionAll(found.filter("doc_id is null"))


def _by_row(numbered: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the row's number in place of each doc_id that isn't null."""
    return numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")


def _joined(docs: DataFrame, k: int, threshold: Fraction, leader_rounds: int) -> DataFrame:
    """join() where no two rows share a doc_id."""
    docs = docs.select("doc_id", "text")
    order = counters(docs, k)
    rows = shared.cut(prefixes(docs, k, threshold, order), "prefixes")
    copies = rows.filter("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("sig", "node")
    copies = shared.cut(copies, "copies")
    named = rows.join(copies.hint("merge"), "sig", "left").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")))
    firsts = named.filter("sig is not null and doc_id = node")
    base = F.col("n") - F.expr(f"(n * {threshold.numerator} + {threshold.denominator - 1}) div {threshold.denominator}") + 1
    postings = firsts.select("node", "n", base.alias("base"), F.posexplode("prefix").alias("pos", "token")).withColumn("most", F.least(F.lit(MOST_MATCHES).cast("long"), F.col("n") - F.col("base") + 1))
    shared_tokens = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    every = shared.cut(postings.join(shared_tokens.hint("merge"), "token"), "postings")
    owned = shared.cut(named.select("doc_id", "n", "node"), "owned")
    shared.discard(rows)
    shared.discard(copies)
    live = shared.cut(_chosen(every).withColumn("label", F.col("node")), "chosen")
    shared.discard(every)
    edges = None
    for turn in range(leader_rounds):
        pairs = shared.cut(_leaders(live, turn % 2 == 1, threshold), "leaders")
        found = verified(pairs.select("a", "b"), docs, k, threshold)
        edges = found if edges is None else edges.unionAll(found)
        before, live = live, shared.cut(_labelled(live, pairs.join(found.hint("merge"), ["a", "b"]).select("la", "lb")), "labelled")
        shared.discard(before)
        shared.discard(pairs)
    mixed = live.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    open_ = live.join(mixed.hint("merge"), "token")
    right = open_.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("pos").alias("pb"))
    left = open_.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("pos").alias("pa"))
    # the first shingle that a pair has in common decides whether it is reachable
    met = left.hint("merge").join(right.hint("merge"), "token").filter("a < b and la <> lb").filter(_fits("na", "nb", threshold)).filter(_reachable("pa", "pb", "na", "nb", threshold))
    heads = live.groupBy("node").agg(F.collect_set("token").alias("head"), F.min("need").alias("need"))  # at most a document's own prefix
    pairs = met.select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.hint("merge").join(heads.select(F.col("node").alias(side), F.col("head").alias(f"h{side}"), F.col("need").alias(f"e{side}")), side)
    pairs = pairs.filter(F.size(F.array_intersect("ha", "hb")) >= F.least("ea", "eb")).select("a", "b")
    pairs = shared.cut(pairs, "pairs")
    shared.discard(live)
    found = verified(pairs, docs, k, threshold)
    shared.discard(pairs)
    linked = graph.components(found if edges is None else edges.unionAll(found))
    return owned.join(linked.hint("merge"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs that stay when one document of each group does: the one with the
    least doc_id, and rows without a doc_id. Rows that share a doc_id are told apart by
    their texts."""
    if not _repeats(docs):
        judged = _joined(docs, k, threshold, 1).filter("doc_id is not null")
        lost = shared.cut(judged.filter("doc_id <> component_id").select("doc_id"), "lost")
        return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
    own = "row"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    numbered = shared.cut(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("doc_id", "text", F.col(own).alias("row"))
    judged = _joined(_by_row(rows), k, threshold, 1).filter("doc_id is not null").select(F.col("doc_id").alias("row"), "component_id")
    best = judged.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    lost = shared.cut(judged.join(best.select(F.col("best.row").alias("row")), "row", "left_anti").select(F.col("row").alias(own)), "lost")
    return numbered.join(lost, own, "left_anti").select(*docs.columns)
