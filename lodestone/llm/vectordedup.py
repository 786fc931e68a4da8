"""Near duplicates among vectors by small-world graphs, one per shard.

Rows with an equal label and vector are one entry with a weight. The entries of a label
are dealt by hash to shards of about ``shard_rows``; each shard's graph is built by one
task and its nodes are written to a table. Then every shard's entries, as a block of
queries, visit the graphs of all shards of their label, one graph after the other, so a
task holds one block and one graph whatever the label's size.

A graph's nodes stand for balls: entries within half the angle of the threshold. Two
members of a ball are linked for certain, by the triangle inequality of angles, so a
group of near copies is counted and never expanded into pairs. A candidate node is
verified in double precision: near enough, it links with the whole ball; else with those
members whose cosine reaches the threshold.

Each task audits itself: for some of its queries it takes the true nearest node and all
true nodes in reach by brute force, and while the search has found less than ``recall`` of
them the beam is doubled and the block searched again, up to all nodes. Queries whose
whole beam is in reach widen theirs in any case. Links become a star a block and graph;
stars are united across shards by ``graph.components``.

Defined results: vectors that are null, empty or zero or hold a null, NaN or infinite
component, rows with a null label and rows with a null id link with nothing; they are
components of their own and kept (a null id has a null component). Vectors of different
length aren't compared. Rows that repeat an id are told apart as rows, so each counts as a
link of the other where their vectors link, but share a component. Ties at the threshold
are links. An empty table gives no rows. Other columns are kept; columns named like one of
the results are replaced, and names that begin with an underscore are the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import graph, shared, smallworld

#: Entries of a shard on average: a task's memory is some 2 KB an entry of 64 components,
#: and every query visits every shard of its label, so few large shards are best.
SHARD_ROWS = 16_384
DEGREE, BEAM = 12, 32
AUDITED = 48
RESULTS = ("n_links", "component_id", "kept")

_NODES = "shard int, node int, ball int, rep long, weight long, vector array<double>, near array<int>"
_FOUND = "label_key string, rep long, vector array<double>, total long, beam int, recall double, root long"


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: finite throughout and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)])
    return flat.astype(dtype).reshape(len(column), -1)


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _built(table: pa.Table, half: float) -> pa.Table:
    """The node table of one shard: nodes in order of their level with their neighbours
    (layer after layer), then the other members of each ball."""
    table = table.sort_by("rep")
    rep = _ints(table["rep"])
    level = smallworld.levels(rep, DEGREE)
    order = np.argsort(-level, kind="stable")
    vectors = _matrix(table["vector"])[order]
    world, of_node, node_of = smallworld.build(smallworld.unit(vectors), level[order], half, DEGREE)
    place = np.full(len(order), -1)
    place[of_node] = np.arange(len(of_node))
    near = [[int(x) for t in world.tables if n < len(t) for x in t[n]] for n in range(len(of_node))]
    return pa.table({
        "label_key": table["label_key"].take(order),
        "shards": table["shards"].take(order),
        "shard": table["shard"].take(order),
        "node": pa.array(place, pa.int32()),
        "ball": pa.array(node_of, pa.int32()),
        "rep": table["rep"].take(order),
        "weight": table["weight"].take(order),
        "vector": table["vector"].take(order),
        "near": pa.array([near[p] if p >= 0 else [] for p in place], pa.list_(pa.int32())),
    })


class _Shard:
    """A graph read back from its rows, with the members of every ball side by side."""

    def __init__(self, rows: pa.Table):
        node, ball = _ints(rows["node"]), _ints(rows["ball"])
        order = np.lexsort((node < 0, ball))
        self.ball, self.vectors = ball[order], smallworld.unit(_matrix(rows["vector"]))[order]
        self.rep, self.weight = _ints(rows["rep"])[order], _ints(rows["weight"])[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.ball))])
        self.balls = len(self.start) - 1
        self.total = np.add.reduceat(self.weight, self.start[:-1])
        self.centres = self.vectors[self.start[:-1]]
        lists = rows["near"].take(np.flatnonzero(node >= 0)[np.argsort(node[node >= 0])]).combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().astype(np.int64)
        deep = (np.diff(ends) // DEGREE - 2).astype(np.int64)
        tables = [flat[(ends[:-1][deep >= k] - ends[0])[:, None] + np.arange(2 * DEGREE if k == 0 else DEGREE) + (0 if k == 0 else (k + 1) * DEGREE)] for k in range(int(deep.max()) + 1)]
        self.world = smallworld.SmallWorld(self.centres.astype(np.float32), tables)


def _candidates(shard: _Shard, asked: np.ndarray, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the nodes in reach, and of the nearest one of each query. A query
    whose beam is full of nodes in reach is searched again with twice the beam."""
    narrow, todo, found = asked.astype(np.float32), np.arange(len(asked)), []
    while len(todo):
        ids, sims = shard.world.nearest(narrow[todo], min(beam, shard.balls))
        full = (sims[:, -1] >= reach) if beam < shard.balls else np.zeros(len(todo), bool)
        good = (sims >= reach) & ~full[:, None]
        good[:, 0] |= ~full
        good &= ids >= 0
        line, place = np.nonzero(good)
        found.append((todo[line], ids[line, place].astype(np.int64)))
        todo, beam = todo[full], beam * 2
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _audit(shard: _Shard, asked: np.ndarray, query: np.ndarray, node: np.ndarray, reach: float) -> float:
    """The share of what brute force finds for some queries that a search has found."""
    some = np.unique(np.linspace(0, len(asked) - 1, min(AUDITED, len(asked))).astype(np.int64))
    sims = asked[some] @ shard.centres.T
    true = sims >= reach + 1e-6
    true[np.arange(len(some)), sims.argmax(axis=1)] = True
    line = np.full(len(asked), -1)
    line[some] = np.arange(len(some))
    mine = line[query] >= 0
    found = np.zeros_like(true)
    found[line[query[mine]], node[mine]] = True
    return float((found & true).sum() / true.sum())


def _verified(shard: _Shard, asked: np.ndarray, query: np.ndarray, node: np.ndarray, least: float, half: float) -> np.ndarray:
    """The weight that each (query, node) pair links: the whole ball's where the node is
    near enough, else that of the members whose cosine is ``least`` or more."""
    cosine = np.concatenate([np.einsum("ij,ij->i", asked[query[i : i + 65_536]], shard.centres[node[i : i + 65_536]]) for i in range(0, len(query), 65_536)] or [np.zeros(0)])
    size = np.diff(shard.start)[node]
    weight = np.where(cosine >= half, shard.total[node], 0)
    alone = (cosine < half) & (size == 1)
    weight[alone] = np.where(cosine[alone] >= least, shard.total[node[alone]], 0)
    rest = np.flatnonzero((cosine < half) & (size > 1))
    rest = rest[np.argsort(node[rest], kind="stable")]
    for part in np.split(rest, np.flatnonzero(np.diff(node[rest])) + 1) if len(rest) else []:
        a, z = shard.start[node[part[0]]], shard.start[node[part[0]] + 1]
        step = max(1, 4_000_000 // (z - a))
        for i in range(0, len(part), step):
            here = part[i : i + step]
            weight[here] = ((asked[query[here]] @ shard.vectors[a:z].T) >= least) @ shard.weight[a:z]
    return weight


def _stars(query: np.ndarray, node: np.ndarray, query_rep: np.ndarray, node_rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each query and node reaches over the links of one block and graph."""
    own, other = query_rep.copy(), node_rep.copy()
    while True:
        before = own.copy()
        np.minimum.at(other, node, own[query])
        np.minimum.at(own, query, other[node])
        if np.array_equal(own, before):
            return own, other


def _visits(least: float, recall: float, beam: int):
    """The function of a partition: rows of a block's queries, then its label's graphs."""
    angle = math.acos(least)
    half, reach = math.cos(angle / 2) + 1e-12, math.cos(min(1.5 * angle, math.pi)) - 1e-6

    def visited(block: pa.Table, graphs: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        rep, weight = _ints(block["rep"]), _ints(block["weight"])
        asked = smallworld.unit(_matrix(block["vector"]))
        number, total, wide, worst = block["shard"][0].as_py(), np.zeros(len(rep), np.int64), beam, 1.0
        key = block["label_key"][0].as_py()
        rows: dict[str, list] = {"rep": [], "root": []}
        for table in graphs:
            shard = _Shard(table)
            while True:
                query, node = _candidates(shard, asked, wide, reach)
                share = _audit(shard, asked, query, node, reach)
                if share >= recall or wide >= shard.balls:
                    break
                wide *= 2
            worst = min(worst, share)
            if table["shard"][0].as_py() == number:  # a query's own ball is known
                place = dict(zip(shard.rep.tolist(), shard.ball.tolist(), strict=True))
                pairs = np.unique(np.stack([np.concatenate([query, np.arange(len(rep))]), np.concatenate([node, [place[r] for r in rep.tolist()]])]), axis=1)
                query, node = pairs[0].astype(np.int64), pairs[1].astype(np.int64)
            linked = _verified(shard, asked, query, node, least, half)
            np.add.at(total, query, linked)
            query, node = query[linked > 0], node[linked > 0]
            own, other = _stars(query, node, rep, shard.rep[shard.start[:-1]])
            for ids, roots in ((rep, own), (shard.rep[shard.start[:-1]], other)):
                moved = ids != roots
                rows["rep"] += ids[moved].tolist()
                rows["root"] += roots[moved].tolist()
        n = len(rep)
        yield from pa.table({
            "label_key": pa.array([key] * n, pa.string()), "rep": pa.array(rep), "vector": block["vector"].combine_chunks(), "total": pa.array(total - 1),
            "beam": pa.array([wide] * n, pa.int32()), "recall": pa.array([worst] * n, pa.float64()), "root": pa.nulls(n, pa.int64()),
        }).to_batches()
        n = len(rows["rep"])
        yield from pa.table({
            "label_key": pa.array([key] * n, pa.string()), "rep": pa.array(rows["rep"], pa.int64()), "vector": pa.nulls(n, pa.list_(pa.float64())), "total": pa.nulls(n, pa.int64()),
            "beam": pa.nulls(n, pa.int32()), "recall": pa.nulls(n, pa.float64()), "root": pa.array(rows["root"], pa.int64()),
        }).to_batches()

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _grouped(batches)
        step = next(pieces, None)
        while step is not None:
            (key, block, _, _), table = step

            def graphs():
                nonlocal step
                while (step := next(pieces, None)) is not None and step[0][:2] == (key, block):
                    yield step[1]

            yield from visited(table, graphs())

    return partition


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows of one block and graph, each as one table."""
    names, held, key = ("label_key", "block", "is_graph", "shard"), [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(n) for n in names]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in codes:
            change |= np.asarray(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[a].as_py() for c in codes)
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def entries(rows: DataFrame, key: str, vector: str, label: str, shard_rows: int) -> DataFrame:
    """(label_key, vector, rep, weight, shards, shard): distinct vectors of each label and
    length, dealt to shards."""
    v = F.col(vector).cast("array<double>")
    good = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.concat_ws("#", F.size(v).cast("string"), F.col(label).cast("string")).alias("label_key"), v.alias("vector")).filter(usable(F.col("vector")))
    once = good.groupBy("label_key", "vector").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("weight"))
    sizes = once.groupBy("label_key").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = once.join(sizes, "label_key")
    return dealt.withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(12)), F.col("shards")).cast("int"))


def links(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.95, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """Two tables of distinct vectors: (label_key, vector, rep, total, beam, recall) with
    the number of rows that each links with, and the edges (a, b) of their ids, stars a
    block and graph. ``beam`` and ``recall`` say what the audits ended with."""
    if not 0 < threshold < 1 or not 0 < recall <= 1 or shard_rows < 1:
        raise ValueError("0 < threshold < 1, 0 < recall <= 1, shard_rows >= 1")
    half = math.cos(math.acos(threshold) / 2) + 1e-12
    built = entries(rows, key, vector, label, shard_rows).groupBy("label_key", "shard").applyInArrow(lambda t: _built(t, half), "label_key string, shards int, " + _NODES)
    nodes = shared.cut(built, "graphs")
    blocks = nodes.withColumn("near", F.array().cast("array<int>")).withColumn("block", F.col("shard")).withColumn("is_graph", F.lit(False))
    graphs = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("is_graph", F.lit(True))
    dealt = blocks.unionByName(graphs).repartition("label_key", "block").sortWithinPartitions("label_key", "block", "is_graph", "shard")
    found = shared.cut(dealt.mapInArrow(_visits(threshold, recall, beam), _FOUND), "links")
    shared.discard(nodes)
    counts = found.filter("root is null").drop("root")
    return counts, found.filter("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def dedup(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.95, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """rows with n_links, component_id and kept (the row's id is its component's), and the
    ``audit_beam`` and ``audit_recall`` of its block, null for rows that aren't compared."""
    added = (*RESULTS, "audit_beam", "audit_recall")
    counts, edges = links(rows, key, vector, label, threshold, recall, shard_rows, beam)
    named = counts.join(graph.components(edges).withColumnRenamed("node", "rep"), "rep", "left").select(F.col("label_key").alias("_label"), F.col("vector").alias("_vector"), *[F.col(c).alias(f"_{c}") for c in ("total", "rep", "component", "beam", "recall")])
    kept = [c for c in rows.columns if c not in added]
    v = F.col(vector).cast("array<double>")
    compared = F.when(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(v), F.concat_ws("#", F.size(v).cast("string"), F.col(label).cast("string")))
    marked = rows.select(*kept, compared.alias("_label"), F.when(compared.isNotNull(), v).alias("_vector"))
    joined = marked.join(named, ["_label", "_vector"], "left")
    component = F.coalesce("_component", "_rep", F.col(key).cast("long"))
    return joined.select(*kept, F.coalesce("_total", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"), F.col("_beam").alias("audit_beam"), F.col("_recall").alias("audit_recall"))
