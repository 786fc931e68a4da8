"""A hierarchical navigable small world over the unit vectors of one shard, in numpy.

Nodes are sorted by their drawn level, so the nodes of a level are a prefix of the next
one and every level is one table of neighbours. Searches and insertions run for a batch
of vectors at once; a batch is also compared with itself, so that its members find each
other. Neighbours are chosen nearest first among those that no chosen one is nearer to,
and filled up with the nearest of the rest.

Vectors within ``ball`` of a node are not nodes themselves: they are kept as members of
that node's ball. A group of near copies thus is a node or a few, however many it holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Vectors searched for or inserted together.
SEARCHED, INSERTED = 512, 256
#: Beam places whose neighbours are read in one step.
AT_ONCE = 4
NEVER = np.float32(-2)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; tiny and huge components neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def levels(keys: np.ndarray, degree: int) -> np.ndarray:
    """A level for each 64-bit key, geometric with ratio 1 / degree."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((x ^ (x >> np.uint64(31))).astype(np.float64) + 1) / 2.0**64
    return np.minimum(np.floor(-np.log(share) / np.log(degree)), 12).astype(np.int64)


def search_layer(nodes: np.ndarray, table: np.ndarray, asked: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities), best first, of the ``beam`` best nodes found for each of the
    asked vectors from its entries; -1 where there are fewer."""
    count, many = len(asked), len(table)
    seen = np.zeros((count, many), bool)
    stamp = np.zeros((count, many), np.int32)
    ids = np.full((count, beam), -1, np.int32)
    sims = np.full((count, beam), NEVER, np.float32)
    open_ = np.zeros((count, beam), bool)

    def take(rows: np.ndarray, near: np.ndarray) -> None:
        """Score unseen nodes (a line for each row) and keep the best in the beam."""
        at = np.broadcast_to(rows[:, None], near.shape)
        fresh = near >= 0
        fresh[fresh] = ~seen[at[fresh], near[fresh]]
        r, n = at[fresh], near[fresh]
        order = np.arange(len(r), dtype=np.int32)
        stamp[r, n] = order
        once = stamp[r, n] == order
        fresh[fresh] = once
        r, n = r[once], n[once]
        seen[r, n] = True
        got = np.full(near.shape, NEVER, np.float32)
        got[fresh] = np.einsum("ij,ij->i", nodes[n], asked[r])
        every = np.concatenate([sims[rows], got], axis=1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        sims[rows] = np.take_along_axis(every, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, near, -1).astype(np.int32)], axis=1), best, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], axis=1), best, 1)

    take(np.arange(count), entries)
    width = min(AT_ONCE, beam)
    while len(rows := np.flatnonzero(open_.any(axis=1))):
        key = np.where(open_[rows], sims[rows], NEVER)
        chosen = np.argpartition(-key, width - 1, axis=1)[:, :width]
        places = np.where(np.take_along_axis(open_[rows], chosen, 1), np.take_along_axis(ids[rows], chosen, 1), -1)
        open_[rows[:, None], chosen] = False
        near = np.where(places[:, :, None] >= 0, table[places], -1).reshape(len(rows), -1)
        take(rows, near)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def chosen(nodes: np.ndarray, places: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each line's places (best first, -1 for none): those to which no
    chosen place is nearer than the line's own vector, then the nearest others."""
    held = nodes[places]
    between = held @ held.transpose(0, 2, 1)
    keep = np.zeros(places.shape, bool)
    for c in range(places.shape[1]):
        nearest = np.where(keep, between[:, c], NEVER).max(axis=1)
        keep[:, c] = (places[:, c] >= 0) & (sims[:, c] > nearest) & (keep.sum(axis=1) < most)
    rank = np.where(places < 0, 2, np.where(keep, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(places, order, 1)


@dataclass
class SmallWorld:
    """Nodes (unit vectors, float32 for walking) and a table of neighbours a level."""

    nodes: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)

    def search(self, asked: np.ndarray, beam: int, down_to: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """What the layers from 0 to ``down_to`` give for a batch; above, one place is kept."""
        found: list = [None] * len(self.tables)
        entries = np.zeros((len(asked), 1), np.int64)
        for layer in range(len(self.tables) - 1, -1, -1):
            table = self.tables[layer]
            if not len(table):
                continue
            found[layer] = search_layer(self.nodes, table, asked, entries, min(beam, len(table)) if layer <= down_to else 1)
            entries = found[layer][0].astype(np.int64)
        return found

    def nearest(self, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and similarities that a beam finds, in batches."""
        if not len(asked):
            return np.zeros((0, 1), np.int32), np.zeros((0, 1), np.float32)
        parts = [self.search(asked[i : i + SEARCHED], beam)[0] for i in range(0, len(asked), SEARCHED)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _linked(nodes: np.ndarray, table: np.ndarray, added: np.ndarray, neighbours: np.ndarray) -> None:
    """Give the neighbours of added nodes the way back; full lines choose anew."""
    degree = table.shape[1]
    table[added, : neighbours.shape[1]] = neighbours
    source = np.repeat(added, neighbours.shape[1])
    target = neighbours.ravel()
    source, target = source[target >= 0], target[target >= 0]
    sim = np.einsum("ij,ij->i", nodes[source], nodes[target])
    order = np.lexsort((-sim, target))
    source, target = source[order], target[order]
    lines, first, n = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, n)
    new = np.full((len(lines), degree), -1, np.int64)
    fits = place < degree
    new[np.repeat(np.arange(len(lines)), n)[fits], place[fits]] = source[fits]
    new[(new[:, :, None] == table[lines][:, None, :]).any(axis=2)] = -1
    both = np.concatenate([table[lines], new], axis=1)
    sims = np.where(both >= 0, np.einsum("ijk,ik->ij", nodes[both], nodes[lines]), NEVER)
    order = np.argsort(-sims, axis=1, kind="stable")
    both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
    over = (both >= 0).sum(axis=1) > degree
    result = both[:, :degree]
    if over.any():
        result[over] = chosen(nodes, both[over], sims[over], degree)
    table[lines] = result


def build(vectors: np.ndarray, level: np.ndarray, ball: float, degree: int = 12, beam: int = 48) -> tuple[SmallWorld, np.ndarray, np.ndarray]:
    """(graph, vector of each node, node of each vector) of unit vectors that are sorted
    by falling level. Vectors whose similarity to a node is ``ball`` or more join it."""
    many, narrow = len(vectors), vectors.astype(np.float32)
    nodes = np.zeros_like(narrow)
    top = int(level[0]) if many else 0
    tables = [np.full((0, degree * (2 if layer == 0 else 1)), -1, np.int64) for layer in range(top + 1)]
    world, made = SmallWorld(nodes[:0], tables), 0
    of_node, node_of = np.zeros(many, np.int64), np.full(many, -1, np.int64)
    cuts = sorted({0, many, *(np.flatnonzero(np.diff(level)) + 1).tolist()})
    batches = [(i, min(i + INSERTED, z)) for a, z in zip(cuts, cuts[1:], strict=False) for i in range(a, z, INSERTED)]
    for a, z in batches:
        asked, here = narrow[a:z], int(level[a])
        found = world.search(asked, beam, here) if made else [None] * len(tables)
        if made:
            near = np.where(found[0][0] >= 0, np.einsum("ijk,ik->ij", vectors[of_node[found[0][0]]], vectors[a:z]), NEVER)
            best = near.argmax(axis=1)
            inside = near[np.arange(z - a), best] >= ball
            node_of[a:z][inside] = found[0][0][np.arange(z - a), best][inside]
        own = vectors[a:z] @ vectors[a:z].T
        fresh: list[int] = []
        for i in range(z - a):
            if node_of[a + i] >= 0:
                continue
            if fresh and own[i, fresh].max() >= ball:
                node_of[a + i] = node_of[a + fresh[int(own[i, fresh].argmax())]]
            else:
                node_of[a + i], of_node[made + len(fresh)] = made + len(fresh), a + i
                fresh.append(i)
        if not fresh:
            continue
        added = np.arange(made, made + len(fresh))
        nodes[added] = asked[fresh]
        world.nodes = nodes[: made + len(fresh)]
        among = own[np.ix_(fresh, fresh)].astype(np.float32)
        np.fill_diagonal(among, NEVER)
        few = min(len(fresh), beam)
        mates = np.argpartition(-among, few - 1, axis=1)[:, :few]
        for layer in range(here + 1):
            tables[layer] = np.concatenate([tables[layer], np.full((len(fresh), tables[layer].shape[1]), -1, np.int64)])
            places, sims = made + mates, np.take_along_axis(among, mates, 1)
            if found[layer] is not None:
                places, sims = np.concatenate([found[layer][0][fresh], places], axis=1), np.concatenate([found[layer][1][fresh], sims], axis=1)
            places = np.where(sims > NEVER, places, -1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            neighbours = chosen(world.nodes, np.take_along_axis(places, order, 1), np.take_along_axis(sims, order, 1), degree)
            _linked(world.nodes, tables[layer], added, neighbours)
        made += len(fresh)
    return SmallWorld(nodes[:made], tables), of_node[:made], node_of
