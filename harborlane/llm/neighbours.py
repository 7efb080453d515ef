"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Each shard's index is a hierarchy of graphs over its different vectors, kept as flat arrays of
neighbour numbers. Level 0 holds all of them, each higher level about one in ``LINKS``. Nodes are put
in one after the other in a random order that is fixed by a seed: a node links to nodes before it
whose directions are near its own and not nearer to another node it links to, so early nodes give the
long links. Links go both ways, and a node with too many keeps a spread choice. On level 0 a node also
links to the ``PRODUCTS`` nodes with the largest inner products with it, wherever they point: where
lengths differ, those are what a search is for, and directions alone would not lead there.

A query goes down the levels greedily and searches level 0 with a beam, both by the inner product; the
best of all shards are merged. After a shard is built, some of its rows are searched for in it and
compared with brute force, and its beam is widened from ``BEAM`` until ``ENOUGH`` of their nearest are
found. A query that reaches fewer nodes than it asks for has the whole shard looked through.

The links, the way and the choice are in double precision, since near copies differ by less than single
precision tells. Where squares could leave the range of doubles, vectors are scaled by powers of two on
the way. Scores are inner products of the original vectors, sums of rounded products without further
rounding; a score beyond the largest double is infinite, and equal to others that are. Only which rows
are found is approximate.

Vectors that are null, empty, all zero, or hold nulls or non-finite numbers take no part, nor do rows
with a null id; vectors only meet vectors of their length. Equal vectors are one node with many ids,
so a crowd of copies leaves the graph as it is. A query's own id is left out; equal scores go to the
smaller id; repeated rows are candidates, and queries, of their own. Fewer candidates than asked for
give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from harborlane.llm.common import stored
from harborlane.llm.vectors import build, meet, parts_of, usable

LINKS, PRODUCTS, CANDIDATES, BEAM, UPPER_BEAM, AT_ONCE = 16, 16, 64, 128, 8, 4
ROWS_PER_SHARD, QUERIES_AT_ONCE = 16_384, 512
#: Rows searched for to choose a shard's beam, the part of their nearest to be found, and the widest.
SAMPLE, ENOUGH, WIDEST = 32, 0.95, 2048
SEED = 11
_BLOCK, _EDGES = 256, 4096


def spread_choice(points: np.ndarray, owners: np.ndarray, options: np.ndarray, most: int):
    """For each owner, of its ``options`` (nearest first, -1 for none) up to ``most`` that are nearer
    to it than to any option chosen before; then the nearest others, if there is room."""
    chosen = np.full((len(owners), most), -1, np.int32)
    for first in range(0, len(owners), _BLOCK):
        own, some = owners[first : first + _BLOCK], options[first : first + _BLOCK]
        there = some >= 0
        near = points[np.maximum(some, 0)]
        to_owner = np.einsum("bcd,bd->bc", near, points[own])
        between = near @ near.transpose(0, 2, 1)
        closest = np.full(some.shape, -np.inf, points.dtype)
        taken, count = np.zeros(some.shape, bool), np.zeros(len(own), int)
        for c in range(some.shape[1]):
            good = there[:, c] & (closest[:, c] < to_owner[:, c]) & (count < most)
            taken[good, c] = True
            count += good
            closest[good] = np.maximum(closest[good], between[good, c])
        rank = np.where(taken, 0, np.where(there, 1, 2)) * some.shape[1] + np.arange(some.shape[1])
        order = np.argsort(rank, axis=1)[:, :most]
        picked = np.take_along_axis(some, order, axis=1)
        chosen[first : first + _BLOCK, : picked.shape[1]] = picked
    return chosen


def nearest(
    points: np.ndarray, sizes: np.ndarray, count: int, products: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers of the ``count`` rows before it with the nearest directions, and those
    of the ``products`` other rows with the largest inner products; best first, -1 for none.

    ``points`` have length 1; ``sizes`` are the lengths of the vectors they stand for.
    """
    earlier = np.full((len(points), count), -1, np.int32)
    largest = np.full((len(points), products), -1, np.int32)
    for first in range(0, len(points), _BLOCK):
        last = min(first + _BLOCK, len(points))
        near = points[first:last] @ (points if products else points[:last]).T
        rows = np.arange(first, last)[:, None]
        if products:
            value = near * sizes
            value[np.arange(last - first), rows[:, 0]] = -np.inf
            largest[first:last] = _best(value, products)
            near = near[:, :last]
        near[np.arange(last)[None, :] >= rows] = -np.inf
        earlier[first:last] = _best(near, count)
    return earlier, largest


def _best(value: np.ndarray, count: int) -> np.ndarray:
    """The columns with each row's largest finite values, largest first, -1 for none."""
    found = np.full((len(value), count), -1, np.int32)
    width = min(count, value.shape[1])
    best = np.argpartition(-value, width - 1, axis=1)[:, :width]
    own = np.take_along_axis(value, best, axis=1)
    order = np.argsort(-own, axis=1, kind="stable")
    best, own = np.take_along_axis(best, order, 1), np.take_along_axis(own, order, 1)
    found[:, :width] = np.where(np.isfinite(own), best, -1)
    return found


def graph(points: np.ndarray, sizes: np.ndarray, links: int, products: int) -> np.ndarray:
    """The neighbours of each row: up to ``2 * links`` by direction and ``products`` by inner product,
    -1 where there are fewer."""
    everyone = np.arange(len(points))
    earlier, largest = nearest(points, sizes, CANDIDATES, products)
    forward = spread_choice(points, everyone, earlier, links)
    sources = np.repeat(everyone, links)[forward.ravel() >= 0]
    goals = forward.ravel()[forward.ravel() >= 0]
    value = np.empty(len(sources), points.dtype)
    for first in range(0, len(sources), _EDGES):
        some = slice(first, first + _EDGES)
        value[some] = np.einsum("ij,ij->i", points[sources[some]], points[goals[some]])
    a, b = np.concatenate([sources, goals]), np.concatenate([goals, sources])
    value = np.concatenate([value, value])
    order = np.lexsort((-value, a))
    a, b = a[order], b[order]
    edges = np.searchsorted(a, np.arange(len(points) + 1))
    place = np.arange(len(a)) - edges[a]
    # A node that very many link to chooses among the nearest of them.
    kept = place < 8 * links
    options = np.full((len(points), int(place[kept].max(initial=0)) + 1), -1, np.int32)
    options[a[kept], place[kept]] = b[kept]
    crowded = np.flatnonzero((options >= 0).sum(axis=1) > 2 * links)
    result = np.full((len(points), 2 * links), -1, np.int32)
    width = min(options.shape[1], 2 * links)
    result[:, :width] = options[:, :width]
    if len(crowded):
        result[crowded] = spread_choice(points, crowded, options[crowded], 2 * links)
    return np.hstack([result, largest])


def scaled(matrix: np.ndarray) -> tuple[np.ndarray, int]:
    """The matrix times a power of two that keeps squares in the range of doubles, and its exponent;
    the matrix itself if it needs none."""
    exponent = int(np.frexp(np.abs(matrix).max(initial=0.0))[1])
    if -400 < exponent < 400:
        return matrix, 0
    return np.ldexp(matrix, -exponent), -exponent


def graph_index(ids: np.ndarray, matrix: np.ndarray, top: int = 20) -> dict:
    points, node = np.unique(matrix, axis=0, return_inverse=True)
    random = np.random.default_rng(SEED)
    order = random.permutation(len(points))
    points, number = points[order], np.empty(len(order), int)
    number[order] = np.arange(len(order))
    node = number[node.ravel()]
    by_node = np.lexsort((ids, node))
    starts = np.searchsorted(node[by_node], np.arange(len(points) + 1))
    directions = points / np.abs(points).max(axis=1, keepdims=True)
    directions /= np.sqrt((directions * directions).sum(axis=1, keepdims=True))
    sizes = np.sqrt(np.square(scaled(points)[0]).sum(axis=1))
    height = -np.log(1.0 - random.random(len(points))) / math.log(LINKS)
    members, arrays, level = [], [], 0
    while True:
        some = np.flatnonzero(height >= level)
        if level and len(some) < 2:
            break
        made = graph(directions[some], sizes[some], LINKS, 0 if level else PRODUCTS)
        members.append(some.astype("<i4").tobytes())
        arrays.append(made.astype("<i4").tobytes())
        level += 1
    made = {
        "ids": ids[by_node].astype("<i8").tobytes(),
        "starts": starts.astype("<i8").tobytes(),
        "points": points.astype("<f8").tobytes(),
        "members": members,
        "links": arrays,
    }
    return made | {"beam": chosen_beam(made, points, top)}


def chosen_beam(made: dict, points: np.ndarray, top: int) -> int:
    """The first of ``BEAM`` and its doubles with which enough of a sample's nearest are found."""
    own, _ = scaled(points)
    rows = np.linspace(0, len(own) - 1, min(SAMPLE, len(own))).astype(int)
    queries = np.stack([scaled(points[row])[0] for row in rows])
    best = _best(queries @ own.T, min(top, len(own)))
    beam = max(BEAM, top + 1)
    while beam < min(WIDEST, len(own)):
        found = walk(made, own, queries, beam)
        hits = sum(len(set(a.tolist()) & set(b[b >= 0].tolist())) for a, b in zip(found, best))
        if hits >= ENOUGH * (best >= 0).sum():
            break
        beam *= 2
    return beam


def beam_search(
    points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, values) of the best found for each query, best first; -1 and -inf for none.

    All queries step together; in a step each looks at the neighbours of its ``AT_ONCE`` best nodes
    that it has not been to, and is done when its beam has none left.
    """
    total, width = len(queries), entry.shape[1]
    seen = np.zeros((total, len(points)), bool)
    nodes = np.full((total, beam), -1, np.int64)
    values = np.full((total, beam), -np.inf, points.dtype)
    rows = np.arange(total)[:, None]
    nodes[:, :width] = entry
    start = np.einsum("bcd,bd->bc", points[np.maximum(entry, 0)], queries)
    values[:, :width] = np.where(entry >= 0, start, -np.inf)
    seen[rows, np.maximum(entry, 0)] |= entry >= 0
    done = nodes < 0
    active = np.arange(total)
    while len(active):
        open_ = ~done[active]
        at = np.argsort(~open_, axis=1, kind="stable")[:, :AT_ONCE]
        usable = np.take_along_axis(open_, at, axis=1)
        done[active[:, None], at] = True
        around = links[np.maximum(nodes[active[:, None], at], 0)]
        around = around.reshape(len(active), -1)
        new = (around >= 0) & usable.repeat(links.shape[1], axis=1)
        new &= ~seen[active[:, None], np.maximum(around, 0)]
        query, column = np.nonzero(new)
        pairs = np.sort(query * len(points) + around[query, column])
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        query, node = np.divmod(pairs, len(points))
        seen[active[query], node] = True
        value = np.einsum("ij,ij->i", points[node], queries[active[query]])
        place = np.arange(len(query)) - np.searchsorted(query, np.arange(len(active)))[query]
        wide = beam + int(place.max(initial=-1)) + 1
        all_nodes = np.full((len(active), wide), -1, np.int64)
        all_values = np.full((len(active), wide), -np.inf, points.dtype)
        all_done = np.ones((len(active), wide), bool)
        all_nodes[:, :beam], all_values[:, :beam] = nodes[active], values[active]
        all_done[:, :beam] = done[active]
        all_nodes[query, beam + place], all_values[query, beam + place] = node, value
        all_done[query, beam + place] = False
        best = np.argsort(-all_values, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, best, axis=1)
        values[active] = np.take_along_axis(all_values, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1)
        active = active[~done[active].all(axis=1)]
    return nodes, values


def walk(row: dict, points: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """The nodes found for each query, best first, -1 for none."""
    entry = np.zeros((len(queries), 1), np.int64)
    for level in range(len(row["members"]) - 1, -1, -1):
        members = np.frombuffer(row["members"][level], "<i4").astype(np.int64)
        links = np.frombuffer(row["links"][level], "<i4").reshape(len(members), -1)
        here = np.searchsorted(members, np.maximum(entry, 0))
        here = np.where(entry >= 0, here, -1)
        if level == len(row["members"]) - 1:
            here = np.zeros((len(queries), 1), np.int64)
        there = points[members] if level else points
        found, _ = beam_search(there, links, queries, here, UPPER_BEAM if level else beam)
        entry = np.where(found >= 0, members[np.maximum(found, 0)], -1)
    return entry


def search_shard(row: dict, query_ids: np.ndarray, queries: np.ndarray, top: int, beam: int = 0):
    """Positions of the queries, ids and exact scores of what the shard's graph finds."""
    points = np.frombuffer(row["points"], "<f8").reshape(-1, row["dim"])
    own, _ = scaled(points)
    at, hits, scores = [], [], []
    for first in range(0, len(queries), QUERIES_AT_ONCE):
        some = np.stack([scaled(query)[0] for query in queries[first : first + QUERIES_AT_ONCE]])
        found = walk(row, own, some, max(beam or row["beam"], top + 1))
        for position, nodes in enumerate(found, first):
            best = _scored(row, points, queries[position], query_ids[position], nodes[nodes >= 0], top)
            at += [position] * len(best)
            hits += [i for _, i in best]
            scores += [-s for s, _ in best]
    return np.array(at, int), np.array(hits, np.int64), np.array(scores, float)


def _scored(
    row: dict, points: np.ndarray, query: np.ndarray, own: int, nodes: np.ndarray, top: int
) -> list[tuple[float, int]]:
    """(-score, id) of the best ids of some nodes; of all nodes, if those are too few."""
    ids, starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
    with np.errstate(over="ignore", invalid="ignore"):
        products = points[nodes] * query
        sums = products.sum(axis=1)
        # The sums are off by at most this; no node is left out that might be one of the best.
        off = query.size * np.finfo(float).eps * np.abs(products).sum(axis=1).max(initial=0.0)
    if not np.isfinite(off):  # beyond doubles on the way: none is left out
        sums, off = np.zeros(len(nodes)), 0.0
    best, least = [], -np.inf
    for place in np.argsort(-sums, kind="stable").tolist():
        if sums[place] < least:
            break
        node = nodes[place]
        others = _others(ids, starts[node], starts[node + 1], own, top)
        if len(others):
            score = inner_product(products[place], points[node], query)
            best += [(-score, i) for i in others]
            if len(best) >= top and least == -np.inf:
                least = sums[place] - 2 * off
    if len(best) < top and len(nodes) < len(points):
        return _scored(row, points, query, own, np.arange(len(points)), top)
    return sorted(best)[:top]


def inner_product(products: np.ndarray, point: np.ndarray, query: np.ndarray) -> float:
    try:
        return math.fsum(products.tolist())
    except (OverflowError, ValueError):  # of infinite products, or a sum beyond doubles
        (a, up), (b, more) = scaled(point), scaled(query)
        try:
            return math.ldexp(math.fsum((a * b).tolist()), -up - more)
        except OverflowError:
            return math.copysign(math.inf, math.fsum((a * b).tolist()))


def _others(ids: np.ndarray, first: int, last: int, own: int, top: int) -> list[int]:
    """The ``top`` smallest ids of a node, without the query's own."""
    found = []
    while first < last and len(found) < top:
        some = ids[first : min(last, first + 2 * top)]
        found += some[some != own].tolist()
        first += 2 * top
    return found[:top]


def graph_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, int]:
    """The index of all vectors, written to the shared folder, and its number of shards."""
    rows = usable(vectors, vec_id, vector).where(F.exists("vector", lambda x: x != 0))
    shards = parts_of(rows.count(), ROWS_PER_SHARD)
    index = build(
        rows, shards, graph_index,
        "ids binary, starts binary, points binary, members array<binary>, links array<binary>, beam bigint",
    )
    return stored(index, "graph-index"), shards


def search(
    vectors: DataFrame,
    is_query: Column,
    top: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    beam: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows with ``is_query``, a condition on ``vec_id``.

    ``beam`` takes the place of each shard's own.
    """
    index, shards = graph_vectors(vectors, vec_id, vector)
    queries = (
        usable(vectors, vec_id, vector)
        .where(F.exists("vector", lambda x: x != 0))
        .where(is_query)
    )
    return meet(
        index, queries, shards,
        lambda row, ids, matrix: search_shard(row, ids, matrix, top, beam), top, "double",
    )
