"""Graphs of bounded size inside one task: rooted forests, bridges and articulation points by depth-first low points.

Nodes are numbered in the order of their names and every figure is four bytes in an array, not an object: a task holds about 60 bytes an
edge besides the names.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kgloom.operators.unionfind import coded, joining, roots

#: Rows of a batch that is handed on.
_ROWS = 50_000


def _array(x: np.ndarray) -> array:
    a = array("i")
    a.frombytes(np.ascontiguousarray(x, dtype=np.int32).data.cast("B"))
    return a


def _numpy(x: array) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int32)


class _Graph:
    """Adjacency of the undirected edges of a partition (first two columns, simple), neighbours in ascending order."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        got = [b for b in batches if b.num_rows]
        self.n = 0
        if not got:
            return
        nodes, u, v = coded(*(pa.chunked_array([b.column(i) for b in got]) for i in (0, 1)))
        del got
        self.fill(nodes, u, v)

    def fill(self, nodes: pa.Array, u: np.ndarray, v: np.ndarray) -> None:
        self.nodes, self.n = nodes, len(nodes)
        n = self.n
        # both directions, in order of (from, to)
        arcs = np.concatenate([u, v]).astype(np.int64)
        arcs *= n
        arcs[: len(u)] += v
        arcs[len(u) :] += u
        arcs.sort()
        self.first = _array(np.searchsorted(arcs, np.arange(n + 1, dtype=np.int64) * n))
        arcs %= n
        self.to = _array(arcs)


class _Walk:
    """Places in a walk of all trees one after the other, with parents (-1 at a root) and sizes of subtrees, by node."""

    def __init__(self, place: array, parent: array, size: array):
        self.place, self.parent, self.size = _numpy(place), _numpy(parent), _numpy(size)
        self.starts = np.sort(self.place[self.parent < 0])

    def order(self) -> np.ndarray:
        """The nodes by place."""
        order = np.empty(len(self.place), dtype=np.int32)
        order[self.place] = np.arange(len(order), dtype=np.int32)
        return order

    def tree(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place where the tree of each node starts, nodes of that tree)."""
        at = np.searchsorted(self.starts, self.place[nodes], side="right") - 1
        return self.starts[at], np.diff(np.append(self.starts, len(self.place)))[at]


def _rows(n: int, make) -> Iterator[pa.RecordBatch]:
    for s in range(0, n, _ROWS):
        columns = make(slice(s, min(s + _ROWS, n)))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def rooted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, parent, root, pre, size) of a forest: each tree is walked depth first from its smallest node, at every node on from the neighbour
    that follows the parent in order of the names, round and round; ``pre`` counts from 0, ``size`` is that of the subtree."""
    g = _Graph(batches)
    if not g.n:
        return
    to, first = g.to, g.first
    place, parent, size = array("i", [-1]) * g.n, array("i", [-1]) * g.n, array("i", [1]) * g.n
    at = first[: g.n]
    seen = 0
    for start in range(g.n):
        if place[start] >= 0:
            continue
        place[start] = seen
        seen += 1
        v, p = start, -1
        while True:
            i = at[v]
            if i == first[v + 1]:
                # round to the first neighbour; a root has seen all by now
                w = p if p < 0 else to[i := first[v]]
            else:
                w = to[i]
            if w != p:
                at[v] = i + 1
                place[w] = seen
                seen += 1
                parent[w] = p = v
                v = w
                at[v] = bisect_left(to, p, first[v], first[v + 1]) + 1
            elif p < 0:
                break
            else:
                size[p] += size[v]
                v, p = p, parent[p]
    walk = _Walk(place, parent, size)
    order = walk.order()

    def make(s: slice) -> dict:
        v = order[s]
        begin, _ = walk.tree(v)
        up = walk.parent[v]
        return {
            "node": g.nodes.take(pa.array(v)),
            "parent": g.nodes.take(pa.array(up, mask=up < 0)),
            "root": g.nodes.take(pa.array(order[begin])),
            "pre": pa.array((walk.place[v] - begin).astype(np.int64)),
            "size": pa.array(walk.size[v].astype(np.int64)),
        }

    yield from _rows(g.n, make)


def _search(g: _Graph) -> tuple[_Walk, np.ndarray]:
    """(walk, low points) of a depth-first search without recursion."""
    to, first = g.to, g.first
    place, low, parent, size = array("i", [-1]) * g.n, array("i", [0]) * g.n, array("i", [-1]) * g.n, array("i", [1]) * g.n
    at = first[: g.n]
    seen = 0
    for start in range(g.n):
        if place[start] >= 0:
            continue
        place[start] = low[start] = seen
        seen += 1
        v, p = start, -1
        while v >= 0:
            i = at[v]
            if i < first[v + 1]:
                at[v] = i + 1
                w = to[i]
                x = place[w]
                if x < 0:
                    place[w] = low[w] = seen
                    seen += 1
                    parent[w] = p = v
                    v = w
                elif w != p and x < low[v]:
                    low[v] = x
            else:
                if p >= 0:
                    size[p] += size[v]
                    if low[v] < low[p]:
                        low[p] = low[v]
                    v, p = p, parent[p]
                else:
                    break
    return _Walk(place, parent, size), _numpy(low)


def bridge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, side, component_size) of every bridge; ``side`` is the size of the smaller part."""
    g = _Graph(batches)
    if not g.n:
        return
    walk, low = _search(g)
    lower = np.flatnonzero((walk.parent >= 0) & (low == walk.place))

    def make(s: slice) -> dict:
        v = lower[s]
        up, below, (_, whole) = walk.parent[v], walk.size[v], walk.tree(v)
        return {
            "a": g.nodes.take(pa.array(np.minimum(v, up))),
            "b": g.nodes.take(pa.array(np.maximum(v, up))),
            "side": pa.array(np.minimum(below, whole - below).astype(np.int64)),
            "component_size": pa.array(whole.astype(np.int64)),
        }

    yield from _rows(len(lower), make)


def _blocks(g: _Graph) -> np.ndarray:
    """Blocks that meet in each node."""
    walk, low = _search(g)
    inner = np.flatnonzero(walk.parent >= 0)
    up = walk.parent[inner]
    begins = (walk.parent[up] < 0) | (low[inner] >= walk.place[up])
    return np.bincount(up[begins], minlength=g.n) + (walk.parent >= 0)


def articulation_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, blocks) of every node in which several blocks meet."""
    g = _Graph(batches)
    if not g.n:
        return
    blocks = _blocks(g)
    found = np.flatnonzero(blocks > 1)
    yield from _rows(len(found), lambda s: {"node": g.nodes.take(pa.array(found[s])), "blocks": pa.array(blocks[found[s]].astype(np.int64))})


#: Neighbours that are looked up at once.
_PROBES = 2_000_000


def _common(g: _Graph, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Common neighbours of each pair; those of the end that has fewer are looked up at the other."""
    first, to = _numpy(g.first), _numpy(g.to)
    degree = np.diff(first)
    arcs = np.repeat(np.arange(g.n, dtype=np.int64) * g.n, degree)
    arcs += to
    swap = degree[u] > degree[v]
    few, other = np.where(swap, v, u), np.where(swap, u, v)
    upto = np.concatenate([[0], np.cumsum(degree[few], dtype=np.int64)])
    found = np.zeros(len(u), dtype=np.int64)
    s = 0
    while s < len(u):
        e = max(s + 1, int(np.searchsorted(upto, upto[s] + _PROBES, side="right")) - 1)
        n = degree[few[s:e]]
        pair = np.repeat(np.arange(e - s), n)
        i = np.arange(len(pair)) + (first[few[s:e]] - (upto[s:e] - upto[s]))[pair]
        want = other[s:e].astype(np.int64)[pair] * g.n + to[i]
        at = np.searchsorted(arcs, want)
        hit = arcs[np.minimum(at, len(arcs) - 1)] == want
        found[s:e] = np.bincount(pair[hit], minlength=e - s)
        s = e
    return found


def removal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the distinct pairs (a, b, n, mine, rest; a = b is a self-loop) that is ``mine``: n, the parts (_a, _b) that the pairs of
    the ``rest`` put its ends into, whether the first triple between these parts has to stay, so that no component is parted and no entity
    lost if all others that are only mine go, and of the graph of all pairs: common neighbours, degrees, whether an end is an articulation point."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    nodes, u, v = coded(*(pa.chunked_array([b.column(i) for b in got]) for i in (0, 1)))
    count, mine, rest = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in (2, 3, 4))
    del got
    n, loop = len(nodes), u == v
    held = np.zeros(n, dtype=bool)
    held[u[rest]] = held[v[rest]] = True
    part = roots(u[rest & ~loop], v[rest & ~loop], n)
    g = _Graph(iter(()))
    g.fill(nodes, u[~loop], v[~loop])
    degree = np.diff(_numpy(g.first)).astype(np.int64)
    degree[u[loop]] += 2
    u, v, count, loop = u[mine], v[mine], count[mine], loop[mine]
    x, y = np.minimum(part[u], part[v]), np.maximum(part[u], part[v])
    apart = x != y
    pairs = x.astype(np.int64) * n + y
    tree = [*joining(np.unique(pairs[apart]), n)]
    linked = np.zeros(n, dtype=bool)
    linked[x[apart]] = linked[y[apart]] = True
    # an entity that no other triple holds keeps its first self-loop
    stays = np.isin(pairs, np.concatenate(tree)) if tree else np.zeros(len(u), dtype=bool)
    stays |= ~apart & ~linked[x] & ~held[x]
    cutting = _blocks(g) > 1
    common = np.zeros(len(u), dtype=np.int64)
    common[~loop] = _common(g, u[~loop], v[~loop])
    name = lambda c: nodes.take(pa.array(c))

    def make(s: slice) -> dict:
        a, b = u[s], v[s]
        return {
            "a": name(a), "b": name(b), "n": pa.array(count[s]), "_a": name(x[s]), "_b": name(y[s]), "_stays": pa.array(stays[s]), "common": pa.array(common[s]),
            "_dh": pa.array(degree[a]), "_dt": pa.array(degree[b]), "_ah": pa.array(cutting[a]), "_at": pa.array(cutting[b]),
        }

    yield from _rows(len(u), make)
