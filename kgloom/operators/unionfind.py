"""Union-find inside one partition of edges: components and forests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Edges that one task may hold as objects, or as rows of several columns.
BOUND = 500_000
#: Edges, and bytes of the names at their ends, that one task may hold if it keeps them as arrays.
LEAN, LEAN_BYTES = 8_000_000, 300_000_000


def coded(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(names in order, place of each value of ``a`` among them, the same for ``b``)."""
    # all chunks get one dictionary
    both = pa.chunked_array([*a.chunks, *b.chunks]).dictionary_encode()
    names = both.chunk(0).dictionary
    order = pc.array_sort_indices(names)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    place = rank[np.concatenate([c.indices.to_numpy() for c in both.chunks])]
    return names.take(order), place[: len(a)], place[len(a) :]


def roots(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` numbered nodes the smallest one that the edges link it to."""
    parent = array("i")
    parent.frombytes(np.arange(n, dtype=np.int32).data.cast("B"))
    for s in range(0, len(first), 50_000):
        for x, y in zip(first[s : s + 50_000].tolist(), second[s : s + 50_000].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y
    root = np.frombuffer(parent, dtype=np.int32)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def joining(edges: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Of edges a·n + b of ``n`` numbered nodes those that join two parts when all come in the given order, in pieces."""
    parent = array("i")
    parent.frombytes(np.arange(n, dtype=np.int32).data.cast("B"))
    for s in range(0, len(edges), 50_000):
        keep = []
        for e in edges[s : s + 50_000].tolist():
            x, y = divmod(e, n)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(e)
        if keep:
            yield np.array(keep, dtype=np.int64)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (node, root) for each node of the edges (first two columns), root being the smallest node it is linked to in this partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    nodes, first, second = coded(*(pa.chunked_array([b.column(i) for b in got]) for i in (0, 1)))
    del got
    root = roots(first, second, len(nodes))
    for s in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([nodes.slice(s, 50_000), nodes.take(pa.array(root[s : s + 50_000]))], names=["node", "root"])


def first_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of simple edges (a, b) those that join two parts when all come in order, by arrays."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    nodes, first, second = coded(*(pa.chunked_array([b.column(i) for b in got]) for i in (0, 1)))
    del got
    n = len(nodes)
    edges = first.astype(np.int64) * n + second
    edges.sort()
    for keep in joining(edges, n):
        a, b = np.divmod(keep, n)
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (u, v, a, b) those that join two parts when the edges come in order of (a, b): the rest closes cycles."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    t = t.take(pc.sort_indices(t, sort_keys=[("a", "ascending"), ("b", "ascending")]))
    nodes, first, second = coded(t.column("u"), t.column("v"))
    parent = list(range(len(nodes)))
    keep = np.zeros(t.num_rows, dtype=bool)
    for i, (x, y) in enumerate(zip(first.tolist(), second.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    yield from t.filter(pa.array(keep)).to_batches(max_chunksize=50_000)
