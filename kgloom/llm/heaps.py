"""Bounded best-of lists as Arrow streams: the pieces that capping and top-N share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _codes(batch: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row, equal for equal keys, NULLs equal to each other."""
    out = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        col = batch.column(k)
        enc = pc.dictionary_encode(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, null_encoding="encode")
        enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
        out = out * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, out = np.unique(out, return_inverse=True)
    return out


def keep_best(table: pa.Table, keys: Sequence[str], cap: str, score: str, ident: str) -> pa.Table:
    """Per key the ``cap`` best rows: highest score first, NULL and NaN last, ties by smaller identifier; repeats of an identifier count once."""
    if table.num_rows == 0:
        return table
    code = _codes(table, keys)
    s = table.column(score).to_numpy(zero_copy_only=False).astype(np.float64)
    i = table.column(ident).to_numpy(zero_copy_only=False)
    order = np.lexsort((i, -s, np.isnan(s), code))
    code, i = code[order], i[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (i[1:] != i[:-1])
    order, code = order[fresh], code[fresh]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    caps = table.column(cap).to_numpy(zero_copy_only=False)[order]
    return table.take(pa.array(order[rank < caps]))


def heap_stream(keys: Sequence[str], cap: str, score: str, ident: str, hold: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold a partition into one bounded list per key. What is held is cut back to the best whenever ``hold`` rows have come in; lists that
    together outgrow ``hold`` are handed on early, which loses nothing since lists merge in any grouping."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n >= hold:
                best = keep_best(pa.concat_tables(held).combine_chunks(), keys, cap, score, ident)
                if best.num_rows > hold // 2:
                    yield from best.to_batches(max_chunksize=20_000)
                    held, n = [], 0
                else:
                    held, n = [best], best.num_rows
        if held:
            yield from keep_best(pa.concat_tables(held).combine_chunks(), keys, cap, score, ident).to_batches(max_chunksize=20_000)

    return fold


def place_stream(keys: Sequence[str], cap: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a partition sorted by ``keys`` hand on the row of each key at place ``cap`` (the same in all rows of a key), if it has one. Only the
    running key and its count are remembered between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        count = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            code = _codes(pa.Table.from_batches([b]), keys)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)])) + 1
            ends = [tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys) for i in (0, b.num_rows - 1)]
            if ends[0] == last:
                place[: starts[1] if len(starts) > 1 else len(code)] += count
            last, count = ends[1], int(place[-1])
            out = b.filter(pa.array(place == b.column(b.schema.get_field_index(cap)).to_numpy(zero_copy_only=False)))
            if out.num_rows:
                yield out

    return run


def first_n_stream(group: str, n: int, rank: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a partition sorted by ``group`` hand on the first ``n`` rows of each group, with their place from 1 if ``rank`` names a column.

    Only the running group and its count are remembered between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)])) + 1
            if g[0] == last:
                end = starts[1] if len(starts) > 1 else len(g)
                place[:end] += count
            last, count = g[-1], int(place[-1])
            keep = place <= n
            out = b.filter(pa.array(keep))
            if rank:
                out = out.append_column(rank, pa.array(place[keep], pa.int64()))
            if out.num_rows:
                yield out

    return run
