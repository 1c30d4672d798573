"""Sequential greedy selection inside one task: one triple a turn, with only the scores renewed that the last choice can have changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

if TYPE_CHECKING:
    from kgloom.operators.construct import GreedyWeights

#: Candidates that one task holds, at about 100 bytes each and their entities' names.
CANDIDATES = 1_000_000


def greedy_rows(chosen: list[tuple[str, str, str]], quota: dict[str, int], budget: int, w: GreedyWeights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over one partition (h, r, t, hub_penalty, genericity_score, quality_score, bridge) sorted by (r, h, t), whose relations all have a
    quota: (h, r, t, turn, score) of the triples taken after ``chosen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rel = {r: i for i, r in enumerate(sorted(quota))}
        room = np.array([quota[r] for r in sorted(quota)], float)
        code: dict[str, int] = {}
        got = []
        for b in batches:
            h, r, t = (b.column(i).to_pylist() for i in range(3))
            ids = (np.fromiter((code.setdefault(x, len(code)) for x in col), np.int32, len(col)) for col in (h, t))
            got.append((*ids, np.fromiter((rel[x] for x in r), np.int32, len(r)), *(b.column(i).to_numpy() for i in range(3, 7))))
        if not got:
            return
        head, tail, of, hub, generic, quality, bridge = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        seeds = [(code.setdefault(h, len(code)), rel[r], code.setdefault(t, len(code))) for h, r, t in chosen]
        n, nodes = len(head), len(code)
        ends = np.concatenate([head, tail])
        order = np.argsort(ends, kind="stable")
        at, order = np.searchsorted(ends[order], np.arange(nodes + 1)), (order % n).astype(np.int32)
        block = np.searchsorted(of, np.arange(len(rel) + 1))
        open_, score = np.ones(n, bool), np.full(n, -np.inf)
        taken, degree, part = np.zeros(len(rel)), np.zeros(nodes), np.arange(nodes)
        members: dict[int, list[int]] = {}
        top = 0.0

        def add(h: int, r: int, t: int) -> list[int]:
            """The entities whose rows may score differently now."""
            nonlocal top
            taken[r] += 1
            for e in (h, t):
                degree[e] += 1
                members.setdefault(int(part[e]), [e])
            top = max(top, degree[h], degree[t])
            a, b = sorted((int(part[h]), int(part[t])), key=lambda p: len(members[p]))
            if a == b:
                return [h, t]
            moved = members.pop(a)
            part[moved] = b
            members[b] += moved
            return [h, t, *moved]

        def renew(rows: np.ndarray | slice) -> None:
            h, t, r = head[rows], tail[rows], of[rows]
            dh, dt = degree[h], degree[t]
            both, some = (dh > 0) & (dt > 0), (dh > 0) | (dt > 0)
            s = (
                w.need * (room[r] - taken[r]) / room[r]
                + w.first * (taken[r] == 0)
                + w.attach * np.where(both, 1.0, np.where(some, 0.6, 0.1))
                + w.bridge * bridge[rows]
                + w.merge * (both & (part[h] != part[t]))
                - w.hub * np.maximum(np.minimum(1.0, np.maximum(dh, dt) / max(top, 1.0)), hub[rows])
                - w.generic * generic[rows]
                - w.noise * (1.0 - quality[rows])
            )
            score[rows] = np.where(open_[rows] & (taken[r] < room[r]), np.round(s, 9), -np.inf)

        for h, r, t in seeds:
            add(h, r, t)
            same = np.arange(block[r], block[r + 1])
            open_[same[(head[same] == h) & (tail[same] == t)]] = False
        renew(slice(None))
        out: list[tuple[int, float]] = []
        while len(seeds) + len(out) < budget:
            best = int(np.argmax(score))  # the first of equals is the smallest by (r, h, t)
            if score[best] == -np.inf:
                break
            out.append((best, float(score[best])))
            open_[best] = False
            before, r = top, int(of[best])
            changed = add(int(head[best]), r, int(tail[best]))
            if top != before:
                renew(slice(None))
            else:
                renew(slice(block[r], block[r + 1]))
                renew(np.concatenate([order[at[e] : at[e + 1]] for e in changed]))
        names, kinds = list(code), sorted(quota)
        rows = [x for x, _ in out]
        cols = [[names[head[x]] for x in rows], [kinds[of[x]] for x in rows], [names[tail[x]] for x in rows]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(range(1, len(out) + 1), pa.int32()), pa.array([s for _, s in out], pa.float64())], names=["h", "r", "t", "turn", "score"])

    return run
