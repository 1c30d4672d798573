"""Exact small problems on the driver. Their inputs are bounded by the caller; larger ones are refused."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Sequence
from itertools import combinations
from typing import TypeVar

X = TypeVar("X")


def largest_matching(options: dict[str, Iterable[str]], limit: int = 1_000_000) -> dict[str, str]:
    """A largest set of pairs (left, right) such that nobody is used twice, from what each left accepts: an upper bound for any greedy pass.

    Shortest augmenting paths are taken in phases; what is left after a phase needs longer ones.
    """
    accepts = {k: sorted(set(v)) for k, v in sorted(options.items())}
    if sum(map(len, accepts.values())) > limit:
        raise ValueError(f"more than {limit} options")
    left: dict[str, str] = {}
    right: dict[str, str] = {}
    while True:
        depth = {k: 0 for k in accepts if k not in left}
        queue, reached = deque(depth), False
        while queue:
            k = queue.popleft()
            for r in accepts[k]:
                owner = right.get(r)
                if owner is None:
                    reached = True
                elif owner not in depth:
                    depth[owner] = depth[k] + 1
                    queue.append(owner)
        if not reached:
            return left
        for start in [k for k in accepts if k not in left]:
            path: list[tuple[str, int]] = [(start, 0)]
            while path:
                k, i = path.pop()
                if i >= len(accepts[k]):
                    depth.pop(k, None)
                    continue
                path.append((k, i + 1))
                owner = right.get(accepts[k][i])
                if owner is None:
                    for node, at in reversed(path):
                        left[node], right[accepts[node][at - 1]] = accepts[node][at - 1], node
                    break
                if depth.get(owner, -1) == depth.get(k, -9) + 1:
                    path.append((owner, 0))


def best_subset(items: Sequence[X], most: int, value: Callable[[tuple[X, ...]], float], limit: int = 20) -> tuple[X, ...]:
    """The subset of at most ``most`` items of highest value, by trying all; the first in order of size and position if several are equal."""
    if len(items) > limit:
        raise ValueError(f"{len(items)} items, at most {limit}")
    subsets = (c for n in range(min(most, len(items)) + 1) for c in combinations(items, n))
    return max(subsets, key=value)
