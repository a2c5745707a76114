"""Plain Python helpers of jobs: iterables, names, tours."""

from __future__ import annotations

import importlib
import itertools
from collections.abc import Iterable, Iterator
from math import factorial
from typing import Any


def flatten(items: Any) -> Iterator:
    """All leaves of nested lists, tuples and sets."""
    for x in items:
        if isinstance(x, list | tuple | set):
            yield from flatten(x)
        else:
            yield x


def chained(iterables: Iterable[Iterable]) -> list:
    return list(itertools.chain.from_iterable(iterables))


def listed(x: Any) -> list:
    """x itself if it is a list or tuple, else a list of it; of nothing, an empty one."""
    return list(x) if isinstance(x, list | tuple) else [] if x is None else [x]


def is_pair(x: Any) -> bool:
    return isinstance(x, tuple) and len(x) == 2


def as_pair(x: Any) -> tuple:
    return x if is_pair(x) else (x, None)


def key_of(pair: tuple) -> Any:
    return pair[0]


def runs(pairs: Iterable[tuple]) -> Iterator[tuple[Any, Iterator]]:
    """Groups of consecutive pairs with equal keys; nothing is sorted."""
    for k, group in itertools.groupby(pairs, key_of):
        yield k, (v for _, v in group)


def count(items: Iterable) -> int:
    return sum(1 for _ in items)


def parted(items: Iterable, test) -> tuple[list, list]:
    """Items that pass, and those that don't."""
    good: list = []
    bad: list = []
    for x in items:
        (good if test(x) else bad).append(x)
    return good, bad


def by_dotted_name(name: str) -> Any:
    """The object that a dotted name means."""
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute) if module else importlib.import_module(name)


def tour(number: int, nodes: list) -> list:
    """The number-th permutation of nodes, by factorial digits."""
    left, out = list(nodes), []
    for k in range(len(left) - 1, -1, -1):
        digit, number = divmod(number, factorial(k))
        out.append(left.pop(digit))
    return out


def tour_cost(graph: list[list[float]], path: list[int]) -> float:
    """Cost of the closed tour."""
    return sum(graph[a][b] for a, b in zip(path, [*path[1:], path[0]], strict=True))
