"""One-to-one assignment of rows to columns with the largest total score, dense and over candidate lists."""

from __future__ import annotations

import heapq
from collections.abc import Hashable

import numpy as np


def assign(scores: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs, min(rows, columns) of them, with the largest sum; equal sums have no set choice."""
    rows = [dict(enumerate(map(float, r))) for r in scores] if scores.size else []
    return [(r, c) for r, c in enumerate(assign_listed(rows)) if c is not None]


def assign_listed(rows: list[dict[Hashable, float]]) -> list[Hashable | None]:
    """The column of each row, or None: as many pairs as the lists of candidates and scores allow, then the largest sum.

    Shortest augmenting paths with potentials over the lists alone, a row at a time. Each row has a column of its own
    that costs more than all others together; a row that ends there has none.
    """
    top = max((s for r in rows for s in r.values()), default=0.0)
    low = min((s for r in rows for s in r.values()), default=0.0)
    alone = (top - low + 1) * (len(rows) + 1)
    costs = [{(0, c): top - s for c, s in r.items()} | {(1, i): alone} for i, r in enumerate(rows)]
    row_price, col_price = [0.0] * len(rows), {}
    owner: dict[tuple, int] = {}
    for start in range(len(rows)):
        reach: dict[tuple, float] = {}
        via: dict[tuple, int] = {}
        done: dict[tuple, float] = {}
        heap: list = []
        row, length = start, 0.0
        while True:
            for k, (c, cost) in enumerate(costs[row].items()):
                d = length + cost - row_price[row] - col_price.get(c, 0.0)
                if c not in done and d < reach.get(c, np.inf):
                    reach[c], via[c] = d, row
                    heapq.heappush(heap, (d, c[0], k, row, c))
            while heap[0][4] in done or heap[0][0] > reach[heap[0][4]]:
                heapq.heappop(heap)
            length, _, _, _, col = heapq.heappop(heap)
            done[col] = length
            if col not in owner:
                break
            row = owner[col]
        for c, d in done.items():
            if c in owner:
                row_price[owner[c]] += length - d
            col_price[c] = col_price.get(c, 0.0) - (length - d)
        row_price[start] += length
        held = {r: c for c, r in owner.items()}
        while True:
            owner[col] = row = via[col]
            if row == start:
                break
            col = held[row]
    out: list[Hashable | None] = [None] * len(rows)
    for (private, c), r in owner.items():
        if not private:
            out[r] = c
    return out
