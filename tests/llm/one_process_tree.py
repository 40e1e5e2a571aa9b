"""Context-tree weighting in one process, for small tables: what the scores of op6 are held against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import written
from voxloom.llm.lm_scoring import DEPTH, joined, kt, log_kt, most_frequent


@dataclass
class Tree:
    """child[s * 256 + b]: the context that lengthens s by the earlier byte b, or 0; cost: log10 of each byte's
    probability after context s."""

    child: np.ndarray
    cost: np.ndarray


def weighted(depth: np.ndarray, parent: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """For each kept context and each byte the log10 of its probability under context-tree weighting.

    depth rises along the contexts; parent is the context that is one byte shorter. Where a context's longer ones
    are not all kept, what they would have counted makes up one more child without children. leaves[:, 256:] has the
    counts of the bytes; the rest is worked out here, node i having the children 2 * i and 2 * i + 1.
    """
    n = len(depth)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    has_child = np.zeros(n, dtype=bool)
    has_child[parent[1:]] = True
    for i in range(255, 0, -1):
        leaves[:, i] = leaves[:, 2 * i] + leaves[:, 2 * i + 1]
    one = np.empty((n, 256), dtype=np.float32)
    for block in range(0, 256, 16):  # nodes do not depend on each other: blocks of them bound the memory
        at = np.arange(max(1, block), block + 16)
        a, b = leaves[:, 2 * at].astype(float), leaves[:, 2 * at + 1].astype(float)
        rest_a, rest_b = a.copy(), b.copy()
        np.subtract.at(rest_a, parent[1:], a[1:])
        np.subtract.at(rest_b, parent[1:], b[1:])
        own = log_kt(a, b)
        longer = log_kt(rest_a, rest_b)  # and of the kept children, added below
        total = own.copy()
        for level in reversed(levels):
            inner = level[has_child[level]]
            total[inner] = np.logaddexp(own[inner], longer[inner]) - np.log(2)
            if level[0]:
                np.add.at(longer, parent[level], total[level])
        stop = np.where(has_child[:, None], np.exp(np.minimum(own - np.log(2) - total, 0)), 0.0)
        mixed, left = np.zeros_like(a), np.ones_like(a)
        for level in levels:
            up = parent[level]
            base_mixed, base_left = (mixed[up], left[up]) if level[0] else (mixed[level], left[level])
            mixed[level] = base_mixed + base_left * stop[level] * kt(a[level], b[level])
            left[level] = base_left * (1 - stop[level])
        one[:, at] = mixed + left * kt(rest_a, rest_b)
    cost = np.zeros((n, 1), dtype=np.float32)
    for level in range(8):
        p = one[:, 1 << level : 2 << level]
        longer = np.empty((n, p.shape[1], 2), dtype=np.float32)
        longer[:, :, 0], longer[:, :, 1] = cost + np.log10(1 - p), cost + np.log10(p)
        cost = longer.reshape(n, -1)
    return cost


def grow(grams: DataFrame, contexts: int = 3 << 13) -> Tree:
    """The tree of the most frequent contexts in this process; what reaches the driver is bounded by their number.

    With all contexts kept it gives what gram_costs gives.
    """
    places = grams.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth"), "gram", "n")
    masks = F.element_at(F.array(*[F.lit((1 << 8 * (d + 1)) - 1) for d in range(DEPTH + 1)]), F.col("depth") + 1)
    cut = places.withColumn("gram", F.col("gram").bitwiseAND(masks))
    byte = cut.groupBy("depth", "gram").agg(F.sum("n").alias("n"))
    byte = written(byte.select("depth", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(0xFF).cast("int").alias("byte"), "n"))
    # A context is as frequent as any that lengthens it, so all kept ones have their parents.
    sums = written(byte.groupBy("depth", "context").agg(F.sum("n").alias("total")))
    kept = most_frequent(sums, "total", contexts)
    rows = byte.join(F.broadcast(kept.drop("total")), ["depth", "context"]).toPandas()
    if rows.empty:
        return Tree(np.zeros(512, dtype=np.int32), weighted(np.zeros(1, dtype=int), np.zeros(1, dtype=int), np.zeros((1, 512), dtype=np.int64)).ravel())
    name = rows["depth"].to_numpy().astype(np.int64) << 40 | rows["context"].to_numpy()
    names, slot = np.unique(name, return_inverse=True)
    depth, context = names >> 40, names & ((1 << 40) - 1)
    leaves = np.zeros((len(names), 512), dtype=np.int64)
    leaves[slot, 256 + rows["byte"].to_numpy()] = rows["n"].to_numpy()
    del rows, name, slot
    parent = np.zeros(len(names), dtype=np.int64)
    child = np.zeros((len(names) + 1) * 256, dtype=np.int32)  # the last row has no children
    for d in range(1, int(depth.max()) + 1):
        at = np.flatnonzero(depth == d)
        older = context[at] >> (8 * (d - 1))
        parent[at] = np.searchsorted(names, (d - 1) << 40 | (context[at] & ((1 << 8 * (d - 1)) - 1)))
        child[parent[at] * 256 + older] = at
    return Tree(child, weighted(depth, parent, leaves).ravel())


def code_lengths(tree: Tree, texts: list[bytes]) -> np.ndarray:
    """log10 of the probability of each text and its end."""
    flat, places = joined(texts)
    wide = flat.astype(np.int64)
    none = len(tree.child) // 256 - 1
    state = np.zeros(len(places), dtype=np.int64)
    best = np.zeros(len(places), dtype=np.int64)
    for k in range(1, DEPTH + 1):
        state = tree.child[state * 256 + wide[places - k]].astype(np.int64)
        found = state > 0
        best = np.where(found, state, best)
        state[~found] = none
    cost = tree.cost[best * 256 + wide[places]].astype(float)
    return np.add.reduceat(cost, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]))
