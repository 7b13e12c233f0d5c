"""Minimum-cost flow between shards (a transportation problem of a few dozen nodes)."""

from __future__ import annotations

import numpy as np


def min_cost_transport(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Flow (row: source, column: sink) that ships all supply at the least total cost.

    Successive cheapest augmenting paths over the residual graph, found by Bellman-Ford
    relaxation; amounts are whole bytes. The graph has one node per shard, so its size does
    not follow the data.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than the supply")
    m, n = len(supply), len(capacity)
    flow = np.zeros((m, n), dtype=object)
    left, room = list(supply), list(capacity)
    while any(left):
        source = np.array([0.0 if x else np.inf for x in left])
        sink = np.full(n, np.inf)
        from_source, from_sink = [-1] * n, [-1] * m
        for _ in range(m + n):
            reach = source[:, None] + cost
            nearest = reach.argmin(axis=0)
            near = reach[nearest, np.arange(n)]
            changed = False
            for j in np.flatnonzero(near < sink - 1e-9):
                sink[j], from_source[j], changed = near[j], int(nearest[j]), True
            for i in range(m):
                for j in np.flatnonzero(flow[i] > 0):
                    if sink[j] - cost[i, j] < source[i] - 1e-9:
                        source[i], from_sink[i], changed = sink[j] - cost[i, j], int(j), True
            if not changed:
                break
        end = min((j for j in range(n) if room[j]), key=lambda j: sink[j])
        path, j = [], end
        while True:
            i = from_source[j]
            back = from_sink[i]
            path.append((i, j, back))
            if back < 0:
                break
            j = back
        amount = min([left[path[-1][0]], room[end], *(flow[i, b] for i, _, b in path if b >= 0)])
        for i, j, back in path:
            flow[i, j] += amount
            if back >= 0:
                flow[i, back] -= amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def level_capacities(total: int, taken: list[int], weights: list[float] | None = None) -> list[int]:
    """Room left in each shard when all stand equally full (by weight), given what ``taken`` fills.

    A shard already above the level gets no room; the rooms sum to ``total`` exactly.
    """
    n = len(taken)
    w = [1.0] * n if weights is None else list(weights)
    open_, rest = set(range(n)), total
    while open_:
        level = (rest + sum(taken[i] for i in open_)) / sum(w[i] for i in open_)
        over = {i for i in open_ if taken[i] > level * w[i]}
        if not over:
            break
        open_ -= over
    rooms = [max(0, int(level * w[i]) - taken[i]) if i in open_ else 0 for i in range(n)]
    short = total - sum(rooms)
    order = sorted(open_)
    for k in range(abs(short)):
        rooms[order[k % len(order)]] += 1 if short > 0 else 0
    while sum(rooms) > total:
        rooms[max(order, key=lambda i: rooms[i])] -= 1
    return rooms
