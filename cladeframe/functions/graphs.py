"""Small graph routines on arrays, for graphs that fit one task (see the callers' ceilings)."""

from __future__ import annotations

import numpy as np


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component number of each of ``n`` vertices under the edges (a, b); numbered by least vertex."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1].ravel() if n else label


def strong_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Strongly connected component of each vertex under the arcs a -> b, in one pass (lowest reachable vertex on the path), linear in arcs.

    Components are numbered in the order in which they close: an arc between two of them leads to a smaller number.
    """
    order = np.argsort(a, kind="stable")
    heads, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    seen, low, out = [-1] * n, [0] * n, [-1] * n
    path: list[int] = []
    clock = closed = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        path.append(root)
        todo = [(root, first[root])]
        while todo:
            v, at = todo.pop()
            if at < first[v + 1]:
                todo.append((v, at + 1))
                w = heads[at]
                if seen[w] < 0:
                    seen[w] = low[w] = clock
                    clock += 1
                    path.append(w)
                    todo.append((w, first[w]))
                elif out[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            if low[v] == seen[v]:
                while True:
                    w = path.pop()
                    out[w] = closed
                    if w == v:
                        break
                closed += 1
            if todo:
                parent = todo[-1][0]
                low[parent] = min(low[parent], low[v])
    return np.array(out, np.int64)


def condensation_rank(scc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each strongly connected component, the number of arcs on the longest path that leads to it."""
    n = int(scc.max()) + 1 if len(scc) else 0
    rank = np.zeros(n, np.int64)
    start, end = scc[a], scc[b]
    between = np.unique(np.stack([start, end], 1)[start != end], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    # Arcs lead to smaller numbers, so components of greater number are ready first.
    for x, y in between[np.argsort(-between[:, 0], kind="stable")].tolist():
        rank[y] = max(rank[y], rank[x] + 1)
    return rank
