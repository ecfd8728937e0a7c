"""Spanning forests of small dense graphs, in a task."""

from __future__ import annotations

import numpy as np


def spanning_forest(near: np.ndarray, same_side: bool = False) -> list[tuple[int, int]]:
    """Pairs (row, column) that span the components of a bipartite graph, or of a plain one if rows are the columns; then each goes outwards from its root."""
    left = np.ones(near.shape[0], bool)
    right = left if same_side else np.ones(near.shape[1], bool)
    out = []
    for root in range(near.shape[0]):
        todo = [(root, True)] if left[root] else []
        left[root] = False
        while todo:
            at, is_left = todo.pop()
            fresh = np.nonzero(near[at] & right if is_left or same_side else near[:, at] & left)[0]
            (right if is_left else left)[fresh] = False
            out += [(at, j) if is_left or same_side else (j, at) for j in fresh.tolist()]
            todo += [(j, not is_left) for j in fresh.tolist()]
    return out
