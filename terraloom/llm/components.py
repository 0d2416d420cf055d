"""Sets of links: union-find in numpy within a task; connected components over DataFrames beyond it."""

from __future__ import annotations

import numpy as np

from ..operators.graph import components  # noqa: F401  used through here by the operators


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in labels (smallest member's index), in place."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
