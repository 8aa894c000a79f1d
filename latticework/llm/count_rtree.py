"""An R-tree over count vectors with a minima bound on overlap.

A token set hashed into groups becomes the vector of its group sizes. Two sets
share at most the sum of the coordinate minima; against a whole subtree, at most
the sum of the minima with its upper corner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def needed(size_a: np.ndarray, size_b: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Smallest intersection with whole * intersection >= part * union."""
    return -((-part * (size_a + size_b)) // (whole + part))


class CountTree:
    """Bulk-loaded tree: points sorted by size, then by their widest coordinate, packed `leaf` to a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 32) -> None:
        order = np.argsort(sizes, kind="stable")
        run = leaf * leaf
        for at in range(0, len(order), run):
            part = order[at : at + run]
            order[at : at + run] = part[np.argsort(points[part, points[part].var(axis=0).argmax()], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        high, low_size, high_size = self.points, self.sizes, self.sizes
        while True:
            cuts = np.arange(0, len(high), leaf)
            ends = np.minimum(cuts + leaf, len(high))
            high = np.maximum.reduceat(high, cuts, axis=0)
            low_size, high_size = np.minimum.reduceat(low_size, cuts), np.maximum.reduceat(high_size, cuts)
            self.levels.append((high, low_size, high_size, np.stack([cuts, ends], axis=1)))
            if len(cuts) == 1:
                break

    def search(self, point: np.ndarray, size: int, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of all points whose bound allows a link with `point`, and their bounds."""
        nodes = np.array([0])
        for high, low_size, high_size, spans in reversed(self.levels):
            low = low_size[nodes]
            bound = np.minimum(point, high[nodes]).sum(axis=1)
            nodes = nodes[
                (bound >= needed(size, low, part, whole))
                & (whole * high_size[nodes] >= part * size) & (part * low <= whole * size)
            ]
            if not len(nodes):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            nodes = np.concatenate([np.arange(*spans[i]) for i in nodes])
        bound = np.minimum(point, self.points[nodes]).sum(axis=1)
        good = bound >= needed(size, self.sizes[nodes], part, whole)
        return self.order[nodes[good]], bound[good]

    def searches(
        self, names: np.ndarray, points: np.ndarray, sizes: np.ndarray, part: int, whole: int
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """`search` for many points, as (name, indexes, bounds); a tree of one node is scanned in one step."""
        if len(self.levels) > 1:
            for name, point, size in zip(names, points, sizes):
                found, bound = self.search(point, size, part, whole)
                if len(found):
                    yield name, found, bound
            return
        for at in range(0, len(names), 256):
            bound = np.minimum(points[at : at + 256, None, :], self.points).sum(axis=2)
            good = bound >= needed(sizes[at : at + 256, None], self.sizes, part, whole)
            for i in np.flatnonzero(good.any(axis=1)):
                yield names[at + i], self.order[good[i]], bound[i][good[i]]
