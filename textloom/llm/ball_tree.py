"""Metric trees over whole-number vectors, and the filtering of centroids through them.

A ball holds its radius, the number and the sum of its vectors. Where the triangle inequality leaves
one centroid to a ball, all of it goes there by its count and sum; otherwise the centroids that are
left descend to its halves, and in a leaf they are compared with each vector. All squared
distances are exact; roots are only used to rule centroids out, with a margin for their rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Vectors in a leaf.
LEAF = 24
#: By how much a rounded sum of roots may be off, at the very most.
MARGIN = 1e-9


@dataclass
class BallTree:
    """Vectors in leaf order, and balls: vectors lo to hi, children at child and child + 1 (0: a leaf)."""

    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    square: np.ndarray
    sums: np.ndarray

    @property
    def centers(self) -> np.ndarray:
        return self.sums // (self.hi - self.lo)[:, None]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of `a` and `b`; floats carry them while each step is a whole number under 2**53."""
    most = int(np.abs(a).max(initial=0)) + int(np.abs(b).max(initial=0))
    kind = np.float64 if a.shape[1] * most * most < 1 << 53 else np.int64
    a, b = a.astype(kind), b.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
    """A tree over the rows of `points`, and their order in it. A ball is halved along the line through two vectors that are far apart."""
    order = np.arange(len(points))
    lo, hi, child, square, sums = [0], [len(points)], [0], [], []
    at = 0
    while at < len(lo):
        a, b = lo[at], hi[at]
        own = points[order[a:b]]
        total = own.sum(0)
        far = squares(own, (total // (b - a))[None, :])[:, 0]
        sums.append(total)
        square.append(int(far.max()))
        if b - a > leaf and square[at] > 0:
            one = own[far.argmax()]
            two = own[squares(own, one[None, :])[:, 0].argmax()]
            order[a:b] = order[a:b][np.argsort(own.astype(np.float64) @ (two - one).astype(np.float64), kind="stable")]
            half = (a + b) // 2
            child[at] = len(lo)
            lo += [a, half]
            hi += [half, b]
            child += [0, 0]
        at += 1
    found = BallTree(points[order], np.array(lo), np.array(hi), np.array(child), np.array(square, dtype=np.int64), np.array(sums, dtype=np.int64))
    return found, order


def nearest(tree: BallTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their centroids, rows, their centroids): every vector is in one of the balls or is one of the rows. Of equally near centroids the first counts."""
    centers, radius = tree.centers, np.sqrt(tree.square)
    whole, whole_of, single, single_of = [], [], [], []
    balls, left = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
    while len(balls):
        exact = np.where(left, squares(centers[balls], centroids), np.iinfo(np.int64).max)
        root = np.sqrt(exact)
        left &= root <= ((root.min(1) + 2 * radius[balls]) * (1 + MARGIN))[:, None]
        sure = (left.sum(1) == 1) | (tree.square[balls] == 0)  # a ball without a radius is one vector
        whole.append(balls[sure])
        whole_of.append(exact[sure].argmin(1))
        balls, left = balls[~sure], left[~sure]
        ends = tree.child[balls] == 0
        if ends.any():
            size = (tree.hi - tree.lo)[balls[ends]]
            rows = np.repeat(tree.lo[balls[ends]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            apart = np.where(np.repeat(left[ends], size, axis=0), squares(tree.points[rows], centroids), np.iinfo(np.int64).max)
            single.append(rows)
            single_of.append(apart.argmin(1))
        down = tree.child[balls[~ends]]
        balls, left = np.stack((down, down + 1), 1).ravel(), np.repeat(left[~ends], 2, axis=0)
    none = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else none for x in (whole, whole_of, single, single_of))


def gathered(tree: BallTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centroid gets, and their sums."""
    balls, of, rows, row_of = nearest(tree, centroids)
    counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    np.add.at(counts, of, (tree.hi - tree.lo)[balls])
    np.add.at(counts, row_of, 1)
    np.add.at(sums, of, tree.sums[balls])
    np.add.at(sums, row_of, tree.points[rows])
    return counts, sums


def labels(tree: BallTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's centroid and squared distance, in leaf order."""
    balls, of, rows, row_of = nearest(tree, centroids)
    out = np.empty(len(tree.points), dtype=np.int64)
    out[rows] = row_of
    for ball, c in zip(balls.tolist(), of.tolist(), strict=True):
        out[tree.lo[ball] : tree.hi[ball]] = c
    apart = tree.points - centroids[out]
    return out, (apart * apart).sum(1)
