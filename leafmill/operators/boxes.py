"""Boxes of many pages at once, in numpy: which of a page's boxes meet, and regions grown to a fixpoint.

A kernel works on one Arrow batch of whole pages; Spark partitions and shuffles them. A sweep by x0 compares a box only with those that begin before it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIDES = ("x0", "y0", "x1", "y1")
#: Pairs held before they are joined.
PAIRS = 1 << 20


def sides(boxes: pa.StructArray) -> np.ndarray:
    """Four rows of numbers; a null is not a number and meets nothing."""
    return np.stack([boxes.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in SIDES])


def meetings(group: np.ndarray, box: np.ndarray, gap: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group whose boxes, one grown by `gap`, meet."""
    at = np.lexsort((box[0], group))
    g, (x0, y0, x1, y1) = group[at], box[:, at]
    i, k = np.arange(len(at)), 0
    while len(i):
        k += 1
        i = i[i + k < len(at)]
        i = i[(g[i + k] == g[i]) & (x0[i + k] <= x1[i] + gap)]
        j = i + k
        hit = (x0[i] - gap <= x1[j]) & (y0[i] - gap <= y1[j]) & (y1[i] + gap >= y0[j])
        yield at[i[hit]], at[j[hit]]


def _join(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def connected(group: np.ndarray, box: np.ndarray, gap: float, leads: np.ndarray | None = None) -> np.ndarray:
    """The first row of each row's connected set. leads: rows of which one at least is in every pair."""
    label, held, n = np.arange(len(group)), [], 0
    for a, b in meetings(group, box, gap):
        if leads is not None:
            kept = leads[a] | leads[b]
            a, b = a[kept], b[kept]
        held.append((a, b))
        n += len(a)
        if n > PAIRS:
            label, held, n = _join(label, held), [], 0
    return _join(label, held) if held else label


def grown(group: np.ndarray, box: np.ndarray, figures: np.ndarray, labels: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, box, figures and labels of what is left when every region has taken in what it meets."""
    while True:
        lead = connected(group, box, gap, figures > 0)
        order = np.argsort(lead, kind="stable")
        first = np.flatnonzero(np.diff(lead[order], prepend=-1))
        if len(first) == len(lead):
            return group, box, figures, labels
        group, box = group[order][first], box[:, order]
        box = np.stack([np.minimum.reduceat(box[0], first), np.minimum.reduceat(box[1], first), np.maximum.reduceat(box[2], first), np.maximum.reduceat(box[3], first)])
        figures, labels = np.add.reduceat(figures[order], first), np.add.reduceat(labels[order], first)
