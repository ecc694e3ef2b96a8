"""Nearest vectors by mean absolute difference between two sets of rows, exact, inside a task.

Differences are first summed over whole numbers, a lower bound of the distance; only what may still be the nearest is compared in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TILE = 1024  # index vectors whose differences are summed at once


def _by_length(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors in doubles, for each length. A vector with a value that is not finite is near to none."""
    v = table.column("v").combine_chunks()
    sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        flat = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        values = flat.reshape(len(rows), n)
        whole = np.isfinite(values).all(axis=1)
        yield rows[whole], values[whole]


def _first_two(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places to keep of equal vectors: those of the two least ids, of which a query may have one. codes ascend."""
    raw = np.ascontiguousarray(values).view(np.dtype((np.void, values.shape[1] * values.itemsize))).ravel()
    _, first, same = np.unique(raw, return_index=True, return_inverse=True)
    others = np.flatnonzero(codes != codes[first][same])
    _, second = np.unique(same[others], return_index=True)
    return np.sort(np.concatenate([first, others[second]]))


def _search(q: np.ndarray, own: np.ndarray, x: np.ndarray, codes: np.ndarray, size: int, limit: float) -> Iterator[tuple[int, float, int]]:
    """(query, distance, place in x): of equals the first place; never a row of the query's own id. codes ascend."""
    m = x.shape[1]
    lo, hi = np.percentile(x, (0.1, 99.9))
    kind = np.int16 if m <= 256 else np.int32
    most = max(1, np.iinfo(kind).max // m)
    step = (hi - lo) / (2 * most) or 1.0
    whole = lambda v: np.rint((np.clip(v, lo, hi) - (lo + hi) / 2) / step).astype(kind)
    qs, xs = whole(q), whole(x)
    tiles = [np.ascontiguousarray(xs[at : at + TILE].T) for at in range(0, len(xs), TILE)]
    spare = np.empty((m, TILE), kind)
    larger = np.empty(len(xs), kind)
    sums = xs.sum(axis=1, dtype=np.int64)
    exact = lambda i, at: np.add.accumulate(np.abs(x[at] - q[i]).T, axis=0)[-1] / size
    starts, ends = np.searchsorted(codes, own, "left").tolist(), np.searchsorted(codes, own, "right").tolist()
    for i in range(len(q)):
        for k, tile in enumerate(tiles):
            n = tile.shape[1]
            np.maximum(tile, qs[i][:, None], out=spare[:, :n])
            np.add.reduce(spare[:, :n], axis=0, dtype=kind, out=larger[k * TILE : k * TILE + n])
        apart = 2 * larger.astype(np.int64) - sums - int(qs[i].sum(dtype=np.int64))  # |a - b| = 2 max(a, b) - a - b
        apart[starts[i] : ends[i]] = np.iinfo(np.int64).max
        best = int(apart.argmin())
        if starts[i] <= best < ends[i]:
            continue  # nothing but its own
        within = min(limit, exact(i, [best])[0])
        # rounding moves a difference by one step at most; clipping only shortens it
        at = np.flatnonzero(apart <= within * size / step * (1 + 1e-9) + m + 1)
        at = at[(at < starts[i]) | (at >= ends[i])]
        if len(at):
            d = exact(i, at)
            k = int(d.argmin())
            if d[k] <= limit:
                yield i, float(d[k]), int(at[k])


def nearest(queries: pa.Table, index: pa.Table, limit: float) -> pa.Table:
    """id, distance, nearest: of each query with an index row within the limit, another id's; of equals the least id. Columns: id, v.

    A longer vector is compared by as many values as the other has; the mean is over the query's length.
    """
    index = index.take(pc.sort_indices(index, sort_keys=[("id", "ascending")]))
    ids = index.column("id").combine_chunks().dictionary_encode()  # in order of first use, so codes ascend
    codes = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = pc.fill_null(pc.index_in(queries.column("id"), value_set=ids.dictionary), -1).to_numpy().astype(np.int64)
    found: dict[int, tuple[float, int]] = {}
    sides = list(_by_length(index))
    for rows, q in _by_length(queries):
        for places, x in sides:
            m = min(q.shape[1], x.shape[1])
            if not m or not len(q) or not len(x):
                continue
            kept = _first_two(x[:, :m], codes[places])
            here = places[kept]
            for i, d, at in _search(np.ascontiguousarray(q[:, :m]), own[rows], x[kept, :m], codes[here], q.shape[1], limit):
                row, new = int(rows[i]), (d, int(here[at]))
                found[row] = min(found.get(row, new), new)
    at = pa.array(list(found), pa.int64())
    near = pa.array([k for _, k in found.values()], pa.int64())
    return pa.table({"id": queries.column("id").take(at), "distance": pa.array([d for d, _ in found.values()], pa.float64()), "nearest": index.column("id").take(near)})
