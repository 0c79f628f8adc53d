"""Exact nearest neighbours by blocks of distinct vectors, so that no pair of rows is made."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Python workers receive these functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct vectors that a task holds at a time, and distances that it holds at a time.
BLOCK_VECTORS, BLOCK_DISTANCES = 20_000, 1_000_000
#: Ids of one vector, besides two times k, from which only the first k are kept.
KEPT_IDS = 100
#: Bound on the error of a distance by a matrix product, as a part of both squared lengths.
SLACK = 1e-12


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column: rows padded by zeros; length -1 for a null vector or one with a null in it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.values.slice(column.offsets[0].as_py() if len(column) else 0, int(lengths.sum()))
    own = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = np.zeros((len(lengths), int(lengths.max(initial=0))))
    values[own, at] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    whole = np.ones(len(lengths), bool)
    whole[own[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    whole &= ~column.is_null().to_numpy(zero_copy_only=False)
    return values, np.where(whole, lengths, -1)


class Queries:
    """The queries of each group: their numbers and vectors, by length."""

    def __init__(self, groups: list, vectors: pa.Array):
        values, lengths = matrix(vectors)
        self.of: dict = {}
        for number, key in enumerate(zip(groups, lengths.tolist())):
            self.of.setdefault(key[0], {}).setdefault(key[1], []).append(number)
        for by_length in self.of.values():
            for length, numbers in by_length.items():
                by_length[length] = (np.array(numbers), values[numbers, : max(length, 0)])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in order of the places, as the column function does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        step = a[:, i] - b[:, i]
        total += step * step
    return total


def _near(q: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, distance) of all pairs that may be among the k nearest of a query, by blocks of queries.

    A matrix product gives distances up to a small error; what is within that error of the k-th is computed exactly.
    """
    with np.errstate(all="ignore"):
        vn = (v * v).sum(1)
        for at in range(0, len(q), max(1, BLOCK_DISTANCES // len(v))):
            part = q[at : at + max(1, BLOCK_DISTANCES // len(v))]
            qn = (part * part).sum(1)
            about = part @ (-2 * v.T)
            about += vn
            about += qn[:, None]
            about[np.isnan(about)] = np.inf
            least = about.min(1) if k == 1 or len(v) <= k else np.partition(about, k - 1, axis=1)[:, k - 1]
            limit = np.inf if len(v) <= k else least + SLACK * (qn + vn.max())
            limit = np.where(np.isnan(limit), np.inf, limit)
            i, j = np.nonzero(about <= np.broadcast_to(limit, len(part))[:, None])
            yield at + i, j, _distances(part[i], v[j])


def first_ids(ids: list, k: int) -> list:
    """The first k ids, nulls before all, as an ascending order has them."""
    return sorted(ids, key=lambda x: (x is not None, x))[:k]


class Block:
    """Distinct vectors with the first k ids of each, and the k nearest of them for each query of their group."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.rows: dict = {}

    def add(self, groups: list, values: np.ndarray, lengths: np.ndarray, ids: list) -> None:
        for n, (group, length, id_) in enumerate(zip(groups, lengths.tolist(), ids)):
            if group in self.queries.of:
                # Minus zero is another vector than zero here, which costs nothing but a row.
                own = self.rows.setdefault((group, length, values[n, : max(length, 0)].tobytes()), [])
                own.append(id_)
                if len(own) >= KEPT_IDS + 2 * self.k:
                    own[:] = first_ids(own, self.k)

    def found(self) -> Iterator[tuple[np.ndarray, list, list]]:
        """(query numbers, ids, distances), distance None where no vector or another length meets, which comes first."""
        by_group: dict = {}
        for (group, length, held), ids in self.rows.items():
            vectors, lists = by_group.setdefault(group, {}).setdefault(length, ([], []))
            vectors.append(held)
            lists.append(first_ids(ids, self.k))
        self.rows = {}
        for group, by_length in by_group.items():
            for length, (numbers, q) in self.queries.of[group].items():
                apart = [x for n, (_, ids) in by_length.items() if n != length or n < 0 for own in ids for x in own]
                apart = first_ids(apart, self.k)
                if apart:
                    yield np.repeat(numbers, len(apart)), apart * len(numbers), [None] * (len(apart) * len(numbers))
                if length >= 0 and length in by_length:
                    yield from self._nearest(numbers, q, *by_length[length])

    def _nearest(self, numbers: np.ndarray, q: np.ndarray, held: list[bytes], ids: list[list]) -> Iterator[tuple]:
        v = np.frombuffer(b"".join(held), float).reshape(len(held), q.shape[1]) if q.shape[1] else np.zeros((len(held), 0))
        flat = [x for own in ids for x in own]
        sizes = np.array([len(own) for own in ids])
        first = np.cumsum(sizes) - sizes
        place = np.empty(len(flat), np.int64)
        place[sorted(range(len(flat)), key=lambda n: (flat[n] is not None, flat[n]))] = np.arange(len(flat))
        for i, j, distance in _near(q, v, self.k):
            each = sizes[j]
            row = np.repeat(first[j] - np.cumsum(each) + each, each) + np.arange(each.sum())
            i, distance = np.repeat(i, each), np.repeat(distance, each)
            order = np.lexsort((place[row], distance, i))
            i, row, distance = i[order], row[order], distance[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < self.k
            yield numbers[i[kept]], [flat[n] for n in row[kept].tolist()], distance[kept].tolist()


def nearest_in_task(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> Iterator[tuple[np.ndarray, list, list]]:
    """Of batches (id, rv, group): for each block of distinct vectors, its k nearest of each query."""
    block = Block(queries, k)
    for batch in batches:
        values, lengths = matrix(batch.column(1))
        ids, groups = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        block.add(groups, values, lengths, ids)
        if len(block.rows) >= BLOCK_VECTORS:
            yield from block.found()
    yield from block.found()
