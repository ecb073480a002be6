"""The k least values of each query, kept by a task while blocks of items pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

NONE = np.iinfo(np.int64).max
#: Queries whose rows are sent on at a time.
SENT = 1_024


def sortable(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids in rising order, and the places they had."""
    names = ids.to_numpy(zero_copy_only=False)
    order = np.argsort(names, kind="stable")
    return names[order], order


def keys(values: np.ndarray, digits: int) -> np.ndarray:
    """Whole numbers in the order of (value rounded to ``digits``, column); NONE for what is not finite."""
    with np.errstate(invalid="ignore"):
        steps = np.rint(values * 10.0**digits)
        fits = np.isfinite(steps)
        return np.where(fits, np.where(fits, steps, 0).astype(np.int64) * values.shape[1] + np.arange(values.shape[1]), NONE)


class Best:
    """Rounded values and ids of each query's k least, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.steps, self.ids = k, np.full((n, k), NONE), None
        self.digits = 0

    def add(self, start: int, values: np.ndarray, names: np.ndarray, digits: int) -> None:
        """``values``: queries from ``start`` on by items; ``names``: the items' ids, rising."""
        key = keys(values, digits)
        if key.shape[1] > self.k:
            key = np.partition(key, self.k - 1, axis=1)[:, : self.k]
        self.merge(start, key, names, values.shape[1], digits)

    def merge(self, start: int, key: np.ndarray, names: np.ndarray, width: int, digits: int) -> None:
        """``key``: of ``keys`` over ``width`` items, some columns of it."""
        self.digits = digits
        if self.ids is None:
            self.ids = np.zeros(self.steps.shape, names.dtype)
        end = start + len(key)
        there = key != NONE
        steps, ids = np.where(there, key // width, NONE), names[np.where(there, key % width, 0)]
        both, named = np.concatenate([self.steps[start:end], steps], axis=1), np.concatenate([self.ids[start:end], ids], axis=1)
        if self.k == 1 and key.shape[1] == 1 and named.dtype != object:
            order = ((both[:, 1] < both[:, 0]) | (both[:, 1] == both[:, 0]) & (named[:, 1] < named[:, 0])).astype(int)[:, None]
        else:
            tie = named if named.dtype != object else np.unique(named.astype(str), return_inverse=True)[1].reshape(named.shape)
            order = np.lexsort((tie, both), axis=-1)[:, : self.k]
        self.steps[start:end] = np.take_along_axis(both, order, axis=1)
        self.ids[start:end] = np.take_along_axis(named, order, axis=1)

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query numbers, ids and values, a part at a time."""
        for at in range(0, len(self.steps) if self.ids is not None else 0, SENT):
            q, i = np.nonzero(self.steps[at : at + SENT] != NONE)
            if len(q):
                yield q + at, self.ids[at + q, i], self.steps[at + q, i] / 10.0**self.digits
