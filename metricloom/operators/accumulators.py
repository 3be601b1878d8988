"""Metrics that users write in NumPy: a state is made of batches of rows, states merge, a state gives values.

Many of them share one pass. A task keeps a state for each slice and metric, gives them out when they grow too large, and
states of a slice merge in two levels, so that the largest slice is no task of its own."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.slicing import KEY, SlicingSpec, slice_keys

#: Bytes of states that a task holds, rows that a state is given at a time, and states of a slice that the first level makes.
HELD, ROWS, FAN = 16 << 20, 1_000, 64


class Accumulator(Protocol):
    """What a metric's author writes; states can be pickled."""

    def zero(self) -> Any:
        """The state of no rows."""

    def add(self, state: Any, rows: Mapping[str, np.ndarray]) -> Any:
        """The state with a batch of rows, given as arrays by column; nulls of numbers are NaN."""

    def merge(self, one: Any, other: Any) -> Any:
        """The state of both states' rows."""

    def result(self, state: Any) -> Mapping[str, float]:
        """Values by name."""


def _array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def accumulated(df: DataFrame, columns: Mapping[str, Column], accumulators: Mapping[str, Accumulator], specs: Sequence[SlicingSpec] = (), held: int = HELD, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """``slice_key, metric, value`` of all accumulators over the columns; metrics are named ``name`` or ``name/value``.

    A row with several slices is in each one's batches. No rows give no slices.
    """
    given = df.select(F.transform(slice_keys(df, specs), lambda k: F.to_json(k)).alias("__keys"), *(c.alias(n) for n, c in columns.items()))
    names, kinds = list(columns), list(accumulators.items())

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % fan
        kept: dict[str, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys, data = list(kept), [pickle.dumps(x, 5) for x in kept.values()]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([salt] * len(keys), pa.int32()), pa.array(data, pa.binary())], ["key", "salt", "state"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("__keys")
                count = lists.value_lengths().to_numpy()
                flat = lists.flatten().dictionary_encode()
                order = np.argsort(_array(flat.indices), kind="stable")
                row = np.repeat(np.arange(len(count)), count)[order]
                ends = np.cumsum(np.bincount(_array(flat.indices), minlength=len(flat.dictionary)))
                arrays = {n: _array(part.column(n)) for n in names}
                for key, s, e in zip(flat.dictionary.to_pylist(), np.append(0, ends), ends, strict=False):
                    own = kept.get(key) or [a.zero() for _, a in kinds]
                    chosen = {n: x[row[s:e]] for n, x in arrays.items()}
                    kept[key] = [a.add(x, chosen) for x, (_, a) in zip(own, kinds, strict=True)]
            if kept:  # one state tells about the size of all
                size = len(pickle.dumps(next(reversed(kept.values())), 5))
            if len(kept) * size > held:
                yield out()
        if kept:
            yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> list | None:
        total = None
        for batch in batches:
            for data in batch.column("state"):
                one = pickle.loads(data.as_py())
                total = one if total is None else [a.merge(x, y) for x, y, (_, a) in zip(total, one, kinds, strict=True)]
        return total

    def level(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = merged(batches)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([pickle.dumps(total, 5)])], ["key", "salt", "state"])

    def last(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [(name if value == "" else f"{name}/{value}", float(x)) for (name, a), state in zip(kinds, merged(batches), strict=True) for value, x in a.result(state).items()]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(values)), pa.array([n for n, _ in values]), pa.array([x for _, x in values], pa.float64())], ["key", "metric", "value"])

    schema = "key string, salt int, state binary"
    parts = given.mapInArrow(states, schema).groupBy("key", "salt").applyInArrow(level, schema)
    found = parts.groupBy("key").applyInArrow(last, "key string, metric string, value double")
    return found.select(F.from_json("key", KEY).alias("slice_key"), "metric", "value")


class WeightedMoments:
    """Means, variances and the correlation of two columns with weights, by sums around a running mean: stable where plain
    sums of squares are not."""

    def __init__(self, x: str, y: str, weight: str):
        self.names = x, y, weight

    def zero(self) -> np.ndarray:
        return np.zeros(6)

    def add(self, state: np.ndarray, rows: Mapping[str, np.ndarray]) -> np.ndarray:
        x, y, w = (rows[n].astype(float) for n in self.names)
        ok = ~(np.isnan(x) | np.isnan(y) | np.isnan(w)) & (w > 0)
        x, y, w = x[ok], y[ok], w[ok]
        n = w.sum()
        if not n:
            return state
        a, b = (w * x).sum() / n, (w * y).sum() / n
        return self.merge(state, np.array([n, a, b, (w * (x - a) ** 2).sum(), (w * (y - b) ** 2).sum(), (w * (x - a) * (y - b)).sum()]))

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        n = one[0] + other[0]
        if not one[0] or not other[0]:
            return other if not one[0] else one
        d, e, share = other[1] - one[1], other[2] - one[2], one[0] * other[0] / n
        out = one + other
        return np.array([n, one[1] + d * other[0] / n, one[2] + e * other[0] / n, out[3] + d * d * share, out[4] + e * e * share, out[5] + d * e * share])

    def result(self, state: np.ndarray) -> dict[str, float]:
        n, a, b, p, q, r = state
        square = r * r / (p * q) if p > 0 and q > 0 else math.nan
        return {"mean_x": a if n else math.nan, "mean_y": b if n else math.nan, "variance_x": p / n if n else math.nan, "squared_correlation": square}


class Quantiles:
    """Weighted quantiles of numbers in a range from a histogram of fixed steps; exact to a step."""

    def __init__(self, column: str, weight: str, low: float, high: float, steps: int = 1_000, at: Sequence[float] = (0.5,)):
        self.column, self.weight, self.low, self.high, self.steps, self.at = column, weight, low, high, steps, tuple(at)

    def zero(self) -> np.ndarray:
        return np.zeros(self.steps)

    def add(self, state: np.ndarray, rows: Mapping[str, np.ndarray]) -> np.ndarray:
        x, w = rows[self.column].astype(float), rows[self.weight].astype(float)
        ok = ~np.isnan(x)
        place = np.clip(((x[ok] - self.low) / (self.high - self.low) * self.steps).astype(int), 0, self.steps - 1)
        return state + np.bincount(place, w[ok], self.steps)

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return one + other

    def result(self, state: np.ndarray) -> dict[str, float]:
        running = np.cumsum(state)
        step = (self.high - self.low) / self.steps
        return {f"{q:g}": self.low + step * int(np.searchsorted(running, q * running[-1])) if running[-1] else math.nan for q in self.at}
