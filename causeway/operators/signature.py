"""Truncated path signatures in three forms: window functions, higher-order functions, and Arrow batches.

The signature of a piecewise linear path is the product of its segments' tensor exponentials (Chen's identity). Level k of
a segment's exponential is its increment's k-th tensor power over k!. All forms give levels 1 to depth, each flattened in
row-major order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def width(channels: int, depth: int) -> int:
    return sum(channels**k for k in range(1, depth + 1))


def coordinate_names(channels: int, depth: int) -> list[str]:
    return ["s" + "".join(map(str, word)) for k in range(1, depth + 1) for word in itertools.product(range(1, channels + 1), repeat=k)]


def by_window(points: DataFrame, channels: Sequence[str], depth: int, *, path: Sequence[str], pos: str = "pos") -> DataFrame:
    """A row for each path of points (path columns, pos, channel columns): its signature's coordinates s1, s2, s11, ...

    Level k is a sum over segments of the lower levels before the segment, times exponentials of its increment, so each
    level takes one pass of running sums over the same partitioning.
    """
    order = W.partitionBy(*path).orderBy(pos)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    d = len(channels)
    steps = points.select(*path, pos, *((F.col(c) - F.lag(c).over(order)).alias(f"d{i + 1}") for i, c in enumerate(channels))).where("d1 is not null")
    power = lambda word: math.prod((F.col(f"d{i}") for i in word[1:]), start=F.col(f"d{word[0]}")) / F.lit(float(math.factorial(len(word))))
    name = lambda word: "".join(map(str, word))
    for k in range(1, depth + 1):
        words = list(itertools.product(range(1, d + 1), repeat=k))
        term = lambda word: sum((F.col(f"p{name(word[:e])}") * power(word[e:]) for e in range(1, len(word))), start=power(word))
        steps = steps.withColumns({f"t{name(w)}": term(w) for w in words})
        if k < depth:
            steps = steps.withColumns({f"p{name(w)}": F.coalesce(F.sum(f"t{name(w)}").over(before), F.lit(0.0)) for w in words})
    every = [w for k in range(1, depth + 1) for w in itertools.product(range(1, d + 1), repeat=k)]
    return steps.groupBy(*path).agg(*(F.sum(f"t{name(w)}").alias(f"s{name(w)}") for w in every))


def _outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: p * q)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _shared(a: Column, b: Column, n: float) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / F.lit(n))


def by_functions(path: Column, channels: int, depth: int) -> Column:
    """The signature of an array of points (arrays of doubles) as an array, in SQL functions."""
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.zip_with(F.get(path, i), F.get(path, i - 1), lambda x, y: x - y))
    zero = F.struct(*(F.array_repeat(F.lit(0.0), channels**k).alias(f"l{k}") for k in range(1, depth + 1)))

    def merge(acc: Column, step: Column) -> Column:
        """Every level after one more segment, by Horner's rule as in batch()."""
        levels = []
        for k in range(1, depth + 1):
            lead = F.array(F.lit(1.0 / k))
            for j in range(k - 1, 0, -1):
                lead = _shared(acc[f"l{k - j}"], _outer(lead, step), float(j))
            levels.append(_plus(acc[f"l{k}"], _outer(lead, step)).alias(f"l{k}"))
        return F.struct(*levels)

    return F.aggregate(steps, zero, merge, lambda acc: F.concat(*(acc[f"l{k}"] for k in range(1, depth + 1))))


def batch(paths: np.ndarray, depth: int) -> np.ndarray:
    """Signatures of an (n, points, channels) array in double precision: level k gathers, over the segments, every level
    below it as it stood before the segment, times the exponential that is missing to k."""
    if depth not in range(1, 5):
        raise ValueError("the depth is 1 to 4")
    if np.ndim(paths) != 3 or np.shape(paths)[1] == 1:
        raise ValueError("paths are an array of (n, points, channels) with two points at least")
    n, _, d = paths.shape
    steps = np.diff(paths.astype(np.float64), axis=1)
    # Of level k, the running value before each segment: (n, segments, d**k).
    before, totals = [np.ones((*steps.shape[:2], 1))], []
    for k in range(1, depth + 1):
        lead = before[0] / k  # Horner's rule: ((level 0 * step / k + level 1) * step / (k - 1) + ...) * step
        for j in range(k, 1, -1):
            lead = before[k - j + 1] / (j - 1) + (lead[..., :, None] * steps[..., None, :]).reshape(n, steps.shape[1], -1) / (j - 1)
        if k == depth:  # of the top level only the sum over the segments is needed
            totals.append((lead.transpose(0, 2, 1) @ steps).reshape(n, -1))
            break
        running = np.cumsum((lead[..., :, None] * steps[..., None, :]).reshape(n, steps.shape[1], -1), axis=1)
        totals.append(running[:, -1])
        before.append(np.concatenate((np.zeros((n, 1, d**k)), running[:, :-1]), axis=1))
    return np.concatenate(totals, axis=1)


def of_arrays(paths: pa.Array, depth: int) -> list[np.ndarray | None]:
    """The signature of every path, which may differ in length; None for a null path, one of fewer than
    two points, and one with a null point or coordinate or points of unlike width."""
    points = pc.list_flatten(paths)
    values = pc.list_flatten(points)
    number = pc.fill_null(pc.list_value_length(paths), 0).to_numpy()
    width = pc.fill_null(pc.list_value_length(points), 0).to_numpy()
    first, at = np.cumsum(number) - number, np.concatenate(([0], np.cumsum(width)))
    gaps = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
    flat = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy()
    out: list[np.ndarray | None] = [None] * len(paths)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(number >= 2):
        own = width[first[i] : first[i] + number[i]]
        if own[0] and (own == own[0]).all() and gaps[at[first[i]]] == gaps[at[first[i] + number[i]]]:
            shapes.setdefault((int(number[i]), int(own[0])), []).append(int(i))
    for shape, rows in shapes.items():
        stacked = flat[at[first[rows]][:, None] + np.arange(shape[0] * shape[1])].reshape(len(rows), *shape)
        for i, row in zip(rows, batch(stacked, depth), strict=True):
            out[i] = row
    return out


def by_arrow(depth: int):
    """An Arrow UDF from array<array<double>> to the single-precision signature, as of_arrays() gives it."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def signature(paths: pa.Array) -> pa.Array:
        return pa.array(of_arrays(paths, depth), pa.list_(pa.float64())).cast(pa.list_(pa.float32()))

    return signature
