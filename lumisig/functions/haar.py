"""Wavelet signatures of images: NumPy kernels over batches, and their Spark functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FULL, GRAY_LIMIT, LEVEL, WEIGHTS, YIQ, Geometry
from . import codec
from .codec import lists


def to_yiq(rgb: np.ndarray) -> np.ndarray:
    """(n, 3, pixels) of red, green and blue to luminance and chroma; sums run left to right."""
    r, g, b = (rgb[:, i].astype(np.float64) for i in range(3))
    return np.stack([m[0] * r + m[1] * g + m[2] * b for m in YIQ], 1)


def _levels(a: np.ndarray) -> None:
    """The one-dimensional transform along the last axis, in place: scaled differences above, plain sums below."""
    h, c = a.shape[-1], 1.0
    while h > 1:
        c *= LEVEL
        even, odd = a[..., 0:h:2], a[..., 1:h:2]
        low, high = even + odd, (even - odd) * c
        h //= 2
        a[..., :h], a[..., h : 2 * h] = low, high
    a[..., 0] *= c


def haar_2d(planes: np.ndarray) -> np.ndarray:
    """(n, side, side) transformed, rows and then columns."""
    a = np.array(planes, np.float64)
    _levels(a)
    t = np.ascontiguousarray(a.swapaxes(-1, -2))
    _levels(t)
    return t.swapaxes(-1, -2)


class _SmallestFirst:
    """A binary heap of (magnitude, index) with the smallest magnitude on top. Which of equal ones
    leaves first follows from the moves, so they are fixed: a new entry rises over larger ones only; when the top leaves, the
    last entry takes its place, sinks to the bottom along the smaller children, the right one of equals, and rises again."""

    def __init__(self):
        self.d: list[float] = []
        self.i: list[int] = []

    def _rise(self, at: int) -> None:
        d, i = self.d, self.i
        x, y = d[at], i[at]
        while at and x < d[up := (at - 1) // 2]:
            d[at], i[at] = d[up], i[up]
            at = up
        d[at], i[at] = x, y

    def push(self, d: float, i: int) -> None:
        self.d.append(d)
        self.i.append(i)
        self._rise(len(self.d) - 1)

    def pop(self) -> int:
        d, i = self.d, self.i
        top, x, y = i[0], d.pop(), i.pop()
        if not d:
            return top
        at, n = 0, len(d)
        while (kid := 2 * at + 1) < n:
            if kid + 1 < n and d[kid + 1] <= d[kid]:
                kid += 1
            d[at], i[at] = d[kid], i[kid]
            at = kid
        d[at], i[at] = x, y
        self._rise(at)
        return top


def largest(values: np.ndarray, g: Geometry) -> np.ndarray:
    """Indices of the ``g.keep`` largest magnitudes but for index 0, in order; negative where the value is not over zero."""
    d = np.abs(values)
    rest = d[1:]
    cut = np.partition(rest, -g.keep)[-g.keep]
    sure = np.flatnonzero(rest >= cut) + 1
    if len(sure) > g.keep:
        if g.ties == "index":
            sure = np.lexsort((np.arange(len(rest)), -rest))[: g.keep] + 1
        else:
            heap = _SmallestFirst()
            for i in range(1, g.keep + 1):
                heap.push(float(d[i]), i)
            low = heap.d[0]
            for i in np.flatnonzero(d > low).tolist():  # what does not beat the first least can't beat a later one
                if i > g.keep and d[i] > heap.d[0]:
                    heap.pop()
                    heap.push(float(d[i]), i)
            sure = np.array(heap.i)
    return np.sort(np.where(values[sure] > 0, sure, -sure)).astype(np.int16)


def signatures(rgb: np.ndarray, g: Geometry = FULL) -> tuple[np.ndarray, np.ndarray]:
    """Means (n, 3) and kept coefficients (n, 3, keep) of images given as (n, 3, pixels)."""
    n = len(rgb)
    a = haar_2d(to_yiq(rgb).reshape(n * 3, g.side, g.side)).reshape(n, 3, g.pixels)
    a[:, :, 0] /= g.dc_divisor
    return a[:, :, 0].copy(), np.stack([np.stack([largest(c, g) for c in x]) for x in a]) if n else np.zeros((0, 3, g.keep), np.int16)


def signed(means: np.ndarray, coefs: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([lists(means), lists(coefs)], names=["avglf", "sig"])


def _stack(planes: list[pa.Array], g: Geometry) -> np.ndarray:
    """Three columns of binaries (a byte a pixel) or arrays of numbers, as (n, 3, pixels)."""
    out = []
    for p in planes:
        p = p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p
        if pa.types.is_binary(p.type) or pa.types.is_large_binary(p.type):
            rows = [np.frombuffer(x.as_py(), np.uint8) for x in p]
        else:
            flat, ends = p.flatten().to_numpy(zero_copy_only=False), np.asarray(p.value_lengths())
            rows = np.split(flat, np.cumsum(ends)[:-1]) if len(ends) else []
        if any(len(r) != g.pixels for r in rows):
            raise ValueError(f"a channel must have {g.pixels} values")
        out.append(np.stack(rows) if len(rows) else np.zeros((0, g.pixels)))
    return np.stack(out, 1).astype(np.float64)


def haar_signature(r: Column, gr: Column, b: Column, g: Geometry = FULL) -> Column:
    """struct(avglf array<double>, sig array<array<short>>) of an image's channels."""

    @F.arrow_udf("avglf array<double>, sig array<array<short>>")
    def run(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        planes = [x, y, z]
        parts = [signatures(_stack([p.slice(at, 16) for p in planes], g), g) for at in range(0, len(x), 16)]
        if not parts:
            return signed(np.zeros((0, 3)), np.zeros((0, 3, g.keep), np.int16))
        return signed(np.concatenate([m for m, _ in parts]), np.concatenate([c for _, c in parts]))

    return run(r, gr, b)


def haar_plane(values: Column, g: Geometry) -> Column:
    """array<double>: the transformed plane, its mean rescaled."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        a = _stack([x], g)[:, 0]
        a = haar_2d(a.reshape(-1, g.side, g.side)).reshape(-1, g.pixels)
        a[:, 0] /= g.dc_divisor
        return lists(a)

    return run(values)


# Column forms of the small rules; JVM-side.


def yiq(r: Column, g: Column, b: Column, channel: int) -> Column:
    m = YIQ[channel]
    return F.lit(m[0]) * r + F.lit(m[1]) * g + F.lit(m[2]) * b


def is_grayscale(avglf2: Column, avglf3: Column) -> Column:
    return F.abs(avglf2) + F.abs(avglf3) < F.lit(GRAY_LIMIT)


def num_colors(avglf2: Column, avglf3: Column) -> Column:
    return F.when(is_grayscale(avglf2, avglf3), 1).otherwise(3)


def coef_bin(coef: Column, side: int = FULL.side) -> Column:
    i = F.abs(coef)
    return F.least(F.greatest(F.floor(i / side), F.pmod(i, F.lit(side))), F.lit(5)).cast("int")


def coef_weight(coef: Column, channel: Column, side: int = FULL.side) -> Column:
    table = F.array(*(F.array(*(F.lit(w).cast("float") for w in row)) for row in WEIGHTS))
    return F.get(F.get(table, coef_bin(coef, side)), channel)


def bucket_index(channel: Column, coef: Column, pixels: int = FULL.pixels) -> Column:
    """Number of the posting list of a channel's signed coefficient; coefficient 0 counts as positive."""
    coef = coef.cast("int")
    return (channel * F.lit(2 * pixels) + F.when(coef < 0, pixels).otherwise(0) + F.abs(coef)).cast("int")


def stratum(a1: Column, a2: Column, a3: Column) -> Column:
    chroma = F.abs(a2) + F.abs(a3)
    return F.when(chroma < 0.006, "grayscale").when(chroma < 0.007, "near_threshold").when(a1 < 0.05, "near_black").otherwise("random")


def register(spark) -> None:
    """Make the functions callable from SQL under their names."""
    @F.arrow_udf("avglf array<double>, sig array<array<short>>")
    def haar_signature(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return signed(*signatures(_stack([x, y, z], FULL), FULL))

    spark.udf.register("haar_signature", haar_signature)
    codec.register(spark)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_grayscale(a2 DOUBLE, a3 DOUBLE) RETURNS BOOLEAN RETURN abs(a2) + abs(a3) < 0.006D")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION coef_bin(coef INT) RETURNS INT RETURN least(greatest(abs(coef) div 128, abs(coef) % 128), 5)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bucket_index(channel INT, coef INT) RETURNS INT RETURN channel * 32768 + CASE WHEN coef < 0 THEN 16384 ELSE 0 END + abs(coef)")
