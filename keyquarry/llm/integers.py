"""Integer vectors: which rows hold numbers only, their scaled components, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def finite(vector: Column) -> Column:
    """Whether a vector (array of double) is there and all its components are numbers; false for a null vector or component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(column: pa.ListArray, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the vectors of ``dims`` components, their components as floor(scale * x)).

    The vectors must be free of nulls.  Raises if a sum of squared differences could pass 63 bits.
    """
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff(offsets) == dims)
    parts = np.floor(values[offsets[at][:, None] + np.arange(dims)] * float(scale))
    if len(at) and 4.0 * dims * float(np.abs(parts).max(initial=0)) ** 2 >= 2.0 ** 63:
        raise OverflowError(f"squared distances of vectors with components of {np.abs(parts).max() / scale:g} do not fit 64 bits")
    return at, parts.astype(np.int64)


def limbs(a: np.ndarray, width: int) -> list[np.ndarray]:
    """``a`` as the sum of limbs times powers of 2**width, lowest first; all but the last are not negative, all are under 2**width in size."""
    out = []
    while len(a) and int(np.abs(a).max(initial=0)) >= 1 << width:
        out.append((a & ((1 << width) - 1)).astype(np.float64))
        a = a >> width
    return [*out, a.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray, width: int | None = None) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exactly.

    Limbs are so narrow that a sum of products of two of them stays under 2**53, so a
    float64 matrix product of limbs has no rounding; the parts are put together as 64-bit integers.
    """
    dims = a.shape[1]
    width = width or (53 - (dims - 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << width * (i + j)
    return out


def packed_products(a: np.ndarray, b: np.ndarray, bits: int = 53) -> np.ndarray:
    """All inner products of the rows of two integer matrices, several rows of ``b`` by one multiplication.

    The rows of ``b`` are biased to be not negative and laid side by side as fields of one
    integer of at most ``bits`` bits, which a float64 holds exactly.  A field is wide
    enough for any sum and its sign, so one product of a component of ``a`` and a wide
    integer serves all its fields, and what is read from a field is a whole score.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bias = int(b.min())
    most = int(np.abs(a).sum(1).max()) * (int(b.max()) - bias)
    width = most.bit_length() + 1
    fields = bits // width
    if not fields:      # not even one sum fits: 64-bit integers
        return a @ b.T
    filled = np.zeros((-len(b) % fields + len(b), b.shape[1]), np.int64)
    filled[:len(b)] = b - bias
    wide = filled[::fields].copy()
    for f in range(1, fields):
        wide += filled[f::fields] << width * f
    half = 1 << width - 1
    sums = (a.astype(np.float64) @ wide.astype(np.float64).T).astype(np.int64)
    sums += sum(half << width * f for f in range(fields))       # no field is negative now
    out = np.empty((len(a), len(filled)), np.int64)
    for f in range(fields):
        out[:, f::fields] = (sums >> width * f) & ((1 << width) - 1)
    out += (bias * a.sum(1) - half)[:, None]
    return out[:, :len(b)]
