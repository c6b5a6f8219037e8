"""Vector expressions over ARRAY columns: all JVM-side, computed in DOUBLE, folded left to right."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sqr_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(double(a), double(b), lambda x, y: x * y))


def sqr_norm(v: Column) -> Column:
    return total(F.transform(double(v), lambda x: x * x))


def norm(v: Column) -> Column:
    return F.sqrt(sqr_norm(v))


def normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(double(v), lambda x: x / n)).otherwise(double(v))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(double(a), double(b), lambda x, y: x + y)


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(double(v), lambda x: x / by)


def residual(x: Column, c: Column) -> Column:
    return F.zip_with(double(x), double(c), lambda a, b: a - b)


def pad(v: Column, size: int) -> Column:
    """Zeros appended up to ``size`` entries."""
    return F.concat(double(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(v), F.lit(0))))


def code_dim(dim: int) -> int:
    """Bits of a sign code: the next multiple of 64."""
    return -(-dim // 64) * 64


def has_inf(v: Column) -> Column:
    return F.exists(v, lambda x: F.abs(x) == float("inf"))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix_literal(rows: np.ndarray) -> Column:
    """A constant array<array<double>>, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(np.asarray(rows, float).tolist())), "array<array<double>>")


def hadamard(dim: int) -> Column:
    """Rows of the dim x dim Hadamard rotation (dim a power of two), from the parity of common bits."""
    value = 1.0 / dim**0.5
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, F.lit(value)).otherwise(F.lit(-value))),
    )


def rotate(v: Column, columns: Column) -> Column:
    """v as a row vector times the matrix with these columns."""
    return F.transform(columns, lambda column: dot(v, column))


def sign_bits(r: Column) -> Column:
    return F.transform(r, lambda x: (x > 0).cast("long"))


def sign_words(r: Column) -> Column:
    """64-bit words of the signs of r, entry 0 in the most significant bit of word 0."""
    bits = sign_bits(r)
    words = F.sequence(F.lit(0), (F.size(r) / 64).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 64 + 1, 64), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b)))


def popcount(code: Column) -> Column:
    return F.aggregate(code, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def binary_dot(a: Column, b: Column) -> Column:
    """Common set bits of two codes."""
    return popcount(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def bit_planes(q: Column, bits: int = 4) -> Column:
    """The code of every bit of small integers q, lowest bit first."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: sign_words(F.transform(q, lambda x: F.call_function("shiftright", x.cast("long"), i).bitwiseAND(F.lit(1).cast("long")))))


def byte_binary_dot(planes: Column, code: Column) -> Column:
    """Sum over bit planes of common bits times two to the plane: the dot product of integers and bits."""
    return F.aggregate(
        F.transform(planes, lambda p, i: F.call_function("shiftleft", binary_dot(p, code).cast("long"), i)), F.lit(0).cast("long"), lambda acc, x: acc + x
    )


def quantize(t: Column, low: Column, width: Column, dither: float = 0.5) -> Column:
    """floor((t - low) / width + dither); all zeros where the vector is constant."""
    return F.transform(t, lambda x: F.when(width > 0, F.floor((x - low) / width + dither)).otherwise(F.lit(0)).cast("int"))


def bucket_code(d: Column, low: Column, delta: Column, buckets: int) -> Column:
    """The equal-width bucket of a distance, clamped to 0..buckets-1."""
    return F.when(delta > 0, F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((d - low) / delta).cast("int")))).otherwise(F.lit(0))
