"""Conversions between arrays and the vector types."""

from __future__ import annotations

from pyspark.sql import Column

from vecspark.functions.half import half_check, to_half
from vecspark.functions.sparse import dense_to_sparse, sparse_to_dense
from vecspark.types import as_col, vec_check


def to_vector(array, dim: int | None = None) -> Column:
    """``array<int|float|double|decimal>`` to a vector; checked after narrowing to float."""
    return vec_check(as_col(array).cast("array<float>"), dim)


def to_halfvec(array, dim: int | None = None) -> Column:
    return to_half(half_check(as_col(array).cast("array<float>"), dim))


def to_sparsevec(array, dim: int | None = None) -> Column:
    # what a checked dense vector becomes is a valid sparse one
    return dense_to_sparse(vec_check(as_col(array).cast("array<float>"), dim))


def sparse_to_vector(v, dim: int | None = None) -> Column:
    return vec_check(sparse_to_dense(v), dim)


def sparse_to_halfvec(v, dim: int | None = None) -> Column:
    return to_half(half_check(sparse_to_dense(v, "halfvec"), dim))


def to_array(v) -> Column:
    """A vector as a plain ``array<float>``."""
    return as_col(v).cast("array<float>")


__all__ = ["to_vector", "to_halfvec", "to_sparsevec", "sparse_to_vector", "sparse_to_halfvec",
           "to_array"]
