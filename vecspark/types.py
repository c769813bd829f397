"""Vector types as Spark types, and their validity checks.

``vector(n)`` and ``halfvec(n)`` are ``array<float>`` (half values are floats
rounded to half), ``sparsevec(n)`` is a struct with 0-based sorted indices and
``bit(n)`` is a struct of 64-bit words, first bit highest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# Fixed limits of the vector types.
MAX_DIM = 16000
MAX_SPARSE_DIM = 1_000_000_000
MAX_SPARSE_NNZ = 16000
FLOAT_MAX = 3.4028234663852886e38
HALF_MAX = 65504.0
HALF_OVERFLOW = 65520.0

VECTOR_SQL = "array<float>"
SPARSE_SQL = "struct<dim:int,indices:array<int>,values:array<float>>"
BIT_SQL = "struct<len:int,words:array<bigint>>"

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
SPARSE = T.StructType([
    T.StructField("dim", T.IntegerType()),
    T.StructField("indices", T.ArrayType(T.IntegerType(), False)),
    T.StructField("values", T.ArrayType(T.FloatType(), False)),
])
BIT = T.StructType([
    T.StructField("len", T.IntegerType()),
    T.StructField("words", T.ArrayType(T.LongType(), False)),
])


def as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it.

    A one-element array binds the value to a lambda variable; plain columns need no binding.
    """
    if re.fullmatch(r"Column<'[\w.]+(\(\))?'>", repr(value)):
        return body(value)
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_of(sql_type: str) -> Column:
    return F.lit(None).cast(sql_type)


def raising(message: Column, sql_type: str) -> Column:
    return F.raise_error(message).cast(sql_type)


def vec_lit(values) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def declared_dim(dim: int, kind: str = "vector", limit: int = MAX_DIM) -> int:
    """Validate a declared dimension such as the 3 in ``vector(3)``."""
    if isinstance(dim, bool) or not isinstance(dim, int):
        raise ValueError(f'invalid input syntax for type integer: "{dim}"')
    if dim < 1:
        raise ValueError(f"dimensions for type {kind} must be at least 1")
    if dim > limit:
        raise ValueError(f"dimensions for type {kind} cannot exceed {limit}")
    return dim


def vector_problem(v, dim: int | None = None, kind: str = "vector") -> Column:
    """Why a vector is invalid, or NULL when it is valid (a NULL vector is valid)."""
    v = as_col(v)
    out = (F.when(v.isNull(), null_of("string"))
           .when(F.size(v) < 1, F.lit(f"{kind} must have at least 1 dimension"))
           .when(F.size(v) > MAX_DIM, F.lit(f"{kind} cannot have more than {MAX_DIM} dimensions"))
           .when(F.exists(v, lambda x: x.isNull()), F.lit("array must not contain nulls"))
           .when(F.exists(v, lambda x: F.isnan(x)), F.lit(f"NaN not allowed in {kind}"))
           .when(F.exists(v, lambda x: F.abs(x) > FLOAT_MAX),
                 F.lit(f"infinite value not allowed in {kind}")))
    if dim is not None:
        declared_dim(dim, kind)
        out = out.when(F.size(v) != dim, F.concat(F.lit(f"expected {dim} dimensions, not "),
                                                  F.size(v).cast("string")))
    return out.otherwise(null_of("string"))


def vec_check(v, dim: int | None = None, kind: str = "vector") -> Column:
    """The vector itself, or an error when it breaks a rule of its type."""
    def checked(v):
        # one pass tells good vectors; what is wrong is worked out for bad ones only
        sound = (F.size(v) >= 1) & (F.size(v) <= MAX_DIM) if dim is None else F.size(v) == declared_dim(dim, kind)
        broken = F.exists(v, lambda x: ~F.coalesce(F.abs(x) <= FLOAT_MAX, F.lit(False)))
        return (F.when(v.isNull() | (sound & ~broken), v)
                .otherwise(raising(vector_problem(v, dim, kind), VECTOR_SQL)))
    return let(as_col(v), checked)


def sparse_problem(v, dim: int | None = None) -> Column:
    v = as_col(v)
    n, idx, val = v["dim"], v["indices"], v["values"]
    steps = F.zip_with(F.slice(idx, 1, F.greatest(F.size(idx) - 1, F.lit(0))),
                       F.slice(idx, 2, F.size(idx) + 1), lambda a, b: b - a)
    out = (F.when(v.isNull(), null_of("string"))
           .when(n < 1, F.lit("sparsevec must have at least 1 dimension"))
           .when(n > MAX_SPARSE_DIM, F.lit(f"sparsevec cannot have more than {MAX_SPARSE_DIM} dimensions"))
           .when(F.size(idx) != F.size(val), F.lit("sparsevec indices and values differ in number"))
           .when(F.size(idx) > MAX_SPARSE_NNZ,
                 F.lit(f"sparsevec cannot have more than {MAX_SPARSE_NNZ} non-zero elements"))
           .when(F.exists(idx, lambda i: (i < 0) | (i >= n)), F.lit("sparsevec index out of bounds"))
           .when(F.exists(steps, lambda d: d == 0), F.lit("sparsevec indices must not contain duplicates"))
           .when(F.exists(steps, lambda d: d < 0), F.lit("sparsevec indices must be in ascending order"))
           .when(F.exists(val, lambda x: F.isnan(x)), F.lit("NaN not allowed in sparsevec"))
           .when(F.exists(val, lambda x: F.abs(x) > FLOAT_MAX),
                 F.lit("infinite value not allowed in sparsevec"))
           .when(F.exists(val, lambda x: x == 0), F.lit("sparsevec values must not be zero")))
    if dim is not None:
        declared_dim(dim, "sparsevec", MAX_SPARSE_DIM)
        out = out.when(n != dim, F.concat(F.lit(f"expected {dim} dimensions, not "), n.cast("string")))
    return out.otherwise(null_of("string"))


def sparse_check(v, dim: int | None = None) -> Column:
    return let(as_col(v), lambda v: let(
        sparse_problem(v, dim),
        lambda problem: F.when(problem.isNull(), v).otherwise(raising(problem, SPARSE_SQL))))


def bits_problem(b, length: int | None = None) -> Column:
    b = as_col(b)
    out = (F.when(b.isNull(), null_of("string"))
           .when(F.size(b["words"]) != F.ceil(b["len"] / 64), F.lit("bit string words do not match its length")))
    if length is not None:
        out = out.when(b["len"] != length, F.concat(F.lit("bit string length "), b["len"].cast("string"),
                                                    F.lit(f" does not match type bit({length})")))
    return out.otherwise(null_of("string"))
