"""Sparse vectors: distances, norms, order and conversions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vecspark.functions.dense import clamped_cosine, float_range, fold
from vecspark.types import MAX_DIM, SPARSE_SQL, VECTOR_SQL, as_col, let, null_of, raising


def _entries(v: Column) -> Column:
    return F.map_from_arrays(v["indices"], v["values"])


def _paired(a, b, body) -> Column:
    def checked(a, b):
        message = F.concat(F.lit("different sparsevec dimensions "), a["dim"].cast("string"),
                           F.lit(" and "), b["dim"].cast("string"))
        return (F.when(a.isNull() | b.isNull(), null_of("double"))
                .when(a["dim"] == b["dim"], body(a, b)).otherwise(raising(message, "double")))
    return let(as_col(a), lambda x: let(as_col(b), lambda y: checked(x, y)))


def _sum_merged(a: Column, b: Column, term) -> Column:
    """Sum ``term`` over the union of both index sets, 0 standing for absent values."""
    def value(x):
        return F.coalesce(x.cast("double"), F.lit(0.0))
    merged = F.map_zip_with(_entries(a), _entries(b), lambda _, x, y: term(value(x), value(y)))
    return fold(F.map_values(merged))


def l2_squared_distance(a, b) -> Column:
    return _paired(a, b, lambda a, b: let(_sum_merged(a, b, lambda x, y: (x - y) * (x - y)), float_range))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a, b) -> Column:
    return _paired(a, b, lambda a, b: let(_sum_merged(a, b, lambda x, y: x * y), float_range))


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def _square_sum(a: Column) -> Column:
    return fold(F.transform(a["values"], lambda x: x.cast("double") * x.cast("double")))


def cosine_distance(a, b) -> Column:
    return _paired(a, b, lambda a, b: clamped_cosine(_sum_merged(a, b, lambda x, y: x * y), _square_sum(a), _square_sum(b)))


def l1_distance(a, b) -> Column:
    return _paired(a, b, lambda a, b: let(_sum_merged(a, b, lambda x, y: F.abs(x - y)), float_range))


def l2_norm(a) -> Column:
    return F.sqrt(_square_sum(as_col(a)))


def _build(dim: Column, pairs: Column) -> Column:
    """Struct from ``array<struct<i,x>>``, in index order."""
    return let(F.array_sort(pairs), lambda ordered: F.struct(
        dim.alias("dim"), F.transform(ordered, lambda p: p["i"]).alias("indices"),
        F.transform(ordered, lambda p: p["x"]).alias("values")).cast(SPARSE_SQL))


def l2_normalize(a) -> Column:
    """Unit length; entries that vanish in single precision are dropped."""
    def unit(a, norm):
        scaled = F.zip_with(a["indices"], a["values"], lambda i, x: F.struct(
            i.alias("i"), (x.cast("double") / norm).cast("float").alias("x")))
        kept = F.filter(scaled, lambda p: p["x"] != 0)
        return F.when(a.isNull(), null_of(SPARSE_SQL)).when(norm > 0, _build(a["dim"], kept)).otherwise(a)
    return let(as_col(a), lambda a: let(l2_norm(a), lambda norm: unit(a, norm)))


def dense_to_sparse(v) -> Column:
    def convert(v):
        pairs = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("float").alias("x"))),
                         lambda p: p["x"] != 0)
        return F.when(v.isNull(), null_of(SPARSE_SQL)).otherwise(_build(F.size(v), pairs))
    return let(as_col(v), convert)


def sparse_to_dense(v, kind: str = "vector") -> Column:
    def convert(v):
        body = let(_entries(v), lambda entries: F.transform(
            F.sequence(F.lit(0), v["dim"] - 1),
            lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0).cast("float"))))
        return (F.when(v.isNull(), null_of(VECTOR_SQL))
                .when(v["dim"] > MAX_DIM, raising(F.lit(f"{kind} cannot have more than {MAX_DIM} dimensions"),
                                                  VECTOR_SQL))
                .otherwise(body))
    return let(as_col(v), convert)


def sparsevec_cmp(a, b) -> Column:
    """-1, 0 or 1 in the order the dense forms would have: the order of the sort keys."""
    def compare(x, y):
        return F.when(x.isNull() | y.isNull(), null_of("int")).when(x < y, -1).when(x > y, 1).otherwise(0)
    return let(sparse_sort_key(a), lambda x: let(sparse_sort_key(b), lambda y: compare(x, y)))


def sparse_sort_key(v) -> Column:
    """A column that ``orderBy`` sorts as ``sparsevec_cmp`` does, without densifying.

    Each entry gives ``(class, place, value)`` such that the array order of the
    keys is the dense order, a shorter vector before a longer one that goes on
    from it: a negative entry sorts before an absent one (the earlier its index,
    the lower), a positive entry after (the earlier its index, the higher). The
    end of the vector lies above negative entries before it and below all that
    follow, so entries past the shorter dimension are not compared.
    """
    v = as_col(v)
    steps = F.zip_with(v["indices"], v["values"], lambda i, x: F.struct(
        F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).alias("class"),
        F.when(x < 0, 2 * i.cast("bigint") + 1).otherwise(-i.cast("bigint")).alias("place"), x.alias("x")))
    end = F.struct(F.lit(-1).alias("class"), (2 * v["dim"].cast("bigint")).alias("place"),
                   F.lit(0.0).cast("float").alias("x"))
    return F.when(v.isNotNull(), F.concat(steps, F.array(end)))
