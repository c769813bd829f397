"""Half-precision vectors: ``array<float>`` whose values are rounded to half."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vecspark.functions import dense
from vecspark.types import HALF_MAX, HALF_OVERFLOW, VECTOR_SQL, as_col, let, null_of, raising, vec_check


def round_half(x: Column) -> Column:
    """Nearest half value, ties to even; magnitudes past the range become infinite."""
    def nearest(x):
        exponent = F.greatest(F.floor(F.log2(F.abs(x)) + 1e-12).cast("double"), F.lit(-14.0))
        rounded = let(F.pow(F.lit(2.0), exponent - 10), lambda unit: F.bround(x / unit) * unit)
        return (F.when((x == 0) | F.isnan(x), x)
                .when(F.abs(x) >= HALF_OVERFLOW, F.signum(x) * F.lit(float("inf")))
                # the product with zero keeps the sign of a value that vanishes
                .otherwise(let(rounded, lambda r: F.when(r == 0, x * 0.0).otherwise(r))))
    return let(x.cast("double"), nearest)


def to_half(v) -> Column:
    """Round every element to half; a value past the range is an error."""
    def convert(v):
        over = F.get(F.filter(v, lambda x: F.abs(x) >= HALF_OVERFLOW), F.lit(0))
        message = F.concat(F.lit('"'), F.regexp_replace(over.cast("string"), r"\.0$", ""),
                           F.lit('" is out of range for type halfvec'))
        return (F.when(v.isNull(), null_of(VECTOR_SQL)).when(over.isNotNull(), raising(message, VECTOR_SQL))
                .otherwise(F.transform(v, lambda x: round_half(x).cast("float"))))
    return let(as_col(v), convert)


def half_check(v, dim: int | None = None) -> Column:
    return vec_check(v, dim, "halfvec")


def l2_distance(a, b) -> Column:
    return dense.l2_distance(a, b, "halfvec")


def l2_squared_distance(a, b) -> Column:
    return dense.l2_squared_distance(a, b, "halfvec")


def inner_product(a, b) -> Column:
    return dense.inner_product(a, b, "halfvec")


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def cosine_distance(a, b) -> Column:
    return dense.cosine_distance(a, b, "halfvec")


def spherical_distance(a, b) -> Column:
    return dense.spherical_distance(a, b, "halfvec")


def l1_distance(a, b) -> Column:
    return dense.l1_distance(a, b, "halfvec")


vector_dims = dense.vector_dims
l2_norm = dense.vector_norm
halfvec_cmp = dense.vector_cmp


def l2_normalize(a) -> Column:
    return F.transform(dense.l2_normalize(a), lambda x: round_half(x).cast("float"))


def _arith(a, b, term, underflow: bool = False) -> Column:
    def combine(a, b):
        out = F.zip_with(a, b, lambda x, y: round_half(term(x.cast("double"), y.cast("double"))))
        return let(out, lambda out: ranged(a, b, out))

    def ranged(a, b, out):
        body = F.when(F.exists(out, lambda x: F.abs(x) > HALF_MAX),
                      raising(F.lit("value out of range: overflow"), VECTOR_SQL))
        if underflow:
            nonzero = F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0))
            lost = F.exists(F.zip_with(nonzero, out, lambda on, z: on & (z == 0)), lambda z: z)
            body = body.when(lost, raising(F.lit("value out of range: underflow"), VECTOR_SQL))
        return body.otherwise(out.cast(VECTOR_SQL))

    return dense.paired(a, b, combine, VECTOR_SQL, "halfvec")


def halfvec_add(a, b) -> Column:
    return _arith(a, b, lambda x, y: x + y)


def halfvec_sub(a, b) -> Column:
    return _arith(a, b, lambda x, y: x - y)


def halfvec_mul(a, b) -> Column:
    return _arith(a, b, lambda x, y: x * y, underflow=True)


def halfvec_concat(a, b) -> Column:
    return dense.vector_concat(a, b, "halfvec")


def subvector(a, start, count) -> Column:
    return dense.subvector(a, start, count, "halfvec")
