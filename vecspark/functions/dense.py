"""Dense vector functions as Spark columns.

A vector is ``array<float>``. Every function is strict (NULL in, NULL out),
sums in double precision and stays inside the JVM. Results outside the float
range become infinite, since the vector type is single precision.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vecspark.types import FLOAT_MAX, MAX_DIM, VECTOR_SQL, as_col, let, null_of, raising

NAN = float("nan")


def float_range(x: Column) -> Column:
    """Send magnitudes a float cannot hold to +-Infinity, as single precision does."""
    return (F.when(x > FLOAT_MAX, F.lit(float("inf")))
            .when(x < -FLOAT_MAX, F.lit(float("-inf"))).otherwise(x))


def paired(a, b, body, sql_type: str, kind: str = "vector") -> Column:
    """``body(a, b)`` when both vectors have one length; NULL when either is NULL; else an error."""
    def checked(a, b):
        message = F.concat(F.lit(f"different {kind} dimensions "), F.size(a).cast("string"),
                           F.lit(" and "), F.size(b).cast("string"))
        return (F.when(a.isNull() | b.isNull(), null_of(sql_type))
                .when(F.size(a) == F.size(b), body(a, b))
                .otherwise(raising(message, sql_type)))
    return let(as_col(a), lambda x: let(as_col(b), lambda y: checked(x, y)))


def fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _sum_pairs(a, b, term) -> Column:
    return fold(F.zip_with(as_col(a), as_col(b),
                           lambda x, y: term(x.cast("double"), y.cast("double"))))


def _ranged_sum(a, b, term) -> Column:
    return let(_sum_pairs(a, b, term), float_range)


def _sum_of(a, term) -> Column:
    return fold(F.transform(as_col(a), lambda x: term(x.cast("double"))))


def l2_squared_distance(a, b, kind: str = "vector") -> Column:
    return paired(a, b, lambda a, b: _ranged_sum(a, b, lambda x, y: (x - y) * (x - y)), "double", kind)


def l2_distance(a, b, kind: str = "vector") -> Column:
    return F.sqrt(l2_squared_distance(a, b, kind))


def inner_product(a, b, kind: str = "vector") -> Column:
    return paired(a, b, lambda a, b: _ranged_sum(a, b, lambda x, y: x * y), "double", kind)


def negative_inner_product(a, b, kind: str = "vector") -> Column:
    return -inner_product(a, b, kind)


def clamped_cosine(product: Column, norm_a2: Column, norm_b2: Column) -> Column:
    """Cosine distance from a product and two squared norms; NaN without a direction."""
    def measure(s):
        scale = float_range(s["na"]) * float_range(s["nb"])
        ratio = F.when(scale > 0, float_range(s["ip"]) / F.sqrt(scale)).otherwise(F.lit(NAN))
        return let(ratio, lambda r: F.when(F.isnan(r), F.lit(NAN)).otherwise(
            1 - F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))))
    return let(F.struct(product.alias("ip"), norm_a2.alias("na"), norm_b2.alias("nb")), measure)


def cosine_distance(a, b, kind: str = "vector") -> Column:
    return paired(a, b, lambda a, b: clamped_cosine(
        _sum_pairs(a, b, lambda x, y: x * y), _sum_of(a, lambda x: x * x), _sum_of(b, lambda x: x * x)), "double", kind)


def l1_distance(a, b, kind: str = "vector") -> Column:
    return paired(a, b, lambda a, b: _ranged_sum(a, b, lambda x, y: F.abs(x - y)), "double", kind)


def spherical_distance(a, b, kind: str = "vector") -> Column:
    """Angle between unit vectors as a share of a half turn."""
    ip = inner_product(a, b, kind)
    return F.acos(F.least(F.greatest(ip, F.lit(-1.0)), F.lit(1.0))) / F.pi()


def vector_dims(a) -> Column:
    return F.size(as_col(a))


def vector_norm(a) -> Column:
    return F.sqrt(_sum_of(a, lambda x: x * x))


def _checked(values: Column, limit: float = FLOAT_MAX, sql_type: str = VECTOR_SQL) -> Column:
    """Overflow check over the elements of an arithmetic result."""
    return let(values, lambda v: F.when(
        F.exists(v, lambda x: (F.abs(x) > limit) | F.isnan(x)),
        raising(F.lit("value out of range: overflow"), sql_type)).otherwise(v.cast(sql_type)))


def l2_normalize(a) -> Column:
    """Unit vector as floats; the zero vector stays as it is."""
    return let(as_col(a), lambda a: let(vector_norm(a), lambda norm: _checked(F.transform(
        a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))))))


def _elementwise(a, b, term, kind: str) -> Column:
    return paired(a, b, lambda a, b: _checked(
        F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))), VECTOR_SQL, kind)


def vector_add(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x + y, "vector")


def vector_sub(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x - y, "vector")


def vector_mul(a, b) -> Column:
    def product(a, b):
        lost = F.exists(F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0)
                                   & ((x.cast("double") * y.cast("double")).cast("float") == 0)), lambda z: z)
        out = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.when(lost, raising(F.lit("value out of range: underflow"), VECTOR_SQL)).otherwise(_checked(out))
    return paired(a, b, product, VECTOR_SQL, "vector")


def vector_concat(a, b, kind: str = "vector") -> Column:
    a, b = as_col(a), as_col(b)
    return (F.when(a.isNull() | b.isNull(), null_of(VECTOR_SQL))
            .when(F.size(a) + F.size(b) > MAX_DIM,
                  raising(F.lit(f"{kind} cannot have more than {MAX_DIM} dimensions"), VECTOR_SQL))
            .otherwise(F.concat(a, b)))


def subvector(a, start, count, kind: str = "vector") -> Column:
    """1-based slice; the end is fixed before a start below 1 is moved up to 1."""
    start, count = as_col(start), as_col(count)
    return let(as_col(a), lambda a: _slice(a, start, count, kind))


def _slice(a: Column, start: Column, count: Column, kind: str) -> Column:
    low, width = start.cast("bigint"), count.cast("bigint")
    first = F.greatest(low, F.lit(1).cast("bigint"))
    stop = F.least(low + width, F.size(a).cast("bigint") + 1)
    length = stop - first
    return (F.when(a.isNull() | start.isNull() | count.isNull(), null_of(VECTOR_SQL))
            .when((width < 1) | (length < 1),
                  raising(F.lit(f"{kind} must have at least 1 dimension"), VECTOR_SQL))
            .otherwise(F.slice(a, first.cast("int"), length.cast("int"))))


def vector_cmp(a, b) -> Column:
    """-1, 0 or 1 in lexicographic order; a prefix sorts first."""
    a, b = as_col(a), as_col(b)
    return (F.when(a.isNull() | b.isNull(), null_of("int"))
            .when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)))
