"""Element-wise aggregates over vector columns.

With a declared dimension every element gets a scalar aggregate of its own, so
rows stay in generated code and are combined before the shuffle. Without one
(or past ``UNROLL_DIM``) elements are exploded with their position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vecspark.functions.half import round_half, to_half
from vecspark.types import FLOAT_MAX, HALF_MAX, MAX_DIM, VECTOR_SQL, as_col, declared_dim, null_of, raising

UNROLL_DIM = 256


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _mismatch(low: Column, high: Column, style: str) -> Column:
    if style == "avg":
        return F.concat(F.lit("expected "), high.cast("string"), F.lit(" dimensions, not "), low.cast("string"))
    return F.concat(F.lit("different vector dimensions "), high.cast("string"), F.lit(" and "), low.cast("string"))


def _sums(df: DataFrame, vec: str, by: list[str], dim: int | None, style: str) -> DataFrame:
    """Per group: ``__sums array<double>`` (NULL without rows) and ``__count``."""
    rows = df.select(*by, as_col(vec).alias("__v"))
    size = F.size("__v")
    if dim is not None and dim <= UNROLL_DIM:
        declared_dim(dim)
        # one expression text instead of one call per element keeps planning short
        cells = ", ".join(f"sum(double(get(__v, {i})))" for i in range(dim))
        grouped = rows.groupBy(*by).agg(F.count("__v").alias("__count"), F.min(size).alias("__low"),
                                        F.max(size).alias("__high"), F.expr(f"array({cells})").alias("__cells"))
        odd = F.when(F.col("__low") != dim, F.col("__low")).otherwise(F.col("__high"))
        wrong = (F.col("__low") != dim) | (F.col("__high") != dim)
        sums = F.col("__cells")
        message = _mismatch(odd, F.lit(dim), style)
    else:
        cells = rows.select(*by, F.size("__v").alias("__n"), F.posexplode_outer("__v").alias("__pos", "__x"))
        partial = cells.groupBy(*by, "__pos").agg(
            F.sum(F.col("__x").cast("double")).alias("__s"), F.count("__x").alias("__c"),
            F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
        cell = F.when(F.col("__pos").isNotNull(), F.struct("__pos", "__s"))
        grouped = partial.groupBy(*by).agg(
            F.array_sort(F.collect_list(cell)).alias("__cells"), F.coalesce(F.max("__c"), F.lit(0)).alias("__count"),
            F.min("__lo").alias("__low"), F.max("__hi").alias("__high"))
        wrong = F.col("__low") != F.col("__high")
        sums = F.transform("__cells", lambda c: c["__s"])
        message = _mismatch(F.col("__low"), F.col("__high"), style)
        if dim is not None:
            wrong = wrong | (F.col("__high") != declared_dim(dim))
    return grouped.select(*by, "__count", F.when(F.col("__count") == 0, null_of("array<double>"))
                          .when(wrong, raising(message, "array<double>")).otherwise(sums).alias("__sums"))


def vec_avg(df: DataFrame, vec: str, by=None, dim: int | None = None, alias: str = "avg") -> DataFrame:
    """Element-wise mean per group; NULL vectors are skipped, none at all gives NULL."""
    by = _keys(by)
    out = _sums(df, vec, by, dim, "avg")
    mean = F.transform("__sums", lambda x: (x / F.col("__count")).cast("float"))
    return out.select(*by, mean.alias(alias))


def _ranged(values: Column, limit: float) -> Column:
    return (F.when(F.exists(values, lambda x: F.abs(x) > limit),
                   raising(F.lit("value out of range: overflow"), VECTOR_SQL)).otherwise(values.cast(VECTOR_SQL)))


def vec_sum(df: DataFrame, vec: str, by=None, dim: int | None = None, alias: str = "sum") -> DataFrame:
    """Element-wise sum per group, added in double precision; overflow is an error."""
    by = _keys(by)
    out = _sums(df, vec, by, dim, "sum")
    return out.select(*by, _ranged(F.col("__sums"), FLOAT_MAX).alias(alias))


def half_avg(df: DataFrame, vec: str, by=None, dim: int | None = None, alias: str = "avg") -> DataFrame:
    by = _keys(by)
    return vec_avg(df, vec, by, dim, "__a").select(*by, to_half("__a").alias(alias))


def half_sum(df: DataFrame, vec: str, by=None, dim: int | None = None, alias: str = "sum") -> DataFrame:
    """Sum rounded to half once, at the end; past the half range it is an error."""
    by = _keys(by)
    rounded = F.transform("__sums", round_half)
    return _sums(df, vec, by, dim, "sum").select(*by, _ranged(rounded, HALF_MAX).alias(alias))


def vec_from_rows(df: DataFrame, value: str, position: str, by=None, alias: str = "vec") -> DataFrame:
    """Build a vector from rows, ordered by ``position``; more than 16000 per group are an error.

    Groups are counted first, so one that is too large fails before it is gathered.
    """
    by = _keys(by)
    too_large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > MAX_DIM)
    rows = df.select(*by, F.col(position).alias("__p"), F.col(value).cast("float").alias("__x"))
    rows = rows.join(too_large, by, "left") if by else rows.join(too_large, F.lit(True), "left")
    cell = F.when(F.col("__n").isNotNull(), raising(
        F.lit(f"vector cannot have more than {MAX_DIM} dimensions"), f"struct<p:{dict(df.dtypes)[position]},x:float>")).otherwise(
        F.struct(F.col("__p").alias("p"), F.col("__x").alias("x")))
    cells = rows.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("__cells"))
    return cells.select(*by, F.transform("__cells", lambda c: c["x"]).alias(alias))
