"""Scalar functions against known values."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import error_of, value
from vecspark.functions import bits, casts, dense, half, sparse, text
from vecspark.functions.sql import register_sql_functions
from vecspark.types import sparse_check, vec_check, vec_lit

V = vec_lit

DENSE = [
    (dense.l2_distance(V([1, 1]), V([6, 13])), 13.0),
    (dense.l2_distance(V([2e38]), V([-2e38])), math.inf),
    (dense.l2_distance(V([2] * 11), V([2] * 9 + [5, 6])), 5.0),
    (dense.l2_squared_distance(V([0, 1]), V([2, 4])), 13.0),
    (dense.inner_product(V([2, 5]), V([7, -1])), 9.0),
    (dense.inner_product(V([2e38]), V([2e38])), math.inf),
    (dense.negative_inner_product(V([2, 5]), V([7, -1])), -9.0),
    (dense.cosine_distance(V([2, 3]), V([4, 6])), 0.0),
    (dense.cosine_distance(V([5, 1]), V([0, 0])), math.nan),
    (dense.cosine_distance(V([3, 0]), V([0, 7])), 1.0),
    (dense.cosine_distance(V([2, 2]), V([-3, -3])), 2.0),
    (dense.cosine_distance(V([2e38]), V([2e38])), math.nan),
    (dense.l1_distance(V([1, -2]), V([4, 2])), 7.0),
    (dense.l1_distance(V([2e38]), V([-2e38])), math.inf),
    (dense.spherical_distance(V([0, 1]), V([1, 0])), 0.5),
    (dense.vector_dims(V([4, 5, 6, 7])), 4),
    (dense.vector_norm(V([5, 12])), 13.0),
    (dense.vector_norm(V([0, 0, 0])), 0.0),
    (dense.l2_normalize(V([6, 8])), [0.6, 0.8]),
    (dense.l2_normalize(V([0, 0, 0])), [0.0, 0.0, 0.0]),
    (dense.l2_normalize(V([2e38])), [1.0]),
    (dense.vector_add(V([2, 4, 6]), V([1, 1, 5])), [3, 5, 11]),
    (dense.vector_sub(V([2, 4, 6]), V([1, 1, 5])), [1, 3, 1]),
    (dense.vector_mul(V([2, 4, 6]), V([1, 1, 5])), [2, 4, 30]),
    (dense.vector_concat(V([7, 8]), V([9])), [7, 8, 9]),
    (bits.bits_to_text(bits.binary_quantize(V([2, 0, -3]))), "100"),
    (bits.bits_to_text(bits.binary_quantize(V([.3, -.1, .2, 0, -.4, .9, .8, -.5, .1]))), "101001101"),
    (dense.vector_cmp(V([4, 5]), V([4, 5, 6])), -1),
    (dense.vector_cmp(V([5]), V([4, 5, 6])), 1),
    (dense.vector_cmp(V([4, 5, 6]), V([4, 5, 6])), 0),
    (V([4, 5, 6]) > V([4, 5]), True),
]


def same(got, want):
    if isinstance(want, list):
        return np.allclose(got, want, rtol=1e-6)
    if isinstance(want, float):
        return math.isnan(got) if math.isnan(want) else got == pytest.approx(want, rel=1e-9, abs=1e-7)
    return got == want


def check_all(spark, cases):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    wrong = [(i, row[i], want) for i, (_, want) in enumerate(cases) if not same(row[i], want)]
    assert not wrong


def test_dense(spark):
    check_all(spark, DENSE)


@pytest.mark.parametrize("start,count,want", [(1, 3, [1, 2, 3]), (3, 2, [3, 4]), (-1, 3, [1]), (3, 9, [3, 4, 5]),
                                              (3, 2147483647, [3, 4, 5]), (-2147483644, 2147483647, [1, 2])])
def test_subvector(spark, start, count, want):
    assert value(spark, dense.subvector(V([1, 2, 3, 4, 5]), F.lit(start), F.lit(count))) == want


@pytest.mark.parametrize("column,message", [
    (dense.l2_distance(V([1, 2]), V([3])), "different vector dimensions 2 and 1"),
    (dense.cosine_distance(V([1, 2]), V([3])), "different vector dimensions 2 and 1"),
    (dense.vector_add(V([3e38]), V([3e38])), "value out of range: overflow"),
    (dense.vector_sub(V([-3e38]), V([3e38])), "value out of range: overflow"),
    (dense.vector_mul(V([1e37]), V([1e37])), "value out of range: overflow"),
    (dense.vector_mul(V([1e-37]), V([1e-37])), "value out of range: underflow"),
    (dense.vector_concat(F.array_repeat(F.lit(0.0).cast("float"), 16000), V([1])), "more than 16000 dimensions"),
    (dense.subvector(V([1, 2]), F.lit(1), F.lit(0)), "must have at least 1 dimension"),
    (dense.subvector(V([1, 2]), F.lit(2147483647), F.lit(10)), "must have at least 1 dimension"),
    (half.halfvec_add(V([65504]), V([65504])), "value out of range: overflow"),
    (half.halfvec_mul(V([1e-7]), V([1e-7])), "value out of range: underflow"),
    (half.to_half(V([65520])), '"65520" is out of range for type halfvec'),
    (half.l2_distance(V([1, 2]), V([3])), "different halfvec dimensions 2 and 1"),
    (bits.hamming_distance(bits.bits_from_text(F.lit("111")), bits.bits_from_text(F.lit("00"))), "different bit lengths 3 and 2"),
    (vec_check(V([1, 2, 3]), 2), "expected 2 dimensions, not 3"),
    (casts.to_vector(F.array(F.lit(1.0), F.lit(None).cast("double"))), "array must not contain nulls"),
    (casts.to_vector(F.array(F.lit(float("nan")))), "NaN not allowed in vector"),
    (casts.to_vector(F.array(F.lit(4e38))), "infinite value not allowed in vector"),
    (casts.to_vector(F.array().cast("array<double>")), "vector must have at least 1 dimension"),
])
def test_errors(spark, column, message):
    assert message in error_of(spark, column)


def test_nulls_in_nulls_out(spark):
    none = F.lit(None).cast("array<float>")
    cases = [f(none, V([1])) for f in (dense.l2_distance, dense.inner_product, dense.cosine_distance, dense.l1_distance,
                                       dense.vector_add, dense.vector_mul, dense.vector_concat, dense.vector_cmp)]
    cases += [dense.vector_norm(none), dense.vector_dims(none), dense.l2_normalize(none), bits.binary_quantize(none),
              half.to_half(none), dense.subvector(none, F.lit(1), F.lit(1)), vec_check(none), text.format_vector(none)]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert all(x is None for x in row)


def test_half_rounding_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 10 ** rng.uniform(-8, 4.5, 4000)), [1e-8, -1e-8, 65519, 6e-8, 0.0, 2 ** -24]])
    x = x[np.abs(x) < 65500].astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select(half.round_half(F.col("x").cast("float")))
    got = np.array([r[0] for r in df.collect()])
    assert np.array_equal(got, x.astype(np.float16).astype(np.float64))
    assert math.copysign(1, value(spark, half.to_half(V([-1e-8])))[0]) == -1


BITS = [("111", "111", 0, 0.0), ("111", "110", 1, 1 / 3), ("1111", "0000", 4, 1.0), ("0000", "0000", 0, 1.0),
        ("1100", "1000", 1, 0.5), ("10" * 10, "01" * 10, 20, 1.0), ("10" * 256 + "1", "01" * 256 + "0", 513, 1.0), ("", "", 0, 1.0)]


def test_bits(spark):
    rows = spark.createDataFrame(BITS, "a string, b string, h int, j double").select(
        "a", "h", "j", bits.bits_from_text("a").alias("x"), bits.bits_from_text("b").alias("y"))
    for r in rows.select("a", "h", "j", bits.bits_to_text("x").alias("t"), bits.hamming_distance("x", "y").alias("hd"),
                         bits.jaccard_distance("x", "y").alias("jd")).collect():
        assert r.t == r.a and r.hd == r.h and r.jd == pytest.approx(r.j)


def S(spark_text):
    return text.parse_sparsevec(F.lit(spark_text))["value"]


def test_sparse(spark):
    check_all(spark, [
        (sparse.l2_distance(S("{1:3}/2"), S("{2:4}/2")), 5.0),
        (sparse.l2_distance(S("{}/2"), S("{1:3,2:4}/2")), 5.0),
        (sparse.inner_product(S("{1:1,3:3,5:5}/5"), S("{2:4,3:6,4:8}/5")), 18.0),
        (sparse.inner_product(S("{1:3e38}/1"), S("{1:3e38}/1")), math.inf),
        (sparse.cosine_distance(S("{1:1,2:2}/2"), S("{}/2")), math.nan),
        (sparse.cosine_distance(S("{1:1,2:1}/2"), S("{1:-1.1,2:-1.1}/2")), 2.0),
        (sparse.l1_distance(S("{1:1,3:3,5:5,7:7}/8"), S("{2:2,4:4,6:6,8:8}/8")), 36.0),
        (sparse.l2_norm(S("{1:3,2:4}/2")), 5.0),
        (text.format_sparsevec(sparse.l2_normalize(S("{1:3,2:4}/2"))), "{1:0.6,2:0.8}/2"),
        (text.format_sparsevec(sparse.l2_normalize(S("{}/2"))), "{}/2"),
        (sparse.sparsevec_cmp(S("{1:1,2:2}/2"), S("{1:1,2:2,3:3}/3")), -1),
        (sparse.sparsevec_cmp(S("{1:2,2:3}/2"), S("{1:1,2:2,3:3}/3")), 1),
        (sparse.sparsevec_cmp(S("{}/3"), S("{1:-1}/3")), 1),
        (sparse.sparsevec_cmp(S("{2:5}/3"), S("{3:9}/3")), 1),
        (sparse.sparsevec_cmp(S("{}/3"), S("{}/3")), 0),
        (text.format_sparsevec(sparse.dense_to_sparse(V([0, 1.5, 0, 3.5, 0]))), "{2:1.5,4:3.5}/5"),
        (casts.sparse_to_vector(S("{2:1.5,4:3.5}/5"), 5), [0, 1.5, 0, 3.5, 0]),
    ])
    assert "different sparsevec dimensions 2 and 1" in error_of(spark, sparse.l2_distance(S("{}/2"), S("{}/1")))
    assert "more than 16000 dimensions" in error_of(spark, casts.sparse_to_vector(S("{}/16001")))


def test_sparse_check_rejects(spark):
    bad = [("struct(2, array(0, 0), array(1f, 1f))", "duplicates"), ("struct(2, array(1, 0), array(1f, 1f))", "ascending"),
           ("struct(1, array(1), array(1f))", "out of bounds"), ("struct(2, array(0), array(0f))", "must not be zero")]
    for sql, message in bad:
        column = F.expr(sql).cast("struct<dim:int,indices:array<int>,values:array<float>>")
        assert message in error_of(spark, sparse_check(column))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(-2, 2), min_size=5, max_size=5), min_size=2, max_size=12))
def test_types_agree_and_order_matches(spark, rows):
    """Sparse, half and dense distances agree, and sparse order is dense order."""
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "i int, v array<float>")
    q = V([float(x) for x in rows[0]])
    df = df.withColumn("s", sparse.dense_to_sparse("v")).withColumn("sq", sparse.dense_to_sparse(q))
    out = df.select("i", dense.l2_distance("v", q).alias("d"), sparse.l2_distance("s", "sq").alias("sd"),
                    half.l2_distance(half.to_half("v"), half.to_half(q)).alias("hd"), dense.vector_cmp("v", q).alias("c"),
                    sparse.sparsevec_cmp("s", "sq").alias("sc"), sparse.sparse_sort_key("s").alias("k")).collect()
    assert all(r.d == r.sd == r.hd and r.c == r.sc for r in out)
    by_key = [r.i for r in df.orderBy(sparse.sparse_sort_key("s"), "i").collect()]
    assert by_key == sorted(range(len(rows)), key=lambda i: (rows[i], i))


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql("SELECT vec_l2_distance(array(0f, 0f), array(3f, 4f)) a, vec_cosine_distance(array(1f, 2f), array(0f, 0f)) b,"
                    " vec_l1_distance(array(0f, 0f), array(3f, 4f)) c, vec_dims(array(1f)) d, vec_cmp(array(1f), array(2f)) e,"
                    " vec_l2_distance(array(1f), CAST(NULL AS ARRAY<FLOAT>)) f").first()
    assert (row.a, row.c, row.d, row.e, row.f) == (5.0, 7.0, 1, -1, None) and math.isnan(row.b)


def test_every_sql_function_is_its_column_function(spark):
    """Under its SQL name a function gives what the column function gives, for every one of them."""
    from vecspark.functions.sql import _TYPES, FUNCTIONS
    register_sql_functions(spark)
    assert len(FUNCTIONS) > 50
    rows = [([0.5, -1.25, 0.0, 7.0], [0.25, 3.0, -2.0, 0.0]), ([0.0] * 4, [1.0, 0.0, 0.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, f"{'p ' + _TYPES['v']}, {'q ' + _TYPES['v']}")
    forms = {"v": ["p", "q"], "s": [sparse.dense_to_sparse(c) for c in ("p", "q")], "b": [bits.binary_quantize(c) for c in ("p", "q")],
             "i": [F.lit(2), F.lit(2)], "t": [F.lit("0110"), F.lit("1")], "d": [F.col(c).cast("array<double>") for c in ("p", "q")]}
    for c in ("p", "q"):
        i = "pq".index(c)
        df = df.withColumns({f"{c}_{kind}": F.col(forms[kind][i]) if kind == "v" else forms[kind][i] for kind in "sbtd"})
    df = df.withColumns({"p_v": F.col("p"), "q_v": F.col("q")}).cache()
    wanted, named = [], []
    for name, (kinds, function) in FUNCTIONS.items():
        args = [f"{'pq'[min(n, 1)]}_{kind}" if kind != "i" else "2" for n, kind in enumerate(kinds)]
        wanted.append(function(*(F.lit(2) if a == "2" else F.col(a) for a in args)).alias(name))
        named.append(F.expr(f"{name}({', '.join(args)})").alias(name))
    assert repr(df.select(*wanted).collect()) == repr(df.select(*named).collect())
