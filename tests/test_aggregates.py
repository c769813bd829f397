"""Vector aggregates."""

import pytest

from vecspark.operators.aggregates import half_avg, half_sum, vec_avg, vec_from_rows, vec_sum


def rows(spark, values, key="a"):
    return spark.createDataFrame([(key, v) for v in values], "k string, v array<float>")


@pytest.mark.parametrize("dim", [None, 3])
def test_avg_and_sum(spark, dim):
    df = rows(spark, [[1.0, 2.0, 3.0], [3.0, 5.0, 7.0], None])
    assert vec_avg(df, "v", dim=dim).first()[0] == [2, 3.5, 5]
    assert vec_sum(df, "v", dim=dim).first()[0] == [4, 7, 10]
    assert half_avg(df, "v", dim=dim).first()[0] == [2, 3.5, 5]
    assert half_sum(df, "v", "k", dim=dim).first()[1] == [4, 7, 10]


@pytest.mark.parametrize("dim", [None, 3])
def test_empty_and_null_groups(spark, dim):
    assert vec_avg(rows(spark, []), "v", dim=dim).first()[0] is None
    both = rows(spark, [None], "n").union(rows(spark, [[1.0, 2.0, 3.0]]))
    assert {r.k: r.avg for r in vec_avg(both, "v", "k", dim).collect()} == {"n": None, "a": [1, 2, 3]}


def test_ranges_and_mismatch(spark):
    big = rows(spark, [[3e38], [3e38]])
    assert vec_avg(big, "v", dim=1).first()[0] == pytest.approx([3e38])
    with pytest.raises(Exception, match="value out of range: overflow"):
        vec_sum(big, "v", dim=1).collect()
    mixed = rows(spark, [[1.0, 2.0], [3.0]])
    with pytest.raises(Exception, match="expected 2 dimensions, not 1"):
        vec_avg(mixed, "v", dim=2).collect()
    with pytest.raises(Exception, match="expected 2 dimensions, not 1"):
        vec_avg(mixed, "v").collect()
    with pytest.raises(Exception, match="different vector dimensions 2 and 1"):
        vec_sum(mixed, "v").collect()
    with pytest.raises(Exception, match="value out of range: overflow"):
        half_sum(rows(spark, [[60000.0], [60000.0]]), "v").collect()


def test_groups_may_differ_in_dimension(spark):
    df = rows(spark, [[1.0]], "a").union(rows(spark, [[1.0, 2.0]], "b"))
    assert {r.k: r.avg for r in vec_avg(df, "v", "k").collect()} == {"a": [1], "b": [1, 2]}


def test_vector_from_rows(spark):
    df = spark.createDataFrame([(2, 20.0), (1, 10.0), (3, 30.0)], "i int, x double")
    assert vec_from_rows(df, "x", "i").first()[0] == [10, 20, 30]
    with pytest.raises(Exception, match="cannot have more than 16000 dimensions"):
        vec_from_rows(spark.range(16001), "id", "id").collect()


def test_partial_aggregation_before_the_shuffle(spark, embeddings):
    plan = vec_avg(embeddings, "embedding", "label", 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 or plan.count("Aggregate(") >= 2
