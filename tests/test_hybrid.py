"""Predicates, strictness, routing and the advisor."""

import pytest
from pyspark.sql import functions as F

from vecspark.operators.evaluate import compare, folder_bytes, recall_per_query
from vecspark.operators.hybrid import (advise, hybrid_search, log_decision, post_filter_knn, post_filter_widening, predicate,
                                       route, strictness)
from vecspark.operators.knn import knn_join
from vecspark.plans.ivf import IvfIndex
from vecspark.sources.tables import assign_labels, random_vectors, sample_queries


@pytest.fixture(scope="module")
def docs(spark):
    """1000 documents: categories 100/850/50, one author 10 times."""
    base = random_vectors(spark, 1000, 3, seed=5)
    category = F.when(F.col("id") < 100, "Math").when(F.col("id") < 950, "Computer Science").otherwise("Physics")
    author = F.when(F.col("id") % 100 == 0, "Srinivasa Ramanujan").otherwise("Someone")
    return base.withColumn("category", category).withColumn("author", author).cache()


@pytest.fixture(scope="module")
def index(docs):
    return IvfIndex.build(docs, "l2", 10)


def test_predicate(docs):
    assert docs.filter(predicate({})).count() == 1000
    assert docs.filter(predicate({"category": "Physics"})).count() == 50
    assert docs.filter(predicate({"category": "Computer Science", "id >": 500})).count() == 449
    assert docs.filter(predicate({"author like": "%Ramanujan%"})).count() == 10
    with pytest.raises(ValueError):
        predicate({"id ; drop": 1})


@pytest.mark.parametrize("filters,path,ef", [({"category": "Computer Science"}, "vector_first", 40),
                                             ({"id >": 500}, "vector_first", 200),
                                             ({"author": "Srinivasa Ramanujan"}, "filter_first", None)])
def test_router_bands(spark, docs, index, filters, path, ef):
    q = spark.createDataFrame([(0, [0.1, 0.2, 0.3])], "query_id int, embedding array<float>")
    result = hybrid_search(index, q, filters, 10)
    assert (result.path, result.ef) == (path, ef)
    assert result.strictness == pytest.approx(1 - docs.filter(predicate(filters)).count() / 1000)
    rows = result.rows.collect()
    assert rows and all(r.similarity == pytest.approx(1 - r.distance) for r in rows)
    assert log_decision(filters, result)[2] == path


def test_strictness_edges(docs):
    assert strictness(docs.filter("id < 0"), predicate({"id": 1})) == 0.0
    assert 0 <= strictness(docs, predicate({"id >": 500}), sample=0.3) <= 1
    assert [route(x)[0] for x in (0.8, 0.79, 0.3, 0.0)] == ["filter_first"] + ["vector_first"] * 3
    assert [route(x)[1] for x in (0.79, 0.3, 0.29)] == [200, 200, 40]


def test_post_filter_may_be_short_and_widening_is_not(spark, docs, index):
    q = spark.createDataFrame([(0, [0.1, 0.2, 0.3]), (1, [0.9, 0.2, 0.6])], "query_id int, embedding array<float>")
    where = predicate({"author": "Srinivasa Ramanujan"})
    assert post_filter_knn(index, q, where, ["author"], 10, 20, 1).count() < 20
    wide = post_filter_widening(index, q, where, ["author"], 10, 20, 1)
    cols = ["query_id", "id", "rank"]
    assert wide.select(*cols).exceptAll(knn_join(docs.filter(where), q, 10).select(*cols)).isEmpty()
    assert wide.count() == 20


def test_advisor_and_reports(spark, index):
    log = spark.createDataFrame([("a", 0.9, "filter_first"), ("a", 0.95, "filter_first"), ("b", 0.9, "filter_first"),
                                 ("c", 0.1, "vector_first"), ("c", 0.1, "vector_first")], "pattern string, strictness double, path string")
    assert [r.pattern for r in advise(log).collect()] == ["a"]
    assert compare(log, log).count() == 10 and folder_bytes(spark, index.path) > 0


def test_recall_per_query(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "query_id int, id int")
    found = spark.createDataFrame([(0, 1), (0, 9)], "query_id int, id int")
    assert {r.query_id: r.recall for r in recall_per_query(found, truth, "query_id", "id").collect()} == {0: 0.5, 1: 0.0}


def test_labels_and_samples(spark, docs):
    half = docs.withColumn("tag", F.when(F.col("id") < 500, F.lit(99)))
    tags = assign_labels(half, "tag", 12)
    assert tags.filter("id < 500 AND tag <> 99").isEmpty()
    assert tags.filter("id >= 500 AND (tag < 1 OR tag > 12)").isEmpty()
    assert sample_queries(docs, 20).count() == 20


def test_router_over_either_index(spark, docs, index):
    """A vector-first search that the filter leaves short goes on, over lists and over a graph."""
    from vecspark.plans.graph import GraphIndex
    q = spark.createDataFrame([(0, [0.1, 0.2, 0.3]), (1, [0.9, 0.2, 0.6])], "query_id int, embedding array<float>")
    filters = {"id >=": 400, "author": "Someone"}
    where = predicate(filters)
    truth = knn_join(docs.filter(where), q, 10)
    for one in (index, GraphIndex.build(docs, m=8)):
        result = hybrid_search(one, q, filters, 10)
        assert (result.path, result.ef) == ("vector_first", 200)
        assert result.rows.count() == 20 and result.rows.join(docs.filter(where), "id", "left_anti").isEmpty()
        assert recall_per_query(result.rows, truth, "query_id", "id").agg({"recall": "min"}).first()[0] >= 0.9 or one is index
        strict = hybrid_search(one, q, {"author": "Srinivasa Ramanujan"}, 10)
        assert (strict.path, strict.probes) == ("filter_first", None)
        cols = ["query_id", "id", "rank"]
        exact = knn_join(docs.filter(predicate({"author": "Srinivasa Ramanujan"})), q, 10)
        assert strict.rows.select(*cols).exceptAll(exact.select(*cols)).isEmpty()
    assert hybrid_search(index, q, filters, 10).probes == 2 and hybrid_search(index, q, filters, 10, probes=7).probes == 7


def test_widening_to_the_end_keeps_few_rows(spark, docs, index, monkeypatch):
    """Where no row is left out before the filter, tasks keep k rows per query, and the rows are those of the search for all."""
    q = spark.createDataFrame([(0, [0.1, 0.2, 0.3]), (1, None), (2, [0.9, 0.2, 0.6])], "query_id int, embedding array<float>")
    where = predicate({"category": "Physics"})
    kept, search = [], IvfIndex.search
    monkeypatch.setattr(IvfIndex, "search", lambda self, queries, k, *args, **more: kept.append(k) or search(self, queries, k, *args, **more))
    wide = post_filter_widening(index, q, where, ["category"], 10, 1 << 20, 10).collect()
    assert kept == [10]
    assert sorted(map(tuple, wide)) == sorted(map(tuple, post_filter_knn(index, q, where, ["category"], 10, 1000, 10).collect()))
    assert kept == [10, 1000] and sum(r.query_id != 1 for r in wide) == 20


def test_post_filter_keeps_what_is_among_the_ef_nearest_of_all_rows_but_fetches_k(spark, monkeypatch):
    """Against plain Python, with rows and queries that are there twice, ties, rows without a vector and a query without one."""
    from vecspark.operators import hybrid
    from vecspark.plans import ivf
    monkeypatch.setattr(hybrid, "FETCHED_ROWS", 12)
    vectors = {i: [float(i * 7 % 23), float(i * 5 % 11)] for i in range(120)}
    rows = [(i, v, i % 4) for i, v in vectors.items()] + [(i, vectors[i], i % 4) for i in range(0, 120, 9)] + [(500, None, 0)]
    asked = [(i, vectors[i]) for i in (1, 2, 2, 50)] + [(7, None), (None, [3.0, 4.0])]
    base = spark.createDataFrame(rows, "id int, embedding array<float>, label int")
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    index = IvfIndex.build(base, "l2", centers=[[5.0, 5.0], [15.0, 5.0]])
    wanted = []
    joined = ivf.knn_join
    monkeypatch.setattr(ivf, "knn_join", lambda *args, **options: wanted.append(args[2]) or joined(*args, **options))
    found = post_filter_knn(index, queries, predicate({"label": 0}), ["label"], 5, 12, 2).collect()
    assert wanted == [5]
    expected = []
    for name in (1, 2, 50, 7, None):
        near = sorted((0 if v is None else sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i, label)
                      for q, v in asked if q == name for i, w, label in rows if w is not None)[:12]
        expected += [(name, i, rank) for rank, (_, i, label) in enumerate([n for n in near if n[2] == 0][:5], 1)]
    assert sorted(((r.query_id, r.id, r["rank"]) for r in found), key=str) == sorted(expected, key=str)
