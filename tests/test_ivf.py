"""Inverted-list index: recall floors, rules for rows and queries, maintenance."""

import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecspark.functions import bits
from vecspark.operators.evaluate import recall, sweep
from vecspark.operators.kernels import metric_of
from vecspark.operators.knn import knn_join
from vecspark.plans.ivf import IvfIndex, train_centers, training_sample
from vecspark.session import scratch_path
from vecspark.streaming import insert_stream


def as_queries(df, id="id"):
    return df.withColumnRenamed(id, "query_id")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((20000, 3))
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)],
                                 "id int, embedding array<float>").repartition(4, "id").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(i, [float(x) for x in rng.random(3)]) for i in range(20)],
                                 "query_id int, embedding array<float>")


@pytest.mark.parametrize("metric,floors", [("l2", {1: 0.71, 10: 0.95, 100: 1.0}), ("cosine", {1: 0.71, 10: 0.95, 100: 0.9925}),
                                           ("ip", {100: 1.0})])
def test_recall_floors(spark, cloud, asked, metric, floors):
    index = IvfIndex.build(cloud, metric, 100)
    truth = knn_join(cloud, asked, 20, metric)
    report = sweep(spark, "ivf", lambda p: index.search(asked, 20, p), list(floors), truth, "query_id", "id")
    got = {r.param: r.recall for r in report.collect()}
    assert all(got[p] >= floor for p, floor in floors.items()), got


def test_iterative_scan_finds_what_passes(spark, cloud, asked):
    index = IvfIndex.build(cloud, "l2", 20)
    where = F.col("id") % 2000 == 0
    found = index.search_iterative(asked, 11, 4, where=where)
    assert found.groupBy("query_id").count().agg(F.min("count"), F.max("count")).first() == (10, 10)
    short = index.search_iterative(asked, 11, 1, 2, where=where)
    assert short.groupBy("query_id").count().agg(F.max("count")).first()[0] < 10
    truth = knn_join(cloud.filter(where), asked, 10)
    ordered = index.search_iterative(asked, 10, 4, where=where, relaxed=False)
    cols = ["query_id", "id", "rank"]
    assert ordered.select(*cols).exceptAll(truth.select(*cols)).isEmpty()
    batches = found.orderBy("query_id", "rank").collect()
    for a, b in zip(batches, batches[1:]):
        if a.query_id == b.query_id:
            assert (a.batch, a.distance) <= (b.batch, b.distance)


def test_rows_and_queries_without_direction(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [1.0, 2.0, 4.0])],
                               "id int, embedding array<float>")
    q = spark.createDataFrame([(0, [3.0, 3.0, 3.0]), (1, None), (2, [0.0, 0.0, 0.0])], "query_id int, embedding array<float>")

    def ids(index, query):
        return [r.id for r in index.search(q, 10).filter(f"query_id = {query}").orderBy("rank").collect()]

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        l2, cosine = IvfIndex.build(df, "l2", 1), IvfIndex.build(df, "cosine", 1)
    assert ids(l2, 0) == [2, 5, 3, 1] and sorted(ids(l2, 1)) == [1, 2, 3, 5]
    assert ids(cosine, 0) == [3, 2, 5] and sorted(ids(cosine, 2)) == [2, 3, 5]


def test_ranges_and_little_data(spark, cloud):
    few = cloud.filter("id < 5")
    for bad in (0, 32769):
        with pytest.raises(ValueError, match="out of bounds"):
            train_centers(few, "l2", bad)
    with pytest.warns(UserWarning, match="little data"):
        index = IvfIndex.build(few, "l2", 10)
    assert len(index.centers) == 10
    with pytest.raises(ValueError, match="probes"):
        index.search(as_queries(few), 1, 0)
    with pytest.raises(ValueError, match="no inverted-list"):
        train_centers(few, "l1", 2)
    assert train_centers(few.filter("id < 0"), "l2", 3, dim=4).shape == (3, 4)


def test_repeated_vectors_all_found(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(10)] + [(10 + i, [4.0, 5.0, 6.0]) for i in range(10)],
                               "id int, embedding array<float>")
    index = IvfIndex.build(df, "l2", 5)
    q = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "query_id int, embedding array<float>")
    found = index.search(q, 20).groupBy("query_id").agg(F.sum((F.col("distance") == 0).cast("int")).alias("n")).collect()
    assert {r.query_id: r.n for r in found} == {0: 10, 1: 10}


def test_bit_lists_hold_all_equal_rows(spark):
    df = spark.range(100).select(F.col("id").cast("int"), F.substring(F.lpad(F.bin(F.col("id") % 8), 3, "0"), 1, 3).alias("t"))
    df = df.withColumn("embedding", bits.bits_from_text("t"))
    index = IvfIndex.build(df, "hamming", 100)
    asked = df.filter("id < 8").select(F.col("id").alias("query_id"), "embedding")
    found = index.search(asked, 100).filter("distance = 0").groupBy("query_id").count().collect()
    assert sorted(r["count"] for r in found) == [12] * 4 + [13] * 4


def test_training_sample_does_not_depend_on_partitioning(spark, cloud):
    a = training_sample(cloud.repartition(3), "l2", 4)
    b = training_sample(cloud.repartition(7), "l2", 4)
    assert a.select("id").exceptAll(b.select("id")).isEmpty() and 9000 < a.count() < 11000


def test_load_insert_delete_vacuum(spark, embeddings):
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows.filter("label < 5"), "l2", 8, path=scratch_path(spark, "kept"), partition_by=["label"])
    index = IvfIndex.load(spark, index.path)
    index.insert(rows.filter("label >= 5"), part="late")
    index.insert(rows.filter("label >= 5"), part="late")  # a repeated insert replaces itself
    assert index.entries().count() == 500
    index.delete(rows.filter("label = 3").select("id"))
    index.delete(rows.filter("id < 50").select("id"))
    left = rows.filter("label <> 3 AND id >= 50").count()
    assert index.entries().count() == left
    index.vacuum()
    assert index.entries().count() == left
    q = as_queries(rows)
    cols = ["query_id", "id", "rank"]
    truth = knn_join(rows.filter("label <> 3 AND id >= 50"), q, 5)
    assert index.search(q, 5, 8).select(*cols).exceptAll(truth.select(*cols)).isEmpty()
    assert recall(index.search(q, 5, 8), truth, "query_id", "id").first().recall == 1.0


def test_pruning_reads_probed_lists_only(spark, embeddings):
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows, "l2", 8)
    plan = index.search(as_queries(rows.filter("id = 7")), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_insert_is_repeatable(spark, embeddings):
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows.filter("label < 8"), "l2", 4)
    source, state = scratch_path(spark, "source"), scratch_path(spark, "state")
    for part in (8, 9):
        rows.filter(F.col("label") == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        insert_stream(index, stream, state, available_now=True).awaitTermination()
    assert index.entries().count() == 500 and index.entries().select("id").distinct().count() == 500


def test_two_streams_into_one_index(spark, embeddings):
    """A second stream with the default name and its own checkpoint adds its rows; a restarted one repeats none."""
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows.filter("label < 4"), "l2", 4)
    states = {}
    for low, high in ((4, 7), (7, 10), (4, 7)):
        states.setdefault(low, (scratch_path(spark, "source"), scratch_path(spark, "state")))
        source, state = states[low]
        rows.filter(f"label >= {low} AND label < {high}").write.mode("ignore").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        insert_stream(index, stream, state, available_now=True).awaitTermination()
    assert index.entries().count() == 500 and index.entries().select("id").distinct().count() == 500


def test_a_part_written_again_is_live(spark, embeddings):
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows, "l2", 4)
    new = rows.filter("id = 3").withColumn("id", F.lit(9000))
    index.insert(new, part="p")
    assert index.entries().count() == 501
    index.delete(new.select("id"))
    assert index.entries().count() == 500
    index.insert(new, part="p")
    assert index.entries().count() == 501
    index.vacuum()
    assert index.entries().count() == 501


def test_a_reader_keeps_its_version(spark, embeddings):
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows, "l2", 4)
    whole = index.entries()
    index.delete(rows.filter("label = 3").select("id"))
    marked = index.entries()
    files = set(whole.inputFiles())
    index.vacuum()
    index.insert(rows.filter("label = 3").withColumn("id", F.col("id") + 1000))
    assert (whole.count(), marked.count(), index.entries().count()) == (500, 500 - rows.filter("label = 3").count(), 500)
    # only lists that lost rows were written anew, and nothing is left to take out
    state = index.manifest.read()[1]
    assert not state.deletes and set(index.entries().inputFiles()) - files
    index.purge()
    assert index.entries().count() == 500 and index.entries().filter("label = 3 AND id < 1000").isEmpty()
    with pytest.raises(Exception):
        whole.count()


def test_a_delete_during_a_vacuum_holds(spark, embeddings):
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows, "l2", 4)
    index.delete(rows.filter("label = 3").select("id"))
    commit = type(index.manifest).commit

    def meanwhile(manifest, change, *args):
        type(index.manifest).commit = commit
        index.delete(rows.filter("label = 4").select("id"))
        return commit(manifest, change, *args)

    type(index.manifest).commit = meanwhile
    try:
        index.vacuum()
    finally:
        type(index.manifest).commit = commit
    left = rows.filter("label NOT IN (3, 4)").count()
    assert index.entries().count() == left and index.entries().filter("label IN (3, 4)").isEmpty()
    index.vacuum()
    assert index.entries().count() == left and not index.manifest.read()[1].deletes


def test_writers_take_turns(spark):
    from vecspark.plans.manifest import Manifest, Part, State
    from vecspark.session import create_file
    log = Manifest(spark, scratch_path(spark, "log"))
    log.create()
    log.commit(lambda state: State([*state.parts, Part("a", "x")]))
    # a writer that was lost with its claim is passed over; a change is made from the latest version
    assert create_file(spark, f"{log.path}/claims/{1:012d}.0")
    log.commit(lambda state: State([*state.parts, Part("b", "y")]), patience=-1.0)
    version, state = log.read()
    assert version == 2 and state.folders() == ["x", "y"]


def test_lists_prune_with_a_label_and_with_many_keys(spark, embeddings):
    rows = embeddings.withColumnRenamed("vec_id", "id")
    index = IvfIndex.build(rows, "l2", 8, partition_by=["label"])
    asked = as_queries(rows.filter("label < 3"))
    plan = index.search(asked, 5, 2, on="label")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "list_id" in filters and "label" in filters
    truth = knn_join(rows, asked, 5, on="label")
    cols = ["query_id", "id", "rank"]
    assert index.search(asked, 5, 8, on="label").select(*cols).exceptAll(truth.select(*cols)).isEmpty()


def test_steps_in_one_task_equal_steps_by_jobs(spark, monkeypatch):
    """The centres are those that a job per step leads to; the driver holds somewhat more rows than lists at most."""
    from vecspark.plans import ivf
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.05, (150, 2)) for c in ((0, 0), (1, 1), (0, 1), (1, 0), (3, 3))])
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, embedding array<float>").repartition(3)
    one = train_centers(rows, "l2", 5)
    monkeypatch.setattr(ivf, "SETTLE_CELLS", 0)
    many = train_centers(rows, "l2", 5)
    assert np.allclose(one, many, atol=1e-6) and one.shape == (5, 2)
    placed = ivf.assign(rows, one).groupBy("list_id").agg(F.avg("center_distance").alias("d")).collect()
    assert len(placed) == 5 and sum(r.d for r in placed) / 5 < 0.6


def test_seeds_are_few_and_far(spark):
    from vecspark.plans import ivf
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rng.random((4000, 4)))], "id int, embedding array<float>")
    sample = training_sample(rows, "l2", 40)
    metric = ivf.metric_of("l2")
    seeds = ivf._seed_centers(sample, metric, 40, np.random.default_rng(1))
    assert 30 <= len(seeds) <= 40
    drawn, total = ivf._draw_far(sample, metric, seeds, 100.0, np.random.default_rng(2), None)
    assert 60 < len(drawn) < 150 and total > 0
    again, _ = ivf._draw_far(sample.repartition(7), metric, seeds, 100.0, np.random.default_rng(2), total)
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_worst_ratios_in_blocks(spark, embeddings, monkeypatch):
    from vecspark.plans import ivf
    index = IvfIndex.build(embeddings, "l2", 9, id="vec_id")
    whole = index.davies_bouldin().first()[0]
    sizes = {r.list_id: r.mean_distance for r in index.list_sizes().collect()}
    worst = [max((sizes[i] + sizes[j]) / np.linalg.norm(index.centers[i] - index.centers[j]) for j in sizes if j != i) for i in sizes]
    assert whole == pytest.approx(np.mean(worst))


def test_nearest_list_bounds_the_others(spark, monkeypatch):
    """In few dimensions the nearest list is searched first, and the rows stay those of an exact join: with ties, repeated ids, far rows and short lists."""
    from vecspark.plans import ivf
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.integers(0, 9, 3)], i % 7) for i in range(900)]
    rows += [(i + 900, [1e18, 1.0, 1.0], 0) for i in range(3)] + [(950, None, 1)]
    asked = [(i, [float(x) for x in draw.random(3) * 9]) for i in range(40)] + [(3, [8.0, 8.0, 8.0]), (None, [1.0, 2.0, 3.0]), (70, None)]
    base = spark.createDataFrame(rows, "id int, embedding array<float>, label int")
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    seen, join = [], ivf.knn_join
    monkeypatch.setattr(ivf, "knn_join", lambda b, q, *a, **c: seen.append(q) or join(b, q, *a, **c))
    index = IvfIndex.build(base, "l2", 6)
    for where, k in ((None, 5), (F.col("label") == 2, 60), (F.col("id") >= 899, 3)):
        kept = base if where is None else base.filter(where)
        found = index.search(queries, k, 6, where=where)
        want = knn_join(kept, queries.filter("embedding IS NOT NULL"), k, nulls="skip")
        columns = ["query_id", "id", "distance", "rank"]
        assert sorted(map(repr, found.filter("query_id IS NULL OR query_id <> 70").select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    limits = [q.filter("__asked IS NOT NULL AND __limit IS NOT NULL").count() for q in seen if "__limit" in q.columns]
    assert len(limits) == 3 and limits[0] == 42


def test_rows_beyond_a_limit_are_not_kept():
    from vecspark.operators.knn import _Nearest, _QuerySide
    vectors = pa.array([[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]], pa.list_(pa.float32()))
    side = _QuerySide(metric_of("l2"), pa.table({"__keys": [[0], [0]], "__vec": pa.array([[0.0, 0.0], [0.0, 0.0]], pa.list_(pa.float32())),
                                                 "query_id": [1, 2], "__limit": pa.array([2.0, None], pa.float64())}))
    state = _Nearest(metric_of("l2"), side, 3)
    state.add(pa.RecordBatch.from_arrays([pa.array([0, 0, 0]), vectors, pa.array([7, 8, 9])], names=["__key", "__vec", "id"]))
    out = state.result(pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]))
    assert sorted(zip(out["query_id"].to_pylist(), out["id"].to_pylist())) == [(1, 7), (1, 8), (2, 7), (2, 8), (2, 9)]
