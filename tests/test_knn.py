"""Exact search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import bits, sparse
from vecspark.operators import kernels, knn as knn_module
from vecspark.operators.knn import knn, knn_join, range_join, range_search, with_ties
from vecspark.operators.rerank import quantized_knn
from vecspark.types import vec_lit

POINTS = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [1.0, 2.0, 4.0])]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, "id int, embedding array<float>")


def ask(spark, *vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "query_id int, embedding array<float>")


def ids(df):
    return [r.id for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("metric,want", [("l2", [2, 5, 3, 1, 4]), ("ip", [5, 2, 3, 1, 4]), ("cosine", [3, 2, 5, 1, 4]),
                                         ("l1", [2, 5, 3, 1, 4])])
def test_order_with_null_and_zero(spark, points, metric, want):
    """NaN (the zero vector under cosine) after numbers, NULL last."""
    query = [3.0, 3.0, 3.0]
    assert [r.id for r in knn(points, vec_lit(query), 10, metric).collect()] == want
    for strategy in ("broadcast", "blocks"):
        found = knn_join(points, ask(spark, query), 10, metric, strategy=strategy)
        assert ids(found) == want
        assert found.filter("id = 4").first().distance is None
    assert ids(knn_join(points, ask(spark, query), 10, metric, nulls="skip")) == want[:-1]


def test_null_query_returns_rows_without_distance(spark, points):
    for strategy in ("broadcast", "blocks"):
        found = knn_join(points, ask(spark, None, [3.0, 3.0, 3.0]), 2, strategy=strategy)
        rows = found.orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id) for r in rows] == [(0, 1), (0, 2), (1, 2), (1, 5)]
        assert rows[0].distance is None


def brute(base, queries, k, measure, same=None):
    out = {}
    for q, (qv, ql) in queries.items():
        pool = [(measure(v, qv), i) for i, (v, lab) in base.items() if same is None or lab == ql]
        out[q] = [i for _, i in sorted(pool)[:k]]
    return out


MEASURES = {"l2": lambda a, b: math.dist(a, b), "ip": lambda a, b: -float(np.dot(a, b)),
            "l1": lambda a, b: float(np.abs(np.subtract(a, b)).sum())}


@pytest.mark.parametrize("metric", list(MEASURES))
@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
@pytest.mark.parametrize("on", [None, "label"])
def test_skewed_copies_match_brute_force(spark, metric, strategy, on):
    """A third of the rows are one copy under one label; small blocks force many pieces per key."""
    rows = 7 if strategy == "blocks" else 100
    rng = np.random.default_rng(1)
    base = {i: (([1.0, 1.0, 1.0] if i % 3 == 0 else [float(x) for x in rng.integers(-3, 4, 3)]),
                0 if i % 3 == 0 else int(rng.integers(0, 4))) for i in range(300)}
    queries = {i: ([float(x) for x in rng.integers(-3, 4, 3)], i % 4) for i in range(20)}
    b = spark.createDataFrame([(i, v, lab) for i, (v, lab) in base.items()], "id int, embedding array<float>, label int")
    q = spark.createDataFrame([(i, v, lab) for i, (v, lab) in queries.items()],
                              "query_id int, embedding array<float>, label int")
    found = knn_join(b.repartition(5), q, 9, metric, on=on, strategy=strategy, block_rows=rows).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(base, queries, 9, MEASURES[metric], on)


def test_close_large_values_stay_exact(spark):
    """Nearly equal, large vectors: the matrix shortcut alone would mix them up."""
    base = spark.createDataFrame([(i, [1e6 + i * 0.0625, 1e6]) for i in range(200)], "id int, embedding array<float>")
    found = knn_join(base, ask(spark, [1e6 + 7 * 0.0625, 1e6]), 3).orderBy("rank").collect()
    assert [r.id for r in found] == [7, 6, 8] and found[0].distance == 0.0


def test_text_ids_and_payload(spark):
    base = spark.createDataFrame([(c, [float(i % 2)], c.upper()) for i, c in enumerate("abcdef")],
                                 "id string, embedding array<float>, name string")
    found = knn_join(base, ask(spark, [0.0]), 3, payload=["name"]).orderBy("rank").collect()
    assert [(r.id, r.name) for r in found] == [("a", "A"), ("c", "C"), ("e", "E")]


def test_many_keys_use_a_join_filter(spark, monkeypatch):
    monkeypatch.setattr(knn_module, "LITERAL_KEYS", 3)
    base = spark.createDataFrame([(i, [float(i)], i % 10) for i in range(100)], "id int, embedding array<float>, label int")
    q = spark.createDataFrame([(i, [0.0], i) for i in range(5)], "query_id int, embedding array<float>, label int")
    assert ids(knn_join(base, q, 1, on="label")) == [0, 1, 2, 3, 4]


def test_mixed_dimensions_raise(spark, points):
    with pytest.raises(Exception, match="different vector dimensions"):
        knn_join(points, ask(spark, [1.0]), 1).collect()


def test_range_forms(spark, points):
    near = range_search(points, vec_lit([3, 3, 3]), below=3.0).collect()
    assert sorted(r.id for r in near) == [2, 5]
    for rows in (1, 10):
        pairs = range_join(points, ask(spark, [3.0, 3.0, 3.0], [0.0, 0.0, 0.0]), 3.0, 0.5, block_rows=rows).collect()
        assert sorted((r.query_id, r.id) for r in pairs) == [(0, 2), (0, 5), (1, 3)]


def test_with_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)], "id int, distance double").withColumn("g", F.lit(0))
    assert sorted(r.id for r in with_ties(df, 2, ["g"]).collect()) == [1, 2, 3]


def test_bit_order(spark):
    base = spark.createDataFrame([(i, t) for i, t in enumerate(["0000", "1100", "1111", None, "1110"])], "id int, t string")
    base = base.withColumn("b", bits.bits_from_text("t"))
    q = spark.createDataFrame([(0, "1111")], "query_id int, t string").withColumn("b", bits.bits_from_text("t"))
    for metric in ("hamming", "jaccard"):
        assert ids(knn_join(base, q, 10, metric, base_vec="b", query_vec="b")) == [2, 4, 1, 0, 3]


def test_sparse_matches_dense(spark, embeddings):
    thin = embeddings.select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x) < 0.12, 0.0).otherwise(x).cast("float"))
                             .alias("embedding"))
    packed = thin.withColumn("embedding", sparse.dense_to_sparse("embedding"))
    for metric in ("l2", "ip", "l1"):
        a = knn_join(thin, thin.withColumnRenamed("vec_id", "query_id"), 4, metric, base_id="vec_id")
        b = knn_join(packed, packed.withColumnRenamed("vec_id", "query_id"), 4, f"sparse_{metric}", base_id="vec_id")
        cols = ["query_id", "vec_id", "rank"]
        assert a.select(*cols).exceptAll(b.select(*cols)).isEmpty()


def test_quantized_with_all_candidates_is_exact(spark, embeddings):
    q = embeddings.withColumnRenamed("vec_id", "query_id").limit(20)
    a = quantized_knn(embeddings, q, 5, 500, base_id="vec_id").select("query_id", "vec_id", "rank")
    b = knn_join(embeddings, q, 5, base_id="vec_id").select("query_id", "vec_id", "rank")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_scan_reads_only_needed_columns(spark, embeddings):
    wide = embeddings.filter(F.col("label") == 3)
    plan = knn_join(wide, embeddings.withColumnRenamed("vec_id", "query_id"), 3, base_id="vec_id") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_query_blocks_are_bounded_and_whole(spark):
    """Half of the queries want one key: its block is cut further; none is lost."""
    q = spark.range(500).select(F.col("id").cast("int").alias("query_id"), F.array(F.when(F.col("id") < 250, F.lit(7)).otherwise(F.col("id"))).alias("__keys"),
                                F.array(F.col("id").cast("float")).alias("__vec")).select("__keys", "__vec", "query_id")
    blocks = list(knn_module.query_blocks(q, "query_id", True, rows=40))
    assert all(0 < b.num_rows <= 40 for b in blocks)
    assert sorted(x for b in blocks for x in b.column("query_id").to_pylist()) == list(range(500))
    small = list(knn_module.query_blocks(q, "query_id", True, size=2000))
    assert len(small) > 3 and all(b.nbytes <= 2000 for b in small)
    one = q.withColumn("query_id", F.lit(1)).withColumn("__vec", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(ValueError, match="one id"):
        list(knn_module.query_blocks(one, "query_id", True, rows=40))


def test_blocks_leave_the_base_where_it_is(spark, embeddings):
    """A round scans the base and shuffles k rows per query and task; no base row is exchanged or copied."""
    q = embeddings.withColumnRenamed("vec_id", "query_id")
    plan = executed(knn_join(embeddings, q, 3, base_id="vec_id", on="label"))
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "Generate" not in below and "Join" not in below
    cols = ["query_id", "vec_id", "rank"]
    rounds = knn_join(embeddings, q, 3, base_id="vec_id", on="label", block_rows=60).select(*cols)
    assert rounds.exceptAll(knn_join(embeddings, q, 3, base_id="vec_id", on="label").select(*cols)).isEmpty() and rounds.count() == 1500


def test_ranges_come_in_pieces(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(knn_module, "RANGE_PAIRS", 10)
    metric = knn_module.metric_of("l2")
    side = knn_module._QuerySide(metric, pa.table({"__keys": [[0]] * 4, "__vec": [[0.0]] * 4, "query_id": [1, 2, 3, 4]}))
    batch = pa.RecordBatch.from_pydict({"__key": [0] * 9, "__vec": [[float(i)] for i in range(9)], "id": list(range(9))})
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    found = list(knn_module._Within(metric, side, float("-inf"), 5.0).pieces(batch, schema))
    assert len(found) == 5 and all(f.num_rows <= 10 for f in found) and sum(f.num_rows for f in found) == 20


def test_key_columns_prune_one_by_one(spark, tmp_path):
    """Partition columns get filters of their own, also with an array of keys and with thousands of them."""
    rows = spark.range(6000).select("id", F.array(F.col("id").cast("float")).alias("embedding"), (F.col("id") % 3000).cast("int").alias("list_id"),
                                    (F.col("id") % 2).cast("int").alias("label"))
    path = str(tmp_path / "rows")
    rows.filter("list_id < 40").write.partitionBy("label", "list_id").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    q = rows.limit(20).select(F.col("id").alias("query_id"), "embedding", "label", F.array("list_id", F.lit(5)).alias("lists"))
    for wide in (q, q.withColumn("lists", F.expr("transform(sequence(0, 2999), x -> int(x))"))):
        plan = executed(knn_join(stored, wide, 2, on=["label", ("list_id", "lists")]))
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "list_id" in filters and "label" in filters
    found = knn_join(stored, q, 1, on=["label", ("list_id", "lists")])
    assert found.filter("id % 3000 <> query_id % 3000").isEmpty()


def test_first_phase_carries_no_vectors(spark, embeddings):
    """The first exchange of a quantised search has ids and distances only; vectors are fetched for survivors."""
    q = embeddings.withColumnRenamed("vec_id", "query_id").limit(5)
    from vecspark.functions.bits import binary_quantize
    coarse = knn_join(embeddings.withColumn("b", binary_quantize("embedding")), q.withColumn("b", binary_quantize("embedding")), 20, "hamming",
                      base_id="vec_id", base_vec="b", query_vec="b", nulls="skip")
    assert coarse.columns == ["query_id", "vec_id", "distance", "rank"]
    final = quantized_knn(embeddings, q, 5, 20, base_id="vec_id")
    assert "LeftSemi" in executed(final) and final.count() == 25


def _pairs_of(metric, base, asked, k, limit=None):
    row, query, rank = kernels.nearest_in_block(metric, base, np.arange(len(base)), asked, k, limit)
    return [(q, r) for q, r in zip(query.tolist(), row.tolist())], rank


@pytest.mark.parametrize("name", ["l2", "ip", "cosine", "l1"])
def test_rough_ranks_are_within_their_slack(name):
    """Rounded numbers screen faster; their slack covers what they are off, with far and near values, and for other sizes than a tile's."""
    rng = np.random.default_rng(3)
    for dim, shift, size in ((70, 0.0, 1.0), (3, 1e6, 1e-2), (64, -5.0, 1e12)):
        x, q = (shift + size * rng.standard_normal((n, dim)).astype(np.float32).astype(np.float64) for n in (300, 37))
        base, asked, metric = kernels.DenseBlock(x), kernels.DenseBlock(q), kernels.METRICS[name]
        rough, slack, constant = base.screen(metric, asked, True)
        where = np.divmod(np.arange(300 * 37), 300)
        exact = base.exact(metric, where[1], asked, where[0]).reshape(37, 300)
        assert (np.abs(rough + constant[:, None] - exact) <= slack[:, None] * 1.01 + 1e-6 * np.abs(exact)).all()
        got, _ = _pairs_of(metric, base, asked, 5)
        assert got == [(i, j) for i in range(37) for j in np.lexsort((np.arange(300), exact[i]))[:5].tolist()]


@pytest.mark.parametrize("name", ["l2", "l1", "ip", "cosine"])
def test_sparse_rows_are_laid_out_where_that_is_cheaper(name, monkeypatch):
    """Rows of few indices are screened as dense ones, with the same nearest rows; rows of many are not."""
    rng = np.random.default_rng(4)

    def block(n, dims, share):
        dense = np.where(rng.random((n, dims)) < share, rng.integers(-3, 4, (n, dims)), 0).astype(np.float64)
        dense[0] = 0
        row, index = np.nonzero(dense)
        return kernels.SparseBlock(np.full(n, dims), np.r_[0, np.cumsum(np.bincount(row, minlength=n))], index, dense[row, index])

    base, asked, metric = block(400, 40, 0.4), block(50, 40, 0.4), kernels.METRICS[f"sparse_{name}"]
    assert base._laid_out(asked) is not None and block(400, 20_000, 0.0005)._laid_out(block(50, 20_000, 0.0005)) is None
    got, rank = _pairs_of(metric, base, asked, 7)
    monkeypatch.setattr(kernels.SparseBlock, "_laid_out", lambda self, queries: None)
    want, want_rank = _pairs_of(metric, base, asked, 7)
    assert got == want and np.array_equal(rank, want_rank, equal_nan=True)


@pytest.mark.parametrize("name", ["l2", "l1"])
def test_far_rows_are_not_compared(name, monkeypatch):
    """In few dimensions, rows far from all queries of a box drop out before distances are taken; results and ties stay."""
    rng = np.random.default_rng(5)
    metric = kernels.METRICS[name]
    x, q = rng.integers(0, 40, (6000, 3)).astype(np.float64), rng.integers(0, 40, (4000, 3)) + 0.5
    q = q[kernels.in_boxes(q, kernels.BOX_QUERIES // 8)]
    base, asked = kernels.DenseBlock(x), kernels.DenseBlock(q)
    want, rank = _pairs_of(metric, base, asked, 4)
    seen, screen = [], kernels.DenseBlock.screen
    monkeypatch.setattr(kernels.DenseBlock, "screen", lambda self, m, queries, *more: seen.append(len(self) * len(queries)) or screen(self, m, queries, *more))
    got, _ = _pairs_of(metric, base, asked, 4, rank.reshape(4000, 4)[:, -1].copy())
    assert got == want and sum(seen) < 6000 * 4000 / 2


def test_blocks_are_bounded_by_what_a_task_keeps():
    sizes = [knn_module.block_rows_for(k) for k in (1, 10, 64, 200, 10_000, 1 << 20, 1 << 40)]
    assert sizes[0] == 131_072 and sizes[1] > 100_000 and sizes == sorted(sizes, reverse=True) and sizes[-1] == 1
    assert all(size * k <= 1 << 21 for size, k in zip(sizes[:-1], (1, 10, 64, 200, 10_000, 1 << 20)))


def test_limits_hold_from_the_first_batch_on():
    """A block's k-th row limits what the next batch gives, before anything is put together."""
    import pyarrow as pa
    metric = knn_module.metric_of("l2")
    side = knn_module._QuerySide(metric, pa.table({"__keys": [[0]] * 2, "__vec": [[0.0], [9.0]], "query_id": [1, 2]}))
    state = knn_module._Nearest(metric, side, 2)
    for first in (0, 3, 6):
        state.add(pa.RecordBatch.from_pydict({"__key": [0] * 9, "__vec": [[float(first + i)] for i in range(9)], "id": [first * 10 + i for i in range(9)]}))
        assert np.isfinite(state.limit).all()
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    assert sorted(state.result(schema).column("distance").to_pylist()) == [0.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("name", ["l1", "l2"])
def test_vectors_with_holes_are_as_before(name):
    """A NaN row is near nothing under L1 and leaves the others alone; under L2 its block gives no rows, in few dimensions too."""
    x = np.arange(60, dtype=np.float64).reshape(20, 3)
    x[4, 1] = np.nan
    base, asked, metric = kernels.DenseBlock(x), kernels.DenseBlock(np.array([[12.0, 13, 14], [0, np.nan, 2]])), kernels.METRICS[name]
    got, _ = _pairs_of(metric, base, asked, 2, np.full(2, np.inf))
    assert got == ([(0, 3), (0, 5)] if name == "l1" else [])


@pytest.mark.parametrize("metric", ["sparse_l2", "sparse_ip", "sparse_cosine", "sparse_l1"])
def test_sparse_distances_are_measured_densely_where_that_is_cheaper(monkeypatch, metric):
    """Without merging indices pair by pair, and with the same result to the last bit."""
    rng = np.random.default_rng(3)
    data = np.where(rng.random((60, 20)) < 0.5, rng.normal(size=(60, 20)), 0)
    data[0], data[1, 3] = 0, np.nan

    def block(part):
        row, column = np.nonzero(part)
        offsets = np.concatenate([[0], np.cumsum(np.count_nonzero(part, axis=1))])
        return kernels.SparseBlock(np.full(len(part), 20), offsets, column, part[row, column])

    base, queries = block(data[:50]), block(data[45:])
    row, query = np.repeat(np.arange(50), 15), np.tile(np.arange(15), 50)
    merged = base._exact_part(kernels.METRICS[metric], row, queries, query)
    monkeypatch.setattr(kernels.SparseBlock, "_exact_part", None)
    np.testing.assert_array_equal(base.exact(kernels.METRICS[metric], row, queries, query), merged)


def test_keys_of_the_same_queries_are_searched_together():
    """A probe of all lists compares a batch whole, not list by list; lists of different queries stay apart."""
    import pyarrow as pa
    metric = knn_module.metric_of("l2")
    side = knn_module._QuerySide(metric, pa.table({"__keys": [[0, 1, 2], [2, 1, 0], [0, 1], [4]], "__vec": [[0.0], [5.0], None, [7.0]], "query_id": [1, 2, 3, 4]}))
    batch = pa.RecordBatch.from_pydict({"__key": [1, 0, 2, 3, 0, 4], "__vec": [[float(i)] for i in range(6)], "id": list(range(6))})
    found = {tuple(m.tolist()): (a.tolist(), u.tolist()) for m, a, u in side.parts(batch)}
    assert found == {(0, 1, 4): ([0, 1], [2]), (2,): ([0, 1], []), (5,): ([3], [])}
    state = knn_module._Nearest(metric, side, 2)
    state.add(batch)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    rows = state.result(schema).sort_by([("query_id", "ascending"), ("distance", "ascending"), ("id", "ascending")])
    assert rows.column("id").to_pylist() == [0, 1, 4, 2, 0, 1, 5] and rows.column("distance").to_pylist() == [0, 1, 1, 3, None, None, 2]


def test_small_ranges_leave_a_task_together():
    import pyarrow as pa
    tables = [pa.table({"x": pa.array(range(n), pa.int64())}) for n in (3, 0, 4, 9, 1, 0)]
    assert [t.column("x").to_pylist() for t in knn_module._together(tables, 6)] == [[0, 1, 2, 0, 1, 2, 3], list(range(9)), [0]]
    assert list(knn_module._together(tables[1:2], 6)) == []


@pytest.mark.parametrize("width", [1, 3, 4, 5])
@pytest.mark.parametrize("rows, asked", [(7, 3), (3, 7), (0, 2), (200, 40)])
def test_hamming_screen_has_small_whole_numbers(width, rows, asked):
    rng = np.random.default_rng(width)
    x, q = (kernels.BitBlock(rng.integers(0, 1 << 63, (n, width), dtype=np.uint64), np.full(n, 64 * width)) for n in (rows, asked))
    x.words[:1] = ~q.words[:1]
    rough, _, _ = x.screen(kernels.METRICS["hamming"], q, True)
    want = np.array([[sum(int(a ^ b).bit_count() for a, b in zip(one, mine)) for mine in x.words] for one in q.words]).reshape(asked, rows)
    assert (rough == want).all() and rough.dtype == (np.uint8 if width < 4 else np.uint16)
    top = np.where(np.arange(asked) % 3 == 0, -1.0, np.where(np.arange(asked) % 3 == 1, 31.5, np.inf))
    assert set(zip(*kernels._at_most(rough, top))) == set(zip(*np.nonzero(want <= top[:, None])))


@pytest.mark.parametrize("n, k", [(10_000, 10), (100, 3), (20, 10), (333, 1)])
def test_bound_of_the_kth_is_never_too_low(n, k):
    rng = np.random.default_rng(n)
    rough = rng.normal(size=(50, n)).astype(np.float32)
    rough[3, rng.random(n) < 0.5] = np.inf
    rough[4, 1:] = np.inf
    bound, kth = kernels._kth_or_above(rough, k), np.sort(rough, axis=1)[:, k - 1]
    assert (bound >= kth).all() and (rough[:3] <= bound[:3, None]).sum(axis=1).max() <= 4 * k
    whole = rng.integers(0, 65, (50, n)).astype(np.uint8)
    assert (kernels._kth_or_above(whole, k) >= np.sort(whole, axis=1)[:, k - 1]).all()
