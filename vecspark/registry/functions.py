"""Types, scalar functions, casts and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.functions import bits, casts, dense, half, sparse, text
from vecspark.operators.aggregates import half_avg, half_sum, vec_avg, vec_from_rows, vec_sum
from vecspark.registry import query
from vecspark.registry.common import (DIM, PAIRED, embeddings, label_centers, r6, scaled, sql_bits,
                                      sql_cosine, sql_half, sql_ip, sql_l1, sql_l2, sql_r6, table, with_center, SCALED)
from vecspark.session import scratch_path
from vecspark.sources.tables import assign_labels, export_text, ingest_text, quality_report, read_vectors, write_vectors
from vecspark.types import vec_check


@query("scan_dims_norm", f"""SELECT vec_id, label, len(embedding)::INT AS dims,
  {sql_r6('sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS norm FROM embeddings""")
def scan_dims_norm(spark, sf):
    return embeddings(spark, sf).select("vec_id", "label", dense.vector_dims("embedding").alias("dims"),
                                        r6(dense.vector_norm("embedding")).alias("norm"))


@query("type_check", "SELECT 'ok' AS state, count(*) AS rows FROM embeddings")
def type_check(spark, sf):
    checked = embeddings(spark, sf).withColumn("embedding", vec_check("embedding", DIM))
    return quality_report(checked, "embedding", "vector", DIM)


_SCALARS = [
    ("fn_l2_distance", dense.l2_distance, sql_l2("a", "b")),
    ("fn_l2_squared_distance", dense.l2_squared_distance, f"pow({sql_l2('a', 'b')}, 2)"),
    ("fn_inner_product", dense.inner_product, sql_ip("a", "b")),
    ("fn_negative_inner_product", dense.negative_inner_product, "-" + sql_ip("a", "b")),
    ("fn_cosine_distance", dense.cosine_distance, sql_cosine("a", "b")),
    ("fn_l1_distance", dense.l1_distance, sql_l1("a", "b")),
    ("fn_spherical_distance", dense.spherical_distance, f"acos(least(greatest({sql_ip('a', 'b')}, -1), 1)) / pi()"),
]


def _register_scalar(name, function, sql):
    @query(name, f"{PAIRED} SELECT vec_id, {sql_r6(sql)} AS value FROM p")
    def run(spark, sf):
        return with_center(spark, sf).select("vec_id", r6(function("embedding", "center")).alias("value"))


for _name, _function, _sql in _SCALARS:
    _register_scalar(_name, _function, _sql)


def _summed(vector):
    """A vector result as scalars that show every element's place."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return r6(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x))


def _sql_summed(vector: str) -> str:
    return sql_r6(f"list_sum(list_transform({vector}, lambda x, i: x::DOUBLE * i))")


def _sql_zip(op: str) -> str:
    return f"list_transform(list_zip(a, b), lambda p: (p[1]::DOUBLE {op} p[2]::DOUBLE)::FLOAT)"


_ARITHMETIC = [
    ("fn_vector_add", dense.vector_add, _sql_zip("+")),
    ("fn_vector_sub", dense.vector_sub, _sql_zip("-")),
    ("fn_vector_mul", dense.vector_mul, _sql_zip("*")),
    ("fn_vector_concat", dense.vector_concat, "list_concat(a, b)"),
    ("fn_l2_normalize", lambda a, b: dense.l2_normalize(b),
     "list_transform(b, lambda x: (x::DOUBLE / sqrt(list_inner_product(b::DOUBLE[], b::DOUBLE[])))::FLOAT)"),
    ("fn_subvector", lambda a, b: dense.subvector(a, F.lit(5), F.lit(20)), "list_slice(a, 5, 24)"),
    ("fn_subvector_low_start", lambda a, b: dense.subvector(a, F.lit(-3), F.lit(10)), "list_slice(a, 1, 6)"),
]


def _register_arithmetic(name, function, sql):
    @query(name, f"{PAIRED}, v AS (SELECT vec_id, {sql} AS r FROM p) "
                 f"SELECT vec_id, len(r)::INT AS dims, {_sql_summed('r')} AS value FROM v")
    def run(spark, sf):
        rows = with_center(spark, sf).select("vec_id", function(F.col("embedding"), F.col("center")).alias("r"))
        return rows.select("vec_id", F.size("r").alias("dims"), _summed("r").alias("value"))


for _name, _function, _sql in _ARITHMETIC:
    _register_arithmetic(_name, _function, _sql)


@query("fn_binary_quantize", f"SELECT vec_id, {sql_bits('embedding')} AS bits FROM embeddings")
def fn_binary_quantize(spark, sf):
    return embeddings(spark, sf).select("vec_id", bits.bits_to_text(bits.binary_quantize("embedding")).alias("bits"))


@query("fn_comparisons", f"""{PAIRED} SELECT vec_id, a < b AS lt, a <= b AS le, a = b AS eq, a <> b AS ne, a >= b AS ge,
  a > b AS gt, (CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)::INT AS cmp FROM p""")
def fn_comparisons(spark, sf):
    a, b = F.col("embedding"), F.col("center")
    return with_center(spark, sf).select(
        "vec_id", (a < b).alias("lt"), (a <= b).alias("le"), (a == b).alias("eq"), (a != b).alias("ne"),
        (a >= b).alias("ge"), (a > b).alias("gt"), dense.vector_cmp(a, b).alias("cmp"))


_BITS = f"""{PAIRED}, q AS (SELECT vec_id, {sql_bits('a')}::BIT AS x, {sql_bits('b')}::BIT AS y FROM p)"""


@query("fn_bit_distances", f"""{_BITS} SELECT vec_id, bit_count(xor(x, y))::DOUBLE AS hamming,
  {sql_r6("CASE WHEN bit_count(x & y) = 0 THEN 1.0::DOUBLE ELSE 1 - bit_count(x & y)::DOUBLE / bit_count(x | y) END")}
  AS jaccard FROM q""")
def fn_bit_distances(spark, sf):
    x, y = bits.binary_quantize("embedding"), bits.binary_quantize("center")
    rows = with_center(spark, sf).select("vec_id", x.alias("x"), y.alias("y"))
    return rows.select("vec_id", bits.hamming_distance("x", "y").alias("hamming"),
                       r6(bits.jaccard_distance("x", "y")).alias("jaccard"))


_HALF = f"""{PAIRED}, h AS (SELECT vec_id, list_transform(a, lambda x: {sql_half('x')}) AS a,
  list_transform(b, lambda x: {sql_half('x')}) AS b FROM p)"""


def _halves(spark, sf):
    return with_center(spark, sf).select("vec_id", half.to_half("embedding").alias("a"), half.to_half("center").alias("b"))


@query("half_distances", f"""{_HALF} SELECT vec_id, {sql_r6(sql_l2('a', 'b'))} AS l2, {sql_r6(sql_ip('a', 'b'))} AS ip,
  {sql_r6(sql_cosine('a', 'b'))} AS cosine, {sql_r6(sql_l1('a', 'b'))} AS l1,
  {sql_r6("sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[]))")} AS norm FROM h""")
def half_distances(spark, sf):
    return _halves(spark, sf).select(
        "vec_id", r6(half.l2_distance("a", "b")).alias("l2"), r6(half.inner_product("a", "b")).alias("ip"),
        r6(half.cosine_distance("a", "b")).alias("cosine"), r6(half.l1_distance("a", "b")).alias("l1"),
        r6(half.l2_norm("a")).alias("norm"))


def _sql_half_op(op: str) -> str:
    return f"list_transform(list_zip(a, b), lambda p: {sql_half(f'(p[1]::DOUBLE {op} p[2]::DOUBLE)')})"


@query("half_arithmetic", f"""{_HALF} SELECT vec_id, {_sql_summed(_sql_half_op('+'))} AS added,
  {_sql_summed(_sql_half_op('-'))} AS subtracted, {_sql_summed('list_concat(a, b)')} AS joined,
  {_sql_summed('list_slice(a, 3, 10)')} AS part, {sql_bits('b')} AS bits FROM h""")
def half_arithmetic(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _halves(spark, sf).select(
        "vec_id", _summed(half.halfvec_add(a, b)).alias("added"), _summed(half.halfvec_sub(a, b)).alias("subtracted"),
        _summed(half.halfvec_concat(a, b)).alias("joined"), _summed(half.subvector(a, F.lit(3), F.lit(8))).alias("part"),
        bits.bits_to_text(bits.binary_quantize(b)).alias("bits"))


@query("half_comparisons", f"""{_HALF} SELECT vec_id, a < b AS lt, a = b AS eq,
  (CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)::INT AS cmp, len(a)::INT AS dims,
  {sql_r6(f"acos(least(greatest({sql_ip('a', 'b')}, -1), 1)) / pi()")} AS spherical FROM h""")
def half_comparisons(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _halves(spark, sf).select(
        "vec_id", (a < b).alias("lt"), (a == b).alias("eq"), half.halfvec_cmp(a, b).alias("cmp"),
        half.vector_dims(a).alias("dims"), r6(half.spherical_distance(a, b)).alias("spherical"))


@query("half_normalize", f"""{_HALF}, n AS (SELECT vec_id, list_transform(b, lambda x:
  (x::DOUBLE / sqrt(list_inner_product(b::DOUBLE[], b::DOUBLE[])))::FLOAT) AS u FROM h)
  SELECT vec_id, {_sql_summed(f"list_transform(u, lambda x: {sql_half('x')})")} AS value FROM n""")
def half_normalize(spark, sf):
    return _halves(spark, sf).select("vec_id", _summed(half.l2_normalize("b")).alias("value"))


@query("label_assignment", """SELECT count(*) AS rows, count(quality) AS kept, 0 AS outside FROM documents
  LEFT JOIN labels USING (doc_id)""")
def label_assignment(spark, sf):
    """Documents without a label draw one of 1..12; labelled ones keep theirs."""
    tagged = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    drawn = assign_labels(tagged.withColumn("tag", F.col("quality")), "tag", 12, "doc_id")
    wrong = F.when(F.col("quality").isNull() & ~F.col("tag").between(1, 12), 1)
    return drawn.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("tag") == F.col("quality"), 1)).alias("kept"),
                     F.count(wrong).cast("int").alias("outside"))


# Sparse vectors: embeddings whose small elements are set to zero.
_THIN = 0.1
_SPARSE = f"""{PAIRED}, s AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN abs(x) < {_THIN} THEN 0 ELSE x END) AS a,
  b FROM p)"""


def thinned(vector):
    return F.transform(vector, lambda x: F.when(F.abs(x) < F.lit(_THIN), F.lit(0.0)).otherwise(x).cast("float"))


def _sparse_rows(spark, sf):
    return with_center(spark, sf).select("vec_id", sparse.dense_to_sparse(thinned("embedding")).alias("a"),
                                         sparse.dense_to_sparse("center").alias("b"))


@query("sparse_distances", f"""{_SPARSE} SELECT vec_id, {sql_r6(sql_l2('a', 'b'))} AS l2, {sql_r6(sql_ip('a', 'b'))} AS ip,
  {sql_r6(sql_cosine('a', 'b'))} AS cosine, {sql_r6(sql_l1('a', 'b'))} AS l1,
  {sql_r6("sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[]))")} AS norm FROM s""")
def sparse_distances(spark, sf):
    return _sparse_rows(spark, sf).select(
        "vec_id", r6(sparse.l2_distance("a", "b")).alias("l2"), r6(sparse.inner_product("a", "b")).alias("ip"),
        r6(sparse.cosine_distance("a", "b")).alias("cosine"), r6(sparse.l1_distance("a", "b")).alias("l1"),
        r6(sparse.l2_norm("a")).alias("norm"))


@query("sparse_order_and_casts", f"""{_SPARSE} SELECT vec_id, len(list_filter(a, lambda x: x <> 0))::INT AS nnz,
  {_sql_summed('a')} AS dense_sum, (CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)::INT AS cmp,
  {_sql_summed("list_transform(a, lambda x: (x::DOUBLE / sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[])))::FLOAT)")}
  AS unit_sum FROM s""")
def sparse_order_and_casts(spark, sf):
    unit = casts.sparse_to_vector(sparse.l2_normalize("a"))
    return _sparse_rows(spark, sf).select(
        "vec_id", F.size("a.indices").alias("nnz"), _summed(casts.sparse_to_vector("a")).alias("dense_sum"),
        sparse.sparsevec_cmp("a", "b").alias("cmp"), _summed(unit).alias("unit_sum"))


@query("sparse_sort", f"""WITH s AS (SELECT vec_id,
  list_transform(embedding, lambda x: CASE WHEN abs(x) < {_THIN} THEN 0 ELSE x END) AS a FROM embeddings)
  SELECT vec_id, row_number() OVER (ORDER BY a, vec_id)::INT AS place FROM s""")
def sparse_sort(spark, sf):
    rows = embeddings(spark, sf).select("vec_id", sparse.dense_to_sparse(thinned("embedding")).alias("a"))
    return numbered(rows.withColumn("k", sparse.sparse_sort_key("a")), ["k", "vec_id"]).select("vec_id", "place")


@query("sort_by_vector", """SELECT vec_id, row_number() OVER (ORDER BY embedding, vec_id)::INT AS place FROM embeddings""")
def sort_by_vector(spark, sf):
    return numbered(embeddings(spark, sf), ["embedding", "vec_id"]).select("vec_id", "place")


def numbered(df, order):
    """Number the rows of a whole table in sort order without gathering it in one task.

    The range partitions of a sort are counted first; a row's place is its place
    in the partition plus the rows of the partitions before it.
    """
    from pyspark.sql import Window
    from vecspark.session import materialize
    spread = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    spread = materialize(spread.select(*order, *[c for c in df.columns if c not in order], "__part"), "numbered")
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (spread.withColumn("__place", inner).join(before, "__part")
            .withColumn("place", (F.col("__place") + F.col("__before")).cast("int")))


@query("casts_from_arrays", """SELECT l_orderkey, l_linenumber,
  round(l_quantity::FLOAT::DOUBLE + 2 * l_extendedprice::FLOAT::DOUBLE + 3 * l_discount::FLOAT::DOUBLE
        + 4 * l_tax::FLOAT::DOUBLE, 4) + 0.0 AS value,
  len(list_filter([l_quantity, l_extendedprice, l_discount, l_tax], lambda x: x <> 0))::INT AS nnz FROM lineitem""")
def casts_from_arrays(spark, sf):
    doubles = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", casts.to_vector(doubles, 4).alias("v"),
                                               casts.to_sparsevec(doubles, 4).alias("s"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("l_orderkey", "l_linenumber", (F.round(weighted, 4) + F.lit(0.0)).alias("value"),
                       F.size("s.indices").alias("nnz"))


@query("half_cast", f"""SELECT vec_id, {_sql_summed(f"list_transform(embedding, lambda x: {sql_half('x')})")} AS value
  FROM embeddings""")
def half_cast(spark, sf):
    return embeddings(spark, sf).select("vec_id", _summed(casts.to_halfvec("embedding", DIM)).alias("value"))


@query("text_format", """SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: x::VARCHAR), ',') || ']'
  AS text FROM embeddings""")
def text_format(spark, sf):
    return export_text(embeddings(spark, sf), "embedding").select("vec_id", "text")


@query("text_ingest", """SELECT p_partkey, 3 AS dims, round(p_size::FLOAT + 2 * p_retailprice::FLOAT::DOUBLE - 3 * 0.5, 4) + 0.0 AS value
  FROM part""")
def text_ingest(spark, sf):
    literal = F.concat(F.lit("[ "), F.col("p_size").cast("string"), F.lit(" ,"), F.col("p_retailprice").cast("string"),
                       F.lit(",-5e-1]"))
    valid, _ = ingest_text(table(spark, sf, "part").withColumn("t", literal), "t", "vector", 3, "v")
    v = F.col("v")
    return valid.select("p_partkey", F.size(v).alias("dims"), (F.round(
        v[0].cast("double") + 2 * v[1].cast("double") + 3 * v[2].cast("double"), 4) + F.lit(0.0)).alias("value"))


@query("text_rejects", """SELECT p_partkey, 'invalid input syntax for type vector: "[' || p_name || ']"' AS reason FROM part""")
def text_rejects(spark, sf):
    rows = table(spark, sf, "part").withColumn("t", F.concat(F.lit("["), F.col("p_name"), F.lit("]")))
    _, rejects = ingest_text(rows, "t")
    return rejects.select("p_partkey", "reason")


@query("text_ingest_sparse", """SELECT s_suppkey, 5 AS dim, (CASE WHEN s_nationkey = 0 THEN 1 ELSE 2 END)::INT AS nnz,
  s_nationkey::DOUBLE AS second FROM supplier""")
def text_ingest_sparse(spark, sf):
    literal = F.concat(F.lit("{4:1.5, 2:"), F.col("s_nationkey").cast("string"), F.lit("}/5"))
    valid, _ = ingest_text(table(spark, sf, "supplier").withColumn("t", literal), "t", "sparsevec", 5, "v")
    second = casts.sparse_to_vector("v")[1].cast("double")
    return valid.select("s_suppkey", F.col("v.dim").alias("dim"), F.size("v.indices").alias("nnz"), second.alias("second"))


@query("parquet_round_trip", f"""SELECT vec_id, {_sql_summed('embedding')} AS value FROM embeddings""")
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "vectors")
    write_vectors(embeddings(spark, sf), path, "embedding", "vector", DIM)
    return read_vectors(spark, path, "embedding").select("vec_id", _summed("embedding").alias("value"))


@query("sparse_parquet_round_trip", f"""WITH s AS (SELECT vec_id,
  list_transform(embedding, lambda x: CASE WHEN abs(x) < {_THIN} THEN 0 ELSE x END) AS a FROM embeddings)
  SELECT vec_id, {_sql_summed('a')} AS value FROM s""")
def sparse_parquet_round_trip(spark, sf):
    path = scratch_path(spark, "sparse")
    rows = embeddings(spark, sf).select("vec_id", sparse.dense_to_sparse(thinned("embedding")).alias("v"))
    write_vectors(rows, path, "v", "sparsevec", DIM)
    return read_vectors(spark, path, "v").select("vec_id", _summed(sparse.sparse_to_dense("v")).alias("value"))


@query("unnest_vectors", f"""{PAIRED}, u AS (SELECT vec_id, unnest([a, b]) AS v FROM p)
  SELECT vec_id, {_sql_summed('v')} AS value FROM u""")
def unnest_vectors(spark, sf):
    rows = with_center(spark, sf).select("vec_id", F.explode(F.array("embedding", "center")).alias("v"))
    return rows.select("vec_id", _summed("v").alias("value"))


def _elements(df, vector, *keys):
    """One row per element, so that whole vectors are compared."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).select(
        *keys, (F.col("pos") + 1).alias("pos"), r6(F.col("x").cast("double")).alias("value"))


_UNNESTED = "SELECT {keys}unnest({vec}) AS x, generate_subscripts({vec}, 1) AS i FROM {source}"


@query("avg_vector", f"""SELECT label, i::INT AS pos, {sql_r6('avg(x::DOUBLE)::FLOAT::DOUBLE')} AS value
  FROM ({_UNNESTED.format(keys='label, ', vec='embedding', source='embeddings')}) GROUP BY label, i""")
def avg_vector(spark, sf):
    return _elements(label_centers(spark, sf), "center", "label")


@query("avg_vector_undeclared", f"""SELECT i::INT AS pos, {sql_r6('avg(x::DOUBLE)::FLOAT::DOUBLE')} AS value
  FROM ({_UNNESTED.format(keys='', vec='embedding', source='embeddings')}) GROUP BY i""")
def avg_vector_undeclared(spark, sf):
    return _elements(vec_avg(embeddings(spark, sf), "embedding", alias="v"), "v")


@query("sum_vector", f"""WITH {SCALED} SELECT label, i::INT AS pos, round(sum(x::DOUBLE)::FLOAT::DOUBLE, 4) + 0.0 AS value
  FROM ({_UNNESTED.format(keys='label, ', vec='embedding', source='sv')}) GROUP BY label, i""")
def sum_vector(spark, sf):
    total = vec_sum(scaled(spark, sf), "embedding", "label", DIM)
    return total.select("label", F.posexplode("sum").alias("pos", "x")).select(
        "label", (F.col("pos") + 1).alias("pos"), (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("value"))


_HALVED = f"hv AS (SELECT label, list_transform(embedding, lambda x: {sql_half('x')}) AS h FROM embeddings)"


@query("avg_sum_halfvec", f"""WITH {_HALVED}, u AS ({_UNNESTED.format(keys='label, ', vec='h', source='hv')}),
  g AS (SELECT label, i, avg(x::DOUBLE)::FLOAT AS m, sum(x::DOUBLE) AS t FROM u GROUP BY label, i)
  SELECT label, i::INT AS pos, {sql_r6(sql_half('m') + '::DOUBLE')} AS mean, {sql_r6(sql_half('t') + '::DOUBLE')} AS total FROM g""")
def avg_sum_halfvec(spark, sf):
    rows = embeddings(spark, sf).withColumn("h", half.to_half("embedding"))
    mean = half_avg(rows, "h", "label", DIM, "mean")
    total = half_sum(rows, "h", "label", DIM, "total")
    both = mean.join(total, "label").select("label", F.posexplode(F.arrays_zip("mean", "total")).alias("pos", "x"))
    return both.select("label", (F.col("pos") + 1).alias("pos"), r6(F.col("x.mean").cast("double")).alias("mean"),
                       r6(F.col("x.total").cast("double")).alias("total"))


@query("avg_lineitem_features", """SELECT l_suppkey, round(avg(l_quantity::FLOAT::DOUBLE)::FLOAT::DOUBLE, 3) + 0.0 AS q,
  round(avg(l_extendedprice::FLOAT::DOUBLE)::FLOAT::DOUBLE, 1) + 0.0 AS p, round(avg(l_discount::FLOAT::DOUBLE)::FLOAT::DOUBLE, 5) + 0.0 AS d
  FROM lineitem GROUP BY l_suppkey""")
def avg_lineitem_features(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", F.array(*[F.col(c).cast("float") for c in ("l_quantity", "l_extendedprice", "l_discount")]).alias("v"))
    mean = vec_avg(rows, "v", "l_suppkey", 3, "v")
    v = F.col("v")
    return mean.select("l_suppkey", *[(F.round(v[i].cast("double"), places) + F.lit(0.0)).alias(name)
                                      for i, (name, places) in enumerate([("q", 3), ("p", 1), ("d", 5)])])


@query("group_by_bits", f"""SELECT b AS bits, count(*) AS rows FROM (
  SELECT {sql_bits('embedding')} AS b FROM embeddings) GROUP BY 1""")
def group_by_bits(spark, sf):
    grouped = embeddings(spark, sf).groupBy(bits.binary_quantize("embedding").alias("b")).agg(F.count(F.lit(1)).alias("rows"))
    return grouped.select(bits.bits_to_text("b").alias("bits"), "rows")


@query("group_by_vector", """SELECT l_quantity::INT AS quantity, l_linenumber AS line, count(*) AS rows FROM lineitem
  GROUP BY l_quantity, l_linenumber""")
def group_by_vector(spark, sf):
    v = casts.to_vector(F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double")), 2)
    grouped = table(spark, sf, "lineitem").groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("rows"))
    return grouped.select(F.col("v")[0].cast("int").alias("quantity"), F.col("v")[1].cast("int").alias("line"), "rows")


@query("distinct_vectors", """SELECT count(*) AS vectors FROM (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem)""")
def distinct_vectors(spark, sf):
    v = casts.to_vector(F.array("l_quantity", "l_discount", "l_tax"), 3)
    return table(spark, sf, "lineitem").select(v.alias("v")).dropDuplicates().agg(F.count(F.lit(1)).alias("vectors"))


@query("vector_from_rows", """SELECT l_orderkey, count(*)::INT AS dims,
  round(sum(l_extendedprice::FLOAT::DOUBLE * l_linenumber), 2) + 0.0 AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem) GROUP BY l_orderkey""")
def vector_from_rows(spark, sf):
    lines = table(spark, sf, "lineitem")
    built = vec_from_rows(lines, "l_extendedprice", "l_linenumber", "l_orderkey", "v")
    places = vec_from_rows(lines, "l_linenumber", "l_linenumber", "l_orderkey", "n")
    value = F.aggregate(F.zip_with("v", "n", lambda x, n: x.cast("double") * n.cast("double")), F.lit(0.0),
                        lambda s, x: s + x)
    return built.join(places, "l_orderkey").select("l_orderkey", F.size("v").alias("dims"),
                                                   (F.round(value, 2) + F.lit(0.0)).alias("value"))


@query("sql_functions", f"""{PAIRED} SELECT label, count(*) AS rows, {sql_r6(f"avg({sql_l2('a', 'b')})")} AS mean_l2,
  {sql_r6(f"avg({sql_cosine('a', 'b')})")} AS mean_cosine, {sql_r6("max(sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[])))")}
  AS max_norm FROM p GROUP BY label""")
def sql_functions(spark, sf):
    from vecspark.functions.sql import register_sql_functions
    register_sql_functions(spark, ["vec_l2_distance", "vec_cosine_distance", "vec_norm"])
    with_center(spark, sf).createOrReplaceTempView("vec_pairs")
    return spark.sql("""SELECT label, count(*) AS rows, round(avg(vec_l2_distance(embedding, center)), 6) + 0D AS mean_l2,
        round(avg(vec_cosine_distance(embedding, center)), 6) + 0D AS mean_cosine,
        round(max(vec_norm(embedding)), 6) + 0D AS max_norm FROM vec_pairs GROUP BY label""")




@query("sql_functions_of_all_types", f"""{PAIRED} SELECT label, {sql_r6(f"avg({sql_l2('a', 'b')})")} AS sparse_l2,
  {sql_r6("avg(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))))")} AS l1, 2 * len(any_value(a))::INT AS dims,
  {sql_r6("avg(len(list_filter(list_zip(a, b), lambda p: (p[1] > 0) <> (p[2] > 0))))")} AS hamming FROM p GROUP BY label""")
def sql_functions_of_all_types(spark, sf):
    """Casts, sparse and bit functions under their SQL names."""
    from vecspark.functions.sql import register_sql_functions
    register_sql_functions(spark, ["sparse_l2_distance", "vec_to_sparse", "vec_l1_distance", "sparse_to_vec", "bit_hamming_distance",
                                   "vec_binary_quantize", "vec_concat", "vec_dims"])
    with_center(spark, sf).createOrReplaceTempView("vec_typed")
    return spark.sql("""SELECT label, round(avg(sparse_l2_distance(vec_to_sparse(embedding), vec_to_sparse(center))), 6) + 0D AS sparse_l2,
        round(avg(vec_l1_distance(sparse_to_vec(vec_to_sparse(embedding)), center)), 6) + 0D AS l1,
        max(vec_dims(vec_concat(embedding, center))) AS dims,
        round(avg(bit_hamming_distance(vec_binary_quantize(embedding), vec_binary_quantize(center))), 6) + 0D AS hamming
        FROM vec_typed GROUP BY label""")


@query("sparse_sort_mixed_dims", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey,
   list_transform(range(1, 3 + l_linenumber % 4), lambda i: ((l_partkey + i * l_suppkey) % 5 - 2)::FLOAT) AS a,
   list_transform(range(1, 3 + l_orderkey % 4), lambda i: ((l_orderkey + i * 3) % 5 - 2)::FLOAT) AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END::INT AS cmp FROM s""")
def sparse_sort_mixed_dims(spark, sf):
    """Sparse vectors of different dimensions, compared."""
    def cells(n, element):
        return sparse.dense_to_sparse(F.transform(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")),
                                                  lambda i: (F.pmod(element(i), F.lit(5)) - 2).cast("float")))
    line = F.col("l_linenumber")
    a = cells(2 + line % 4, lambda i: F.col("l_partkey") + i * F.col("l_suppkey"))
    b = cells(2 + F.col("l_orderkey") % 4, lambda i: F.col("l_orderkey") + i * 3)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", sparse.sparsevec_cmp("a", "b").alias("cmp"))


_HUGE = 3.4028234663852886e38


@query("sql_functions_overflow", f"""WITH s AS (SELECT vec_id, embedding AS b,
   list_transform(embedding, lambda x: (x::DOUBLE * pow(10.0, 4 * label))::FLOAT) AS a FROM embeddings),
  d AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))) AS l2,
   {sql_ip('a', 'a')} AS ip FROM s)
  SELECT vec_id, l2 > {_HUGE} AS l2_over, ip > {_HUGE} AS ip_over, ip > {_HUGE} AS cosine_nan FROM d""")
def sql_functions_overflow(spark, sf):
    """Sums beyond the range of a float are infinite under the SQL names too."""
    from vecspark.functions.sql import register_sql_functions
    register_sql_functions(spark, ["vec_l2_distance", "vec_inner_product", "vec_cosine_distance"])
    grown = F.transform("embedding", lambda x: (x.cast("double") * F.pow(F.lit(10.0), 4 * F.col("label"))).cast("float"))
    embeddings(spark, sf).select("vec_id", grown.alias("a"), F.col("embedding").alias("b")).createOrReplaceTempView("vec_huge")
    return spark.sql("""SELECT vec_id, vec_l2_distance(a, b) = double('Infinity') AS l2_over,
        vec_inner_product(a, a) = double('Infinity') AS ip_over, isnan(vec_cosine_distance(a, a)) AS cosine_nan FROM vec_huge""")


@query("half_text_round_trip", f"""SELECT p_partkey, 2 AS dims, {sql_r6(f"{sql_half('p_size')} + 2 * {sql_half('p_size / 7.0')}::DOUBLE")} AS value,
  true AS same FROM part""")
def half_text_round_trip(spark, sf):
    """Text to halves and back to text; the text of a half reads as the same half."""
    literal = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") / 7).cast("string"), F.lit("]"))
    once = table(spark, sf, "part").select("p_partkey", text.parse_halfvec(literal, 2)["value"].alias("v"))
    twice = once.withColumn("w", text.parse_halfvec(text.format_halfvec("v"), 2)["value"])
    return twice.select("p_partkey", F.size("v").alias("dims"), _summed("v").alias("value"), (F.col("v") == F.col("w")).alias("same"))


@query("sparse_text_round_trip", f"""{_SPARSE} SELECT vec_id, len(list_filter(a, lambda x: x <> 0))::INT AS nnz, true AS same FROM s""")
def sparse_text_round_trip(spark, sf):
    rows = _sparse_rows(spark, sf).select("vec_id", "a", text.parse_sparsevec(text.format_sparsevec("a"))["value"].alias("b"))
    near = F.aggregate(F.zip_with(F.col("a.values"), F.col("b.values"), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.size("a.indices").alias("nnz"),
                       ((F.col("a.indices") == F.col("b.indices")) & (F.col("a.dim") == F.col("b.dim")) & (near < 1e-4)).alias("same"))


_SHIFTED = f"""{PAIRED}, h AS (SELECT vec_id, list_transform(a, lambda x: {sql_half('(x + 1)::FLOAT')}) AS a,
  list_transform(b, lambda x: {sql_half('(x + 1)::FLOAT')}) AS b FROM p)"""


@query("half_products", f"""{_SHIFTED} SELECT vec_id, {_sql_summed(_sql_half_op('*'))} AS multiplied,
  {sql_r6(f"pow({sql_l2('a', 'b')}, 2)")} AS l2_squared FROM h""")
def half_products(spark, sf):
    def shifted(v):
        return half.to_half(F.transform(v, lambda x: (x + 1).cast("float")))
    rows = with_center(spark, sf).select("vec_id", shifted("embedding").alias("a"), shifted("center").alias("b"))
    return rows.select("vec_id", _summed(half.halfvec_mul("a", "b")).alias("multiplied"), r6(half.l2_squared_distance("a", "b")).alias("l2_squared"))


@query("half_sparse_casts", f"""{_SPARSE} SELECT vec_id, {_sql_summed(f"list_transform(a, lambda x: {sql_half('x')})")} AS value FROM s""")
def half_sparse_casts(spark, sf):
    back = sparse.dense_to_sparse(casts.sparse_to_halfvec("a"))
    return _sparse_rows(spark, sf).select("vec_id", _summed(casts.sparse_to_vector(back)).alias("value"))


@query("casts_from_numbers", """SELECT l_orderkey, l_linenumber, (l_linenumber + 2 * l_suppkey)::DOUBLE AS ints,
  round(l_quantity::FLOAT::DOUBLE + 2 * l_tax::FLOAT::DOUBLE, 4) + 0.0 AS reals,
  round(l_extendedprice::DECIMAL(14, 2)::FLOAT::DOUBLE, 2) + 0.0 AS decimals FROM lineitem""")
def casts_from_numbers(spark, sf):
    """Arrays of int, real and decimal numbers to vectors, and back to arrays."""
    ints = casts.to_vector(F.array(F.col("l_linenumber").cast("int"), F.col("l_suppkey").cast("int")), 2)
    reals = casts.to_vector(F.array(F.col("l_quantity").cast("float"), F.col("l_tax").cast("float")), 2)
    decimals = casts.to_vector(F.array(F.col("l_extendedprice").cast("decimal(14,2)")), 1)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(
        casts.to_array(v).alias(n) for n, v in (("i", ints), ("r", reals), ("d", decimals))))
    x = lambda c, i: F.col(c)[i].cast("double")
    return rows.select("l_orderkey", "l_linenumber", (x("i", 0) + 2 * x("i", 1)).alias("ints"),
                       (F.round(x("r", 0) + 2 * x("r", 1), 4) + F.lit(0.0)).alias("reals"), (F.round(x("d", 0), 2) + F.lit(0.0)).alias("decimals"))
