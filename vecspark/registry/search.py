"""Exact search, filters, joins, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.functions import bits, dense, sparse
from vecspark.operators import evaluate
from vecspark.operators.aggregates import vec_avg
from vecspark.operators.hybrid import predicate, pre_filter_knn, route, strictness
from vecspark.operators.knn import knn, knn_join, range_join, range_search, with_ties
from vecspark.operators.rerank import half_knn, quantized_knn
from vecspark.registry import query
from vecspark.registry.common import (DIM, MEAN, SCALED, as_queries, embeddings, r6, ranked,
                                      scaled, sql_bits, sql_cosine, sql_half, sql_knn_join, sql_l2, sql_r6, table)
from vecspark.registry.functions import _THIN, thinned
from vecspark.session import materialize

K = 10


def _mean(spark, sf):
    """The mean of all embeddings: one row, used as a subquery."""
    return vec_avg(embeddings(spark, sf), "embedding", dim=DIM)


def _sql_single(where: str = "true", k: int = K, dist: str = sql_l2("embedding", "q"), source: str = "embeddings",
                with_: str = "") -> str:
    more = f", {with_}" if with_ else ""
    return f"""WITH {MEAN}{more} SELECT vec_id, {sql_r6('distance')} AS distance FROM (
      SELECT vec_id, {dist} AS distance FROM {source}, mean WHERE {where}) ORDER BY distance, vec_id LIMIT {k}"""


def _single(df):
    return df.select("vec_id", r6(F.col("distance")).alias("distance"))


# One query vector: the mean of the table, as a subquery.

@query("knn_single_l2", _sql_single())
def knn_single_l2(spark, sf):
    return _single(knn(embeddings(spark, sf), _mean(spark, sf), K, "l2", id="vec_id"))


@query("knn_single_cosine", _sql_single(dist=sql_cosine("embedding", "q"), source="sv", with_=SCALED))
def knn_single_cosine(spark, sf):
    return _single(knn(scaled(spark, sf), _mean(spark, sf), K, "cosine", id="vec_id"))


@query("distance_sort_all", f"""WITH {MEAN} SELECT vec_id, {sql_r6('distance')} AS distance,
  row_number() OVER (ORDER BY distance, vec_id)::INT AS place FROM (
  SELECT vec_id, {sql_l2('embedding', 'q')} AS distance FROM embeddings, mean)""")
def distance_sort_all(spark, sf):
    from vecspark.registry.functions import numbered
    rows = range_search(embeddings(spark, sf), _mean(spark, sf)).select("vec_id", "distance")
    return numbered(rows, ["distance", "vec_id"]).select("vec_id", r6(F.col("distance")).alias("distance"), "place")


_FILTERS = [
    ("filter_equal_knn", {"label": 3}, "label = 3"),
    ("filter_not_equal_knn", {"label !=": 3}, "label <> 3"),
    ("filter_range_knn", {"label >=": 4, "label <": 8}, "label >= 4 AND label < 8"),
    ("filter_dict_empty_knn", {}, "true"),
]


def _register_filter(name, filters, sql):
    @query(name, _sql_single(sql))
    def run(spark, sf):
        return _single(knn(embeddings(spark, sf).filter(predicate(filters)), _mean(spark, sf), K, id="vec_id"))


for _name, _filters, _sql in _FILTERS:
    _register_filter(_name, _filters, _sql)


@query("filter_modulo_knn", _sql_single("label % 4 = 1"))
def filter_modulo_knn(spark, sf):
    return _single(knn(embeddings(spark, sf).filter(F.col("label") % 4 == 1), _mean(spark, sf), K, id="vec_id"))


@query("filter_like_knn", f"""WITH {MEAN} SELECT vec_id, {sql_r6('distance')} AS distance FROM (
  SELECT vec_id, {sql_l2('embedding', 'q')} AS distance FROM embeddings JOIN documents ON doc_id = vec_id, mean
  WHERE source LIKE '%src1%') ORDER BY distance, vec_id LIMIT {K}""")
def filter_like_knn(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("source").like("%src1%")).select(F.col("doc_id").alias("vec_id"))
    return _single(knn(embeddings(spark, sf).join(docs, "vec_id"), _mean(spark, sf), K, id="vec_id"))


@query("filter_null_knn", f"""WITH {MEAN} SELECT vec_id, {sql_r6('distance')} AS distance FROM (
  SELECT vec_id, {sql_l2('embedding', 'q')} AS distance FROM embeddings LEFT JOIN labels ON doc_id = vec_id, mean
  WHERE quality IS NULL) ORDER BY distance, vec_id LIMIT {K}""")
def filter_null_knn(spark, sf):
    tagged = embeddings(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    return _single(knn(tagged.filter(F.col("quality").isNull()), _mean(spark, sf), K, id="vec_id"))


@query("dimension_join_knn", f"""WITH {MEAN} SELECT vec_id, lang, {sql_r6('distance')} AS distance FROM (
  SELECT vec_id, lang, {sql_l2('embedding', 'q')} AS distance FROM embeddings JOIN documents ON doc_id = vec_id, mean
  WHERE lang = 'en') ORDER BY distance, vec_id LIMIT {K}""")
def dimension_join_knn(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("vec_id"), "lang")
    found = knn(embeddings(spark, sf).join(docs, "vec_id"), _mean(spark, sf), K, id="vec_id")
    return found.select("vec_id", "lang", r6(F.col("distance")).alias("distance"))


@query("range_search_below", f"""WITH {MEAN} SELECT vec_id, {sql_r6('distance')} AS distance FROM (
  SELECT vec_id, {sql_l2('embedding', 'q')} AS distance FROM embeddings, mean) WHERE distance < 0.99""")
def range_search_below(spark, sf):
    return _single(range_search(embeddings(spark, sf), _mean(spark, sf), below=0.99))


@query("range_filter_knn", f"""WITH {MEAN} SELECT vec_id, {sql_r6('distance')} AS distance FROM (
  SELECT vec_id, {sql_l2('embedding', 'q')} AS distance FROM embeddings, mean) WHERE distance > 0.99
  ORDER BY distance, vec_id LIMIT {K}""")
def range_filter_knn(spark, sf):
    far = range_search(embeddings(spark, sf), _mean(spark, sf), above=0.99)
    return _single(far.orderBy("distance", "vec_id").limit(K))


@query("similarity_projection", f"""WITH {MEAN} SELECT vec_id, {sql_r6(f"1 - {sql_l2('embedding', 'q')}")} AS similarity
  FROM embeddings, mean""")
def similarity_projection(spark, sf):
    rows = range_search(embeddings(spark, sf), _mean(spark, sf))
    return rows.select("vec_id", r6(1 - F.col("distance")).alias("similarity"))


@query("count_over_knn", f"""SELECT least(count(*), 11) AS rows FROM embeddings WHERE label = 3""")
def count_over_knn(spark, sf):
    found = knn(embeddings(spark, sf).filter(F.col("label") == 3), _mean(spark, sf), 11, id="vec_id")
    return found.agg(F.count(F.lit(1)).alias("rows"))


# Many query vectors: every embedding.

def _register_join(name, metric, source_sql, source, on_sql, on):
    with_ = SCALED if source_sql == "sv" else ""

    @query(name, sql_knn_join(metric, K, with_, source_sql, source_sql, on_sql))
    def run(spark, sf):
        rows = source(spark, sf)
        return ranked(knn_join(rows, as_queries(rows), K, metric, base_id="vec_id", on=on))


_register_join("knn_join_l2", "l2", "embeddings", embeddings, "true", None)
_register_join("knn_join_same_label", "l2", "embeddings", embeddings, "b.label = q.label", "label")
_register_join("knn_join_scaled_l2", "l2", "sv", scaled, "true", None)
_register_join("knn_join_ip", "ip", "sv", scaled, "true", None)
_register_join("knn_join_cosine", "cosine", "sv", scaled, "true", None)
_register_join("knn_join_l1", "l1", "sv", scaled, "true", None)
_register_join("knn_join_ip_same_label", "ip", "sv", scaled, "b.label = q.label", "label")


@query("knn_join_blocks", sql_knn_join("l2", K, "", on="b.label = q.label"))
def knn_join_blocks(spark, sf):
    """The plan for query sets too large to travel with the tasks."""
    rows = embeddings(spark, sf)
    return ranked(knn_join(rows, as_queries(rows), K, base_id="vec_id", on="label", strategy="blocks"))


_LINES = """li AS (SELECT l_orderkey * 8 + l_linenumber AS vec_id, l_suppkey, l_returnflag,
  [l_quantity::FLOAT, (l_discount * 100)::INT::FLOAT, (l_tax * 100)::INT::FLOAT, l_linenumber::FLOAT] AS embedding FROM lineitem),
 sup AS (SELECT l_suppkey AS query_id, [avg(embedding[1])::FLOAT, avg(embedding[2])::FLOAT, avg(embedding[3])::FLOAT,
  avg(embedding[4])::FLOAT] AS qv FROM li GROUP BY l_suppkey)"""


def lineitem_features(spark, sf):
    features = [F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100),
                F.col("l_linenumber").cast("double")]
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vec_id"), "l_suppkey", "l_returnflag",
        F.array(*[f.cast("float") for f in features]).alias("embedding"))


def supplier_queries(spark, sf):
    """The mean features of every supplier's lines."""
    mean = vec_avg(lineitem_features(spark, sf), "embedding", "l_suppkey", 4, "qv")
    return mean.withColumnRenamed("l_suppkey", "query_id")


@query("knn_join_lineitem", sql_knn_join("l2", K, _LINES, "li", "sup", query_id="q.query_id", query_vec="q.qv"))
def knn_join_lineitem(spark, sf):
    return ranked(knn_join(lineitem_features(spark, sf), supplier_queries(spark, sf), K, base_id="vec_id", query_vec="qv"))


@query("knn_join_lineitem_supplier", sql_knn_join("l2", K, _LINES, "li", "sup", "b.l_suppkey = q.query_id",
                                                  query_id="q.query_id", query_vec="q.qv"))
def knn_join_lineitem_supplier(spark, sf):
    asked = supplier_queries(spark, sf).withColumn("key", F.col("query_id"))
    return ranked(knn_join(lineitem_features(spark, sf), asked, K, base_id="vec_id", query_vec="qv",
                           on=[("l_suppkey", "key")]))


@query("pre_filter_knn", sql_knn_join("l2", K, "", where="b.label = 3"))
def pre_filter(spark, sf):
    rows = embeddings(spark, sf)
    return ranked(pre_filter_knn(rows, as_queries(rows), predicate({"label": 3}), K, base_id="vec_id"))


_RADIUS = 1.05


@query("distance_join", f"""SELECT query_id, vec_id, {sql_r6('distance')} AS distance FROM (
  SELECT q.vec_id AS query_id, b.vec_id, {sql_l2('b.embedding', 'q.embedding')} AS distance FROM embeddings b, embeddings q)
  WHERE distance < {_RADIUS}""")
def distance_join(spark, sf):
    rows = embeddings(spark, sf)
    return range_join(rows, as_queries(rows), _RADIUS, base_id="vec_id").select(
        "query_id", "vec_id", r6(F.col("distance")).alias("distance"))


@query("knn_with_ties", f"""WITH li AS (SELECT l_orderkey * 8 + l_linenumber AS vec_id, l_returnflag,
  [l_quantity::FLOAT, l_linenumber::FLOAT] AS v FROM lineitem), d AS (
  SELECT l_returnflag, vec_id, {sql_l2('v', '[25.0::FLOAT, 3.0::FLOAT]')} AS distance FROM li)
  SELECT l_returnflag, vec_id, {sql_r6('distance')} AS distance FROM d JOIN (SELECT l_returnflag, max(distance) AS top FROM (
    SELECT l_returnflag, distance, row_number() OVER (PARTITION BY l_returnflag ORDER BY distance) AS rn FROM d) WHERE rn <= {K}
    GROUP BY l_returnflag) USING (l_returnflag) WHERE distance <= top""")
def knn_with_ties(spark, sf):
    from vecspark.types import vec_lit
    v = F.array(F.col("l_quantity").cast("float"), F.col("l_linenumber").cast("float"))
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vec_id"), "l_returnflag",
                                               dense.l2_distance(v, vec_lit([25, 3])).alias("distance"))
    return with_ties(rows, K, ["l_returnflag"]).select("l_returnflag", "vec_id", r6(F.col("distance")).alias("distance"))


@query("half_knn_join", sql_knn_join("l2", K, f"""h AS (SELECT vec_id,
  list_transform(embedding, lambda x: {sql_half('x')}) AS embedding FROM embeddings)""", "h", "h"))
def half_knn_join(spark, sf):
    rows = embeddings(spark, sf)
    return ranked(half_knn(rows, as_queries(rows), K, base_id="vec_id"))


_QBITS = f"qb AS (SELECT vec_id, embedding, {sql_bits('embedding')}::BIT AS bits FROM embeddings)"
_HAMMING = "bit_count(xor(b.bits, q.bits))::DOUBLE"
_JACCARD = ("CASE WHEN bit_count(b.bits & q.bits) = 0 THEN 1.0::DOUBLE "
            "ELSE 1 - bit_count(b.bits & q.bits)::DOUBLE / bit_count(b.bits | q.bits) END")


def _bit_rows(spark, sf):
    return embeddings(spark, sf).select("vec_id", "embedding", bits.binary_quantize("embedding").alias("bits"))


@query("bit_knn_hamming", sql_knn_join("l2", K, _QBITS, "qb", "qb", distance=_HAMMING))
def bit_knn_hamming(spark, sf):
    rows = _bit_rows(spark, sf)
    return ranked(knn_join(rows, as_queries(rows), K, "hamming", base_id="vec_id", base_vec="bits", query_vec="bits"))


@query("bit_knn_jaccard", sql_knn_join("l2", K, _QBITS, "qb", "qb", distance=_JACCARD))
def bit_knn_jaccard(spark, sf):
    rows = _bit_rows(spark, sf)
    return ranked(knn_join(rows, as_queries(rows), K, "jaccard", base_id="vec_id", base_vec="bits", query_vec="bits"))


@query("quantized_rerank", f"""WITH {_QBITS}, c AS (SELECT * FROM (
  SELECT q.vec_id AS query_id, b.vec_id, {sql_l2('b.embedding', 'q.embedding')} AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_HAMMING}, b.vec_id) AS coarse FROM qb b, qb q) WHERE coarse <= 50)
  SELECT query_id, vec_id, {sql_r6('distance')} AS distance, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM c) WHERE rank <= {K}""")
def quantized_rerank(spark, sf):
    rows = embeddings(spark, sf)
    return ranked(quantized_knn(rows, as_queries(rows), K, 50, base_id="vec_id"))


_SP = f"sp AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x) < {_THIN} THEN 0 ELSE x END) AS embedding FROM embeddings)"


def _sparse(spark, sf):
    return embeddings(spark, sf).select("vec_id", sparse.dense_to_sparse(thinned("embedding")).alias("embedding"))


def _register_sparse(metric):
    @query(f"sparse_knn_{metric}", sql_knn_join(metric, K, _SP, "sp", "sp"))
    def run(spark, sf):
        rows = _sparse(spark, sf)
        return ranked(knn_join(rows, as_queries(rows), K, f"sparse_{metric}", base_id="vec_id"))


for _metric in ("l2", "ip", "cosine", "l1"):
    _register_sparse(_metric)


# Evaluation.

_EXACT = f"""SELECT query_id, vec_id, label, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, b.vec_id, b.label, {sql_l2('b.embedding', 'q.embedding')} AS distance FROM embeddings b, embeddings q)"""


@query("ground_truth_table", f"SELECT query_id, vec_id, {sql_r6('distance')} AS distance, rank::INT AS rank FROM ({_EXACT}) WHERE rank <= {K}")
def ground_truth_table(spark, sf):
    rows = embeddings(spark, sf)
    return ranked(materialize(knn_join(rows, as_queries(rows), K, base_id="vec_id"), "truth"))


@query("recall_join", f"""WITH x AS ({_EXACT}), t AS (SELECT * FROM x WHERE rank <= {K}), f AS (SELECT * FROM x WHERE rank <= 2 * {K} AND label < 5)
  SELECT count(f.vec_id) AS hits, count(*) AS expected, {sql_r6('count(f.vec_id)::DOUBLE / count(*)')} AS recall
  FROM t LEFT JOIN f USING (query_id, vec_id)""")
def recall_join(spark, sf):
    rows = embeddings(spark, sf)
    wide = materialize(knn_join(rows, as_queries(rows), 2 * K, base_id="vec_id", payload=["label"]), "wide")
    out = evaluate.recall(wide.filter(F.col("label") < 5), wide.filter(F.col("rank") <= K), "query_id", "vec_id")
    return out.select("hits", "expected", r6(F.col("recall")).alias("recall"))


@query("result_summary", f"""SELECT count(*) AS queries, min(n) AS min_rows, max(n) AS max_rows, {sql_r6('avg(n)')} AS avg_rows FROM (
  SELECT query_id, count(*) AS n FROM ({_EXACT}) WHERE rank <= {K} AND distance < 1.1 GROUP BY query_id)""")
def result_summary(spark, sf):
    rows = embeddings(spark, sf)
    near = knn_join(rows, as_queries(rows), K, base_id="vec_id").filter(F.col("distance") < 1.1)
    out = evaluate.result_summary(near, "query_id")
    return out.select("queries", "min_rows", "max_rows", r6(F.col("avg_rows")).alias("avg_rows"))


@query("method_union", f"""SELECT 'same_label' AS method, count(*) AS rows FROM (
    {sql_knn_join('l2', K, on='b.label = q.label')}) UNION ALL
  SELECT 'all', count(*) FROM ({sql_knn_join('l2', K)})""")
def method_union(spark, sf):
    rows = embeddings(spark, sf)
    parts = []
    for method, on in (("same_label", "label"), ("all", None)):
        found = knn_join(rows, as_queries(rows), K, base_id="vec_id", on=on)
        parts.append(found.agg(F.lit(method).alias("method"), F.count(F.lit(1)).alias("rows")))
    return evaluate.compare(*parts)


@query("shared_results", f"""WITH x AS ({_EXACT}), a AS (SELECT query_id, list(vec_id) AS ids FROM x WHERE rank <= {K} GROUP BY query_id),
  b AS (SELECT q.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_l2('b.embedding', 'q.embedding')}, b.vec_id) AS rank
        FROM embeddings b JOIN embeddings q ON b.label = q.label),
  c AS (SELECT query_id, list(vec_id) AS ids FROM b WHERE rank <= {K} GROUP BY query_id)
  SELECT query_id, len(list_intersect(a.ids, c.ids))::INT AS shared FROM a JOIN c USING (query_id)""")
def shared_results(spark, sf):
    rows = embeddings(spark, sf)

    def ids(on, name):
        found = knn_join(rows, as_queries(rows), K, base_id="vec_id", on=on)
        return found.groupBy("query_id").agg(F.collect_list("vec_id").alias(name))

    return ids(None, "a").join(ids("label", "b"), "query_id").select(
        "query_id", F.size(F.array_intersect("a", "b")).alias("shared"))


@query("strict_order", """SELECT event_id, value FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE top IS NULL OR value >= top""")
def strict_order(spark, sf):
    """Keep a row only when nothing farther was emitted before it."""
    from vecspark.plans.graph import strictly_ordered
    return strictly_ordered(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value")


@query("router_strictness", f"""WITH s AS (SELECT 'label = 3' AS filter, 1 - count(*) FILTER (label = 3)::DOUBLE / count(*) AS share FROM embeddings
  UNION ALL SELECT 'label >= 5', 1 - count(*) FILTER (label >= 5)::DOUBLE / count(*) FROM embeddings
  UNION ALL SELECT 'label >= 1', 1 - count(*) FILTER (label >= 1)::DOUBLE / count(*) FROM embeddings)
  SELECT filter, {sql_r6('share')} AS strictness, CASE WHEN share >= 0.8 THEN 'filter_first' ELSE 'vector_first' END AS path,
    (CASE WHEN share >= 0.8 THEN 0 WHEN share >= 0.3 THEN 200 ELSE 40 END)::INT AS ef FROM s""")
def router_strictness(spark, sf):
    rows, out = embeddings(spark, sf), []
    for name, filters in (("label = 3", {"label": 3}), ("label >= 5", {"label >=": 5}), ("label >= 1", {"label >=": 1})):
        share = strictness(rows, predicate(filters))
        path, ef = route(share)
        out.append((name, round(share, 6) + 0.0, path, ef or 0))
    return spark.createDataFrame(out, "filter string, strictness double, path string, ef int")


