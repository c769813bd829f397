"""Inverted-list indexes: training, search, filters, maintenance, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.functions import bits
from vecspark.operators import evaluate
from vecspark.operators.hybrid import advise, hybrid_search, post_filter_knn, post_filter_widening, predicate
from vecspark.operators.knn import knn_join
from vecspark.plans import ivf
from vecspark.plans.ivf import IvfIndex, assign, probe_lists
from vecspark.registry import query
from vecspark.registry.common import (CENTERS, as_queries, center_array, embeddings, r6, ranked, scaled, sql_bits,
                                      sql_half, sql_knn_join, sql_l2, sql_r6, table, SCALED)
from vecspark.registry.search import K, _HAMMING, _QBITS, lineitem_features, supplier_queries, _LINES
from vecspark.session import scratch_path

LISTS = 12

# Lists around given centres (the mean of each label), which SQL can follow.
_ASSIGNED = f"""{CENTERS}, a AS (SELECT * FROM (SELECT e.vec_id, e.label, e.embedding, c.label AS list_id,
    {sql_l2('e.embedding', 'c.center')} AS cd, row_number() OVER (PARTITION BY e.vec_id ORDER BY
    {sql_l2('e.embedding', 'c.center')}, c.label) AS rn FROM embeddings e, cent c) WHERE rn = 1)"""


def _probed(probes: int) -> str:
    return f"""pr AS (SELECT * FROM (SELECT e.vec_id, e.label, e.embedding, c.label AS list_id, row_number() OVER (
    PARTITION BY e.vec_id ORDER BY {sql_l2('e.embedding', 'c.center')}, c.label) AS probe FROM embeddings e, cent c)
    WHERE probe <= {probes})"""


def given_index(spark, sf, **options) -> IvfIndex:
    return IvfIndex.build(embeddings(spark, sf), "l2", id="vec_id", centers=center_array(spark, sf), **options)


@query("ivf_assign", f"""WITH {_ASSIGNED} SELECT vec_id, list_id::INT AS list_id, {sql_r6('cd')} AS center_distance FROM a""")
def ivf_assign(spark, sf):
    placed = assign(embeddings(spark, sf), center_array(spark, sf))
    return placed.select("vec_id", "list_id", r6(F.col("center_distance")).alias("center_distance"))


@query("ivf_probe_lists", f"""WITH {CENTERS}, {_probed(3)} SELECT vec_id, list_id::INT AS list_id, (probe - 1)::INT AS probe FROM pr""")
def ivf_probe_lists(spark, sf):
    asked = probe_lists(embeddings(spark, sf), center_array(spark, sf), 3, vec="embedding")
    return asked.select("vec_id", F.posexplode("lists").alias("probe", "list_id"))


@query("ivf_search_given_centers", sql_knn_join("l2", K, f"{_ASSIGNED}, {_probed(3)}", "a", "pr", "b.list_id = q.list_id"))
def ivf_search_given_centers(spark, sf):
    return ranked(given_index(spark, sf).search(as_queries(embeddings(spark, sf)), K, 3))


@query("ivf_search_filtered", sql_knn_join("l2", K, f"{_ASSIGNED}, {_probed(4)}", "a", "pr",
                                           "b.list_id = q.list_id AND b.label = q.label"))
def ivf_search_filtered(spark, sf):
    """Label equality inside the probed lists, over a layout by label and list."""
    index = given_index(spark, sf, partition_by=["label"])
    return ranked(index.search(as_queries(embeddings(spark, sf)), K, 4, on="label"))


@query("ivf_post_filter", f"""WITH {_ASSIGNED}, {_probed(4)}, n AS (SELECT q.vec_id AS query_id, b.vec_id, b.label,
    {sql_l2('b.embedding', 'q.embedding')} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY
    {sql_l2('b.embedding', 'q.embedding')}, b.vec_id) AS coarse FROM a b JOIN pr q ON b.list_id = q.list_id)
  SELECT query_id, vec_id, {sql_r6('distance')} AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM n WHERE coarse <= 40 AND label < 3) WHERE rank <= {K}""")
def ivf_post_filter(spark, sf):
    return ranked(post_filter_knn(given_index(spark, sf), as_queries(embeddings(spark, sf)),
                                  predicate({"label <": 3}), ["label"], K, 40, 4))


@query("ivf_widening", sql_knn_join("l2", K, where="b.label < 3"))
def ivf_widening(spark, sf):
    """All limits at their widest: exact in one round."""
    index = given_index(spark, sf)
    return ranked(post_filter_widening(index, as_queries(embeddings(spark, sf)), predicate({"label <": 3}), ["label"], K,
                                       ef=1 << 20, probes=len(index.centers)))


@query("ivf_full_probe", sql_knn_join("l2", K))
def ivf_full_probe(spark, sf):
    """Trained centres; probing every list equals the exact result."""
    index = IvfIndex.build(embeddings(spark, sf), "l2", LISTS, id="vec_id")
    return ranked(index.search(as_queries(embeddings(spark, sf)), K, LISTS))


@query("ivf_full_probe_cosine", sql_knn_join("cosine", K, SCALED, "sv", "sv"))
def ivf_full_probe_cosine(spark, sf):
    rows = scaled(spark, sf)
    index = IvfIndex.build(rows, "cosine", LISTS, id="vec_id")
    return ranked(index.search(as_queries(rows), K, LISTS))


@query("ivf_full_probe_ip", sql_knn_join("ip", K, SCALED, "sv", "sv"))
def ivf_full_probe_ip(spark, sf):
    rows = scaled(spark, sf)
    index = IvfIndex.build(rows, "ip", LISTS, id="vec_id")
    return ranked(index.search(as_queries(rows), K, LISTS))


@query("ivf_full_probe_bits", sql_knn_join("l2", K, _QBITS, "qb", "qb", distance=_HAMMING))
def ivf_full_probe_bits(spark, sf):
    rows = embeddings(spark, sf).select("vec_id", bits.binary_quantize("embedding").alias("bits"))
    index = IvfIndex.build(rows, "hamming", LISTS, "bits", "vec_id")
    return ranked(index.search(as_queries(rows), K, LISTS, query_vec="bits"))


@query("ivf_lineitem_full_probe", sql_knn_join("l2", K, _LINES, "li", "sup", query_id="q.query_id", query_vec="q.qv"))
def ivf_lineitem_full_probe(spark, sf):
    index = IvfIndex.build(lineitem_features(spark, sf), "l2", LISTS, id="vec_id")
    return ranked(index.search(supplier_queries(spark, sf), K, LISTS, query_vec="qv"))


@query("ivf_recall_by_probes", f"""SELECT probes::INT AS probes, true AS reached, true AS within FROM (VALUES (1), (4), ({LISTS})) t(probes)""")
def ivf_recall_by_probes(spark, sf):
    """Recall floors against the exact result for growing numbers of probes, and rows measured up to all of them."""
    rows = embeddings(spark, sf)
    index = IvfIndex.build(rows, "l2", LISTS, id="vec_id")
    truth = knn_join(rows, as_queries(rows), K, base_id="vec_id")
    report = evaluate.sweep(spark, "ivf", lambda p: index.search(as_queries(rows), K, p), [1, 4, LISTS], truth,
                            "query_id", "vec_id", lambda p: index.comparisons(as_queries(rows), p))
    floor = F.when(F.col("param") == 1, 0.25).when(F.col("param") == 4, 0.55).otherwise(1.0)
    return report.select(F.col("param").alias("probes"), (F.col("recall") >= floor).alias("reached"),
                         F.when(F.col("param") == LISTS, F.col("distance_comps") == rows.count()).otherwise(
                             (F.col("distance_comps") > 0) & (F.col("distance_comps") < rows.count())).alias("within"))


@query("ivf_two_streams", sql_knn_join("l2", K))
def ivf_two_streams(spark, sf):
    """Two streams with the same name and a checkpoint each, one of them started again: every row is there once."""
    from vecspark.streaming import insert_stream
    rows = embeddings(spark, sf)
    index = given_index_for(spark, sf, rows.filter(F.col("label") < 3))
    first, second = F.col("label").between(3, 5), F.col("label") > 5
    places = [(scratch_path(spark, "arrivals"), scratch_path(spark, "stream-checkpoint")) for _ in range(2)]
    for (arrivals, _), share in zip(places, (first, second)):
        rows.filter(share).write.parquet(arrivals)
    for arrivals, checkpoint in (*places, places[0]):
        stream = spark.readStream.schema(rows.schema).parquet(arrivals)
        insert_stream(index, stream, checkpoint, available_now=True).awaitTermination()
    return ranked(index.search(as_queries(rows), K, len(index.centers)))


@query("ivf_bit_majority", "SELECT count(*) AS rows, true AS settled FROM embeddings")
def ivf_bit_majority(spark, sf):
    """Trained bit centres are the majority of their lists' bits, and no row has a nearer centre than its list's."""
    rows = embeddings(spark, sf).select("vec_id", bits.binary_quantize("embedding").alias("bits"))
    index = IvfIndex.build(rows, "hamming", LISTS, "bits", "vec_id")
    stored = index.entries().select("list_id", F.posexplode(F.split(bits.bits_to_text("bits"), "")).alias("pos", "bit")).where("bit <> ''")
    majority = stored.groupBy("list_id", "pos").agg((F.avg(F.col("bit").cast("int")) > 0.5).cast("double").alias("own"))
    centers = ivf.center_table(spark, index.centers).select("list_id", F.posexplode("center").alias("pos", "given"))
    off = majority.join(centers, ["list_id", "pos"]).filter("own <> given").count()
    return index.entries().agg(F.count(F.lit(1)).alias("rows")).withColumn("settled", F.lit(off == 0))


@query("ivf_more_lists_than_rows", """WITH v AS (SELECT r_regionkey AS vec_id, [r_regionkey::FLOAT, length(r_name)::FLOAT] AS embedding FROM region),
  n AS (SELECT q.vec_id AS query_id, b.vec_id, list_distance(b.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM v b, v q),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM n)
  SELECT query_id, vec_id, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM o WHERE rank <= 3""")
def ivf_more_lists_than_rows(spark, sf):
    """Fewer rows than lists: the remaining centres are random, and a full probe still finds everything."""
    import warnings
    rows = table(spark, sf, "region").select(F.col("r_regionkey").alias("vec_id"), F.array(
        F.col("r_regionkey").cast("float"), F.length("r_name").cast("float")).alias("embedding"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        index = IvfIndex.build(rows, "l2", 10, id="vec_id")
    return ranked(index.search(as_queries(rows), 3, 10))


@query("ivf_iterative", sql_knn_join("l2", K, where="b.label = 3"))
def ivf_iterative(spark, sf):
    """All lists in the first round: exact."""
    index = given_index(spark, sf)
    found = index.search_iterative(as_queries(embeddings(spark, sf)), K, len(index.centers), where=F.col("label") == 3)
    return ranked(found)


@query("ivf_iterative_steps", f"""SELECT vec_id AS query_id, least({K}, (SELECT count(*) FROM embeddings WHERE label = 3)) AS rows
  FROM embeddings""")
def ivf_iterative_steps(spark, sf):
    """One list at a time, every query ends with k rows."""
    index = given_index(spark, sf)
    found = index.search_iterative(as_queries(embeddings(spark, sf)), K, 1, where=F.col("label") == 3)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"))


@query("ivf_range_search", f"""SELECT query_id, vec_id, {sql_r6('distance')} AS distance FROM (
  SELECT q.vec_id AS query_id, b.vec_id, {sql_l2('b.embedding', 'q.embedding')} AS distance FROM embeddings b, embeddings q)
  WHERE distance < 1.05""")
def ivf_range_search(spark, sf):
    found = given_index(spark, sf).range_search(as_queries(embeddings(spark, sf)), 1.05)
    return found.select("query_id", "vec_id", r6(F.col("distance")).alias("distance"))


@query("ivf_partial_index", sql_knn_join("l2", K, where="b.label = 3"))
def ivf_partial_index(spark, sf):
    """An index over the rows of one predicate."""
    index = IvfIndex.build(embeddings(spark, sf).filter(F.col("label") == 3), "l2", 4, id="vec_id")
    return ranked(index.search(as_queries(embeddings(spark, sf)), K, 4))


@query("ivf_insert", sql_knn_join("l2", K))
def ivf_insert(spark, sf):
    rows = embeddings(spark, sf)
    index = IvfIndex.build(rows.filter(F.col("label") < 7), "l2", LISTS, id="vec_id")
    index.insert(rows.filter(F.col("label") >= 7))
    return ranked(index.search(as_queries(rows), K, LISTS))


@query("ivf_stream_insert", sql_knn_join("l2", K))
def ivf_stream_insert(spark, sf):
    """Rows arrive as a stream of files and are searchable once stored."""
    from vecspark.streaming import insert_stream
    rows = embeddings(spark, sf)
    index = given_index_for(spark, sf, rows.filter(F.col("label") < 5))
    arrivals = scratch_path(spark, "arrivals")
    rows.filter(F.col("label") >= 5).write.parquet(arrivals)
    stream = spark.readStream.schema(rows.schema).parquet(arrivals)
    insert_stream(index, stream, scratch_path(spark, "stream-checkpoint"), available_now=True).awaitTermination()
    return ranked(index.search(as_queries(rows), K, len(index.centers)))


def given_index_for(spark, sf, rows) -> IvfIndex:
    return IvfIndex.build(rows, "l2", id="vec_id", centers=center_array(spark, sf))


@query("ivf_delete", sql_knn_join("l2", K, where="b.label <> 3"))
def ivf_delete(spark, sf):
    rows = embeddings(spark, sf)
    index = given_index(spark, sf)
    index.delete(rows.filter(F.col("label") == 3).select("vec_id"))
    index.vacuum()
    return ranked(index.search(as_queries(rows), K, len(index.centers)))


@query("ivf_list_sizes", f"""WITH {_ASSIGNED} SELECT list_id::INT AS list_id, count(*) AS rows, {sql_r6('avg(cd)')} AS mean_distance
  FROM a GROUP BY list_id""")
def ivf_list_sizes(spark, sf):
    return given_index(spark, sf).list_sizes().select("list_id", "rows", r6(F.col("mean_distance")).alias("mean_distance"))


@query("ivf_quality", f"""WITH {_ASSIGNED}, s AS (SELECT list_id, avg(cd) AS s, sum(cd) AS t FROM a GROUP BY list_id),
  full_ AS (SELECT label AS list_id, center, s FROM cent JOIN s ON label = list_id),
  w AS (SELECT x.list_id, max((x.s + y.s) / {sql_l2('x.center', 'y.center')}) AS worst FROM full_ x JOIN full_ y
        ON x.list_id <> y.list_id GROUP BY x.list_id)
  SELECT {sql_r6('(SELECT sum(t) FROM s)')} AS inertia, {sql_r6('(SELECT avg(worst) FROM w)')} AS davies_bouldin""")
def ivf_quality(spark, sf):
    index = given_index(spark, sf)
    return index.davies_bouldin().select(r6(F.lit(index.inertia())).alias("inertia"),
                                         r6(F.col("davies_bouldin")).alias("davies_bouldin"))


@query("kmeans_step", f"""WITH {_ASSIGNED}, u AS (SELECT list_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM a)
  SELECT list_id::INT AS list_id, i::INT AS pos, count(*) AS rows, {sql_r6('avg(x::DOUBLE)')} AS mean FROM u GROUP BY list_id, i""")
def kmeans_step(spark, sf):
    """One k-means step from given centres: rows and mean per list."""
    rows = embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    metric = ivf.metric_of("l2")
    partial = ivf.merge_partials(ivf._partial_sums(rows, metric, center_array(spark, sf)))
    cells = partial.select("list_id", "n", F.posexplode("total").alias("pos", "x"))
    return cells.select("list_id", (F.col("pos") + 1).alias("pos"), F.col("n").alias("rows"),
                        r6(F.col("x") / F.col("n")).alias("mean"))


@query("kmeans_bit_centers", f"""WITH q AS (SELECT label, {sql_bits('embedding')} AS b FROM embeddings),
  u AS (SELECT label, unnest(range(1, 65)) AS i, b FROM q)
  SELECT label, i::INT AS pos, (avg(CASE WHEN b[i] = '1' THEN 1.0 ELSE 0.0 END) > 0.5) AS bit FROM u GROUP BY label, i""")
def kmeans_bit_centers(spark, sf):
    """Bit centres take the majority of each bit."""
    rows = embeddings(spark, sf).select("label", bits.bits_to_text(bits.binary_quantize("embedding")).alias("b"))
    from vecspark.operators.aggregates import vec_avg
    as_numbers = rows.select("label", F.transform(F.filter(F.split("b", ""), lambda c: c != ""),
                                                  lambda c: c.cast("float")).alias("v"))
    mean = vec_avg(as_numbers, "v", "label", 64, "v")
    return mean.select("label", F.posexplode("v").alias("pos", "x")).select(
        "label", (F.col("pos") + 1).alias("pos"), (F.col("x") > 0.5).alias("bit"))


@query("hybrid_filter_first", sql_knn_join("l2", K, where="b.label = 3").replace(
    f"{sql_r6('distance')} AS distance", f"{sql_r6('1 - distance')} AS similarity"))
def hybrid_filter_first(spark, sf):
    """A strict filter goes first, so the result is exact."""
    result = hybrid_search(given_index(spark, sf), as_queries(embeddings(spark, sf)), {"label": 3}, K)
    return result.rows.select("query_id", "vec_id", r6(F.col("similarity")).alias("similarity"), "rank")


def _widened(where: str, ef: int, probes: int) -> str:
    """Probe and filter with limits doubled for queries that came out short, to the end, around the given centres."""
    return f"""WITH {_ASSIGNED}, pr AS (SELECT e.vec_id, e.embedding, c.label AS list_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY
      {sql_l2('e.embedding', 'c.center')}, c.label) AS probe FROM embeddings e, cent c),
    rounds AS (SELECT i, {ef} * 2 ** i AS ef, {probes} * 2 ** i AS probes FROM range(12) t(i)),
    d AS (SELECT q.vec_id AS query_id, b.vec_id, b.label, probe, {sql_l2('b.embedding', 'q.embedding')} AS distance
      FROM a b JOIN pr q ON b.list_id = q.list_id),
    f AS (SELECT * FROM (SELECT i, query_id, vec_id, label, distance, row_number() OVER (PARTITION BY i, query_id ORDER BY distance, vec_id) AS near, ef
      FROM d JOIN rounds ON probe <= probes) WHERE near <= ef AND {where}),
    n AS (SELECT *, row_number() OVER (PARTITION BY i, query_id ORDER BY distance, vec_id) AS rank, count(*) OVER (PARTITION BY i, query_id) AS found FROM f),
    first AS (SELECT query_id, min(i) AS i FROM n WHERE found >= {K} GROUP BY query_id)
  SELECT query_id, vec_id, {sql_r6('distance')} AS distance, rank::INT AS rank FROM n JOIN first USING (query_id, i) WHERE rank <= {K}"""


@query("hybrid_vector_first", _widened("label >= 5", 200, 2))
def hybrid_vector_first(spark, sf):
    """Half the rows pass, so vectors go first; queries that the filter leaves short go on with wider limits."""
    result = hybrid_search(given_index(spark, sf), as_queries(embeddings(spark, sf)).drop("label"), {"label >=": 5}, K)
    if (result.path, result.ef, result.probes) != ("vector_first", 200, 2):
        raise ValueError(f"unexpected path {result}")
    return ranked(result.rows.drop("similarity"))


@query("ivf_widening_rounds", _widened("label < 2", 12, 1))
def ivf_widening_rounds(spark, sf):
    """From one list and a dozen rows: most queries come out short at first and take several rounds."""
    return ranked(post_filter_widening(given_index(spark, sf), as_queries(embeddings(spark, sf)).drop("label"), predicate({"label <": 2}), ["label"],
                                       K, ef=12, probes=1))


@query("ivf_iterative_order", f"""WITH {_ASSIGNED}, pr AS (SELECT e.vec_id, e.embedding, c.label AS list_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY
      {sql_l2('e.embedding', 'c.center')}, c.label) - 1 AS batch FROM embeddings e, cent c),
    d AS (SELECT q.vec_id AS query_id, b.vec_id, batch, {sql_l2('b.embedding', 'q.embedding')} AS distance
      FROM a b JOIN pr q ON b.list_id = q.list_id WHERE b.label = 3)
  SELECT query_id, vec_id, {sql_r6('distance')} AS distance, rank::INT AS rank, batch::INT AS batch FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY batch, distance, vec_id) AS rank FROM d) WHERE rank <= {K}""")
def ivf_iterative_order(spark, sf):
    """One list after the other until k rows pass: rows come in the order of the rounds that found them."""
    found = given_index(spark, sf).search_iterative(as_queries(embeddings(spark, sf)), K, 1, where=F.col("label") == 3)
    return found.select("query_id", "vec_id", r6(F.col("distance")).alias("distance"), "rank", "batch")


@query("filter_advisor", f"""WITH s AS (SELECT label, 1 - count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS share FROM embeddings
  GROUP BY label) SELECT 'label ' || label AS pattern, c.n AS uses, {sql_r6('share')} AS mean_strictness FROM s JOIN (
  SELECT c_nationkey % 10 AS k, count(*) AS n FROM customer GROUP BY 1) c ON k = label WHERE c.n >= 2 AND share >= 0.9""")
def filter_advisor(spark, sf):
    """A log of label filters, one entry per customer, and the patterns worth an index of their own."""
    rows = embeddings(spark, sf)
    total = rows.count()
    share = rows.groupBy("label").agg((1 - F.count(F.lit(1)) / total).alias("strictness"))
    log = table(spark, sf, "customer").select((F.col("c_nationkey") % 10).alias("label")).join(share, "label").select(
        F.concat(F.lit("label "), F.col("label")).alias("pattern"), "strictness", F.lit("filter_first").alias("path"))
    return advise(log, 2, 0.9).select("pattern", "uses", r6(F.col("mean_strictness")).alias("mean_strictness"))


@query("index_build_metrics", "SELECT 10 AS lists, count(*) AS rows FROM embeddings")
def index_build_metrics(spark, sf):
    report = evaluate.build_metrics(spark, lambda: given_index(spark, sf))
    return report.filter((F.col("bytes") > 0) & (F.col("secs") > 0)).select(F.col("lists").cast("int").alias("lists"), "rows")


@query("ivf_half_full_probe", sql_knn_join("l2", K, f"""h AS (SELECT vec_id,
  list_transform(embedding, lambda x: {sql_half('x')}) AS embedding FROM embeddings)""", "h", "h"))
def ivf_half_full_probe(spark, sf):
    """Centres and rows in half precision."""
    from vecspark.functions.half import to_half
    rows = embeddings(spark, sf).withColumn("embedding", to_half("embedding"))
    index = IvfIndex.build(rows, "l2", LISTS, id="vec_id", half=True)
    return ranked(index.search(as_queries(rows), K, LISTS))




@query("ivf_update", sql_knn_join("l2", K, """u AS (SELECT vec_id, label,
   CASE WHEN label = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings)""", "u"))
def ivf_update(spark, sf):
    """Rows deleted, inserted again with other vectors, and still there after a vacuum."""
    rows = embeddings(spark, sf)
    index = given_index(spark, sf)
    third = rows.filter(F.col("label") == 3)
    index.delete(third.select("vec_id"))
    index.insert(third.withColumn("embedding", F.transform("embedding", lambda x: -x)))
    index.vacuum()
    return ranked(index.search(as_queries(rows), K, len(index.centers)))


@query("ivf_null_and_zero", sql_knn_join("cosine", K, f"{SCALED}, v AS (SELECT * FROM sv WHERE label NOT IN (1, 2))", "v", "v"))
def ivf_null_and_zero(spark, sf):
    """Rows without a vector, or without a direction, are in no list of an angular index."""
    rows = scaled(spark, sf)
    holed = rows.withColumn("embedding", F.when(F.col("label") == 1, None).when(
        F.col("label") == 2, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    index = IvfIndex.build(holed, "cosine", LISTS, id="vec_id")
    return ranked(index.search(as_queries(rows.filter(~F.col("label").isin(1, 2))), K, LISTS))
