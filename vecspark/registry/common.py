"""Tables, derived vectors and SQL fragments that registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecspark.operators.aggregates import vec_avg

DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def scaled(spark, sf) -> DataFrame:
    """Embeddings of different lengths, so that metrics rank differently."""
    grow = F.col("label") + 1
    return embeddings(spark, sf).withColumn(
        "embedding", F.transform("embedding", lambda x: (x.cast("double") * grow).cast("float")))


def as_queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("vec_id", "query_id")


def label_centers(spark, sf) -> DataFrame:
    return vec_avg(embeddings(spark, sf), "embedding", "label", DIM, "center")


def center_array(spark, sf):
    """The label centres as a matrix, in label order (one row per label)."""
    import numpy as np
    rows = label_centers(spark, sf).orderBy("label").toArrow()
    return np.array(rows.column("center").to_pylist(), dtype=np.float64)


def with_center(spark, sf) -> DataFrame:
    """Every embedding next to the centre of its label."""
    return embeddings(spark, sf).join(label_centers(spark, sf), "label")


def r6(x) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def ranked(df: DataFrame, id: str = "vec_id") -> DataFrame:
    return df.select("query_id", id, r6(F.col("distance")).alias("distance"), "rank")


# SQL fragments for the comparison engine.

SCALED = """sv AS (SELECT vec_id, label,
  list_transform(embedding, lambda x: (x::DOUBLE * (label + 1))::FLOAT) AS embedding FROM embeddings)"""

CENTERS = """cent AS (SELECT label, list(m ORDER BY i) AS center FROM (
  SELECT label, i, avg(x::DOUBLE)::FLOAT AS m FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label)"""

MEAN = """mean AS (SELECT list(m ORDER BY i) AS q FROM (
  SELECT i, avg(x::DOUBLE)::FLOAT AS m FROM (
    SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY i))"""

PAIRED = f"""WITH {CENTERS}, p AS (SELECT e.vec_id, e.label, e.embedding AS a, c.center AS b
  FROM embeddings e JOIN cent c USING (label))"""


def sql_r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def sql_l2(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


def sql_ip(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def sql_cosine(a: str, b: str) -> str:
    return f"greatest(list_cosine_distance({a}::DOUBLE[], {b}::DOUBLE[]), 0.0::DOUBLE)"


def sql_l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))"


SQL_DISTANCE = {"l2": sql_l2, "ip": lambda a, b: "-" + sql_ip(a, b), "cosine": sql_cosine, "l1": sql_l1}


def sql_half(x: str) -> str:
    """Nearest half value of a number, ties to even."""
    unit = f"pow(2.0, greatest(floor(log2(abs({x}::DOUBLE)) + 1e-12), -14.0) - 10)"
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x}::DOUBLE / {unit}, 0) * {unit} END)::FLOAT"


def sql_bits(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"


def sql_knn_join(metric: str, k: int, with_: str = "", base: str = "embeddings", queries: str = "embeddings",
                 on: str = "true", where: str = "true", query_id: str = "q.vec_id", query_vec: str = "q.embedding",
                 distance: str | None = None) -> str:
    dist = distance or SQL_DISTANCE[metric]("b.embedding", query_vec)
    head = f"WITH {with_}" if with_ else ""
    return f"""{head} SELECT query_id, vec_id, {sql_r6('distance')} AS distance, rank::INT AS rank FROM (
      SELECT query_id, vec_id, distance,
        row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
      FROM (SELECT {query_id} AS query_id, b.vec_id, {dist} AS distance
            FROM {base} b JOIN {queries} q ON {on} WHERE {where})) WHERE rank <= {k}"""
