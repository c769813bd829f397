"""Coarse search on a cheaper form of the vectors, then exact ranking of the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vecspark.functions.bits import binary_quantize
from vecspark.functions.half import to_half
from vecspark.operators.knn import _spread, distance, knn_join, take_nearest
from vecspark.session import materialize


def rerank(candidates: DataFrame, queries: DataFrame, k: int, metric="l2", *, base_id="id", base_vec="embedding",
           query_id="query_id", query_vec="embedding", base: DataFrame | None = None) -> DataFrame:
    """Measure candidates exactly and keep the k nearest per query.

    Candidates carry their vector, or ``base`` has it: then only the rows of ``base`` that are some query's
    candidate are fetched.
    """
    asked = queries.select(query_id, F.col(query_vec).alias("__asked"))
    if base is not None:
        wanted = candidates.select(base_id).distinct()
        candidates = candidates.join(base.select(base_id, base_vec).join(wanted, base_id, "left_semi"), base_id)
    measured = candidates.drop("distance", "rank").join(asked, query_id)
    measured = measured.withColumn("distance", distance(metric, F.col(base_vec), F.col("__asked")))
    return take_nearest(measured.drop(base_vec, "__asked"), k, [query_id], base_id)


def quantized_knn(base: DataFrame, queries: DataFrame, k: int, candidates: int, metric="l2", *, base_id="id",
                  base_vec="embedding", query_id="query_id", query_vec="embedding") -> DataFrame:
    """The ``candidates`` nearest by sign bits (Hamming), of which the k nearest by ``metric``.

    The first phase shuffles ids and Hamming distances only; vectors are fetched for its survivors.
    """
    # many candidates take many rounds, which all read the bits
    bits = materialize(_spread(base.select(base_id, binary_quantize(base_vec).alias("__bits")), base_id), "bits")
    coarse = knn_join(bits, queries.withColumn("__bits", binary_quantize(query_vec)), candidates, "hamming",
                      base_id=base_id, base_vec="__bits", query_id=query_id, query_vec="__bits", nulls="skip")
    coarse = materialize(coarse.select(query_id, base_id), "coarse")
    return rerank(coarse, queries, k, metric, base_id=base_id, base_vec=base_vec, query_id=query_id,
                  query_vec=query_vec, base=base)


def half_knn(base: DataFrame, queries: DataFrame, k: int, metric="l2", *, base_id="id", base_vec="embedding",
             query_id="query_id", query_vec="embedding", **options) -> DataFrame:
    """Search on half-precision forms of both sides."""
    return knn_join(base.withColumn(base_vec, to_half(base_vec)), queries.withColumn(query_vec, to_half(query_vec)),
                    k, metric, base_id=base_id, base_vec=base_vec, query_id=query_id, query_vec=query_vec, **options)
