"""Search under metadata predicates: filter first, filter last, and the choice between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vecspark.operators.knn import knn_join, take_nearest
from vecspark.session import materialize

# Fixed thresholds and parameters of the router.
FILTER_FIRST = 0.80
WIDE_SEARCH = 0.30
WIDE_EF = 200
DEFAULT_EF = 40
TOP_K = 10
# Up to so many rows for all queries together, the ``ef`` nearest of each are fetched before the filter.
FETCHED_ROWS = 1 << 20

_OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v),
}


def filter_columns(filters: dict) -> list[str]:
    return list(dict.fromkeys(key.split()[0] for key in filters))


def predicate(filters: dict) -> Column:
    """``{'category': 'x', 'id >': 500}`` as one condition; no filters are always true.

    A key is a column name, optionally with an operator; values stay literals.
    """
    out = F.lit(True)
    for key, value in filters.items():
        name, *rest = key.split()
        op = " ".join(rest).lower() or "="
        if op not in _OPERATORS:
            raise ValueError(f"unknown filter operator {op!r}")
        out = out & _OPERATORS[op](F.col(name), value)
    return out


def strictness(df: DataFrame, where: Column, sample: float | None = None, seed: int = 7) -> float:
    """Share of rows a predicate removes, in [0, 1]; 0 for an empty table.

    One pass with two counts; ``sample`` reads a seeded fraction instead.
    """
    rows = df.sample(sample, seed) if sample else df
    total, kept = rows.agg(F.count(F.lit(1)), F.count(F.when(where, 1))).first()
    return min(1.0, max(0.0, 1 - kept / total)) if total else 0.0


def route(share_removed: float) -> tuple[str, int | None]:
    """The path and how many candidates a vector-first search collects."""
    if share_removed >= FILTER_FIRST:
        return "filter_first", None
    if share_removed >= WIDE_SEARCH:
        return "vector_first", WIDE_EF
    return "vector_first", DEFAULT_EF


def pre_filter_knn(df: DataFrame, queries: DataFrame, where: Column, k: int = TOP_K, metric="l2",
                   **columns) -> DataFrame:
    """Filter, then exact search."""
    return knn_join(df.filter(where), queries, k, metric, **columns)


def post_filter_knn(index, queries: DataFrame, where: Column, columns: list[str], k: int = TOP_K,
                    ef: int = DEFAULT_EF, probes: int = 1, *, query_id: str = "query_id",
                    query_vec: str = "embedding") -> DataFrame:
    """Search for ``ef`` rows, then filter, then keep k; may return fewer than k."""
    return _post_filter(index, queries, where, columns, k, ef, probes, None, query_id, query_vec)


def _post_filter(index, queries, where, columns, k, ef, probes, total, query_id, query_vec) -> DataFrame:
    """As ``post_filter_knn``, of an index of ``total`` rows (None: not counted)."""
    if total is not None and ef >= total:
        # no row is left out before the filter, so it can go first, and a task keeps k rows per query instead of all
        return index.search(queries, k, probes, query_id=query_id, query_vec=query_vec, where=where, payload=[c for c in columns if c != index.id])
    ef, extra = max(ef, k), [c for c in columns if c != index.id]
    most = FETCHED_ROWS // ef
    if queries.limit(most + 1).count() <= most:
        found = index.search(queries, ef, probes, query_id=query_id, query_vec=query_vec, payload=extra)
        return take_nearest(found.drop("rank").filter(where), k, [query_id], index.id)
    # the k nearest that pass, each kept if fewer than ``ef`` rows of any kind lie ahead of it: a task sends k rows and k counts
    # per query, where the ``ef`` nearest would be ``ef`` rows of each task
    passing = index.search(queries, k, probes, query_id=query_id, query_vec=query_vec, where=where, payload=extra)
    passing = materialize(take_nearest(passing.drop("rank"), k, [query_id], index.id), "passing")
    found = index.count_ahead(queries, passing, k, probes, query_id=query_id, query_vec=query_vec)
    return found.filter(F.col("ahead") < ef).drop("ahead")


def post_filter_widening(index, queries: DataFrame, where: Column, columns: list[str], k: int = TOP_K,
                         ef: int = DEFAULT_EF, probes: int = 1, *, query_id: str = "query_id",
                         query_vec: str = "embedding") -> DataFrame:
    """As ``post_filter_knn``, searching again with all limits doubled for queries that came out short."""
    lists = len(index.centers)
    total = index.entries().count()
    pending, done = queries, None
    while True:
        hits = materialize(_post_filter(index, pending, where, columns, k, ef, min(probes, lists), total, query_id, query_vec), "widened")
        full = hits.groupBy(query_id).count().filter(F.col("count") >= k).select(query_id)
        if ef >= total and probes >= lists:
            return hits if done is None else done.unionByName(hits)
        ready = hits.join(full, query_id, "left_semi")
        done = ready if done is None else done.unionByName(ready)
        pending = pending.join(full, query_id, "left_anti")
        if pending.isEmpty():
            return done
        ef, probes = ef * 2, probes * 2


@dataclass
class HybridResult:
    path: str
    strictness: float
    ef: int | None
    probes: int | None
    rows: DataFrame


def hybrid_search(index, queries: DataFrame, filters: dict, k: int = TOP_K, probes: int | None = None, *,
                  query_id: str = "query_id", query_vec: str = "embedding",
                  sample: float | None = None) -> HybridResult:
    """Measure how strict the filters are, take the fitting path, add ``similarity = 1 - distance``.

    ``index`` is an inverted-list index or a neighbour graph. A vector-first search goes on with wider limits for
    the queries that the filter left short, until they have k rows or the index has been searched whole.
    ``probes`` are the lists that it starts with (by default a quarter of them for a wide search, else a tenth);
    the result says how many that were.
    """
    where, columns = predicate(filters), filter_columns(filters)
    base = index.entries()
    share = strictness(base, where, sample)
    path, ef = route(share)
    if path == "filter_first":
        rows = pre_filter_knn(base, queries, where, k, index.metric, base_id=index.id, base_vec=index.vec,
                              query_id=query_id, query_vec=query_vec, nulls="skip")
        probes = None
    elif hasattr(index, "centers"):
        lists = len(index.centers)
        probes = min(probes or max(1, lists // 4 if ef == WIDE_EF else lists // 10), lists)
        rows = post_filter_widening(index, queries, where, columns, k, ef, probes, query_id=query_id, query_vec=query_vec)
    else:
        probes = None
        rows = index.search_post_filter(queries, k, where, ef, "relaxed_order", query_id=query_id, query_vec=query_vec)
    return HybridResult(path, share, ef, probes, rows.withColumn("similarity", 1 - F.col("distance")))


def log_decision(filters: dict, result: HybridResult) -> tuple[str, float, str]:
    """One log row of a routed search: filter pattern, strictness, path."""
    pattern = " AND ".join(f"{key} {value!r}" for key, value in sorted(filters.items()))
    return pattern, result.strictness, result.path


def advise(log: DataFrame, min_uses: int = 2, min_strictness: float = FILTER_FIRST) -> DataFrame:
    """Filter patterns used often and strictly enough to deserve an index of their own.

    ``log`` holds ``pattern, strictness, path`` as ``log_decision`` gives them.
    """
    return (log.groupBy("pattern").agg(F.count(F.lit(1)).alias("uses"), F.avg("strictness").alias("mean_strictness"))
            .filter((F.col("uses") >= min_uses) & (F.col("mean_strictness") >= min_strictness)))
