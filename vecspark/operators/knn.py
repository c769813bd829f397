"""Exact nearest-neighbour search over DataFrames.

``knn`` answers one query with a sort and limit. ``knn_join`` answers a DataFrame
of queries; rows and queries may have to agree on key columns (a label, a
partition, an inverted list). Each task keeps only its k best rows per query, so
what is shuffled is k rows per query and task, never pairs.

Queries of a checked, small size travel with the tasks and the base is scanned
once, where it lies. Larger query sets travel block by block: blocks are bounded
in rows and bytes, each has a round of its own over the base, and no base row is
copied or shuffled. Queries that want the same key share a block, and a round
reads only the rows that its block's keys want.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vecspark.functions import bits, dense, sparse
from vecspark.operators import kernels
from vecspark.operators.kernels import Metric, metric_of
from vecspark.session import materialize
from vecspark.types import as_col

# Queries travel with the tasks up to these sizes, and up to so many that a task's nearest rows of them stay within these.
BROADCAST_ROWS = 131_072
BROADCAST_BYTES = 64 << 20
KEPT_ROWS = 1 << 20
# Pairs a task holds at once where all pairs in range are wanted, of how many queries, so that they meet a whole batch, and how
# many rows are found before they leave the task.
RANGE_PAIRS, RANGE_QUERIES, RANGE_ROWS = 1 << 20, 100, 10_000
# Up to this many queries per row, pairs are measured one by one.
DIRECT_PAIRS = 4
# Inputs of a size between these may come in fewer pieces than there are cores, and moving them is cheap.
SPREAD_BYTES = (2 << 20, 512 << 20)
# Distinct key values up to these numbers become a literal filter on the base scan: whole numbers, and others.
LITERAL_NUMBERS, LITERAL_KEYS = 1 << 16, 2000

# A column of queries with a distance beyond which no row matters, NULL where there is none.
LIMIT = "__limit"

DISTANCES = {
    "l2": dense.l2_distance, "ip": dense.negative_inner_product, "cosine": dense.cosine_distance,
    "l1": dense.l1_distance, "hamming": bits.hamming_distance, "jaccard": bits.jaccard_distance,
    "sparse_l2": sparse.l2_distance, "sparse_ip": sparse.negative_inner_product,
    "sparse_cosine": sparse.cosine_distance, "sparse_l1": sparse.l1_distance,
}


def distance(metric, a, b) -> Column:
    """The distance of a metric as a column (the inner product is negated)."""
    return DISTANCES[metric_of(metric).name](a, b)


def _measured(df: DataFrame, query, metric, vec: str) -> DataFrame:
    """Add ``distance`` to one query: a constant, or the single value of a one-row DataFrame."""
    if not isinstance(query, DataFrame):
        return df.withColumn("distance", distance(metric, vec, query))
    # a subquery may not stand inside a higher-order function, so it becomes a column first
    asked = df.withColumn("__query", query.scalar())
    return asked.withColumn("distance", distance(metric, vec, F.col("__query"))).drop("__query")


def knn(df: DataFrame, query: Column | DataFrame, k: int, metric="l2", vec="embedding", id="id") -> DataFrame:
    """``ORDER BY distance LIMIT k`` for one query; NULL vectors last, ties by id."""
    return (_measured(df, query, metric, vec)
            .orderBy(F.col("distance").asc_nulls_last(), F.col(id)).limit(k))


def range_search(df: DataFrame, query: Column | DataFrame, below: float | None = None, above: float | None = None,
                 metric="l2", vec="embedding") -> DataFrame:
    """All rows closer than ``below`` and farther than ``above``, in no order."""
    out = _measured(df, query, metric, vec)
    if below is not None:
        out = out.filter(F.col("distance") < below)
    if above is not None:
        out = out.filter(F.col("distance") > above)
    return out


def with_ties(df: DataFrame, k: int, by: list[str], order: str = "distance") -> DataFrame:
    """The first k per group and everything that ties with the k-th."""
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())
    return df.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= k)


def take_nearest(df: DataFrame, k: int, by: list[str], id: str, order: str = "distance") -> DataFrame:
    """The k nearest rows per group with their rank, ties by id."""
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last(), F.col(id))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bounded_arrow(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> pa.Table | None:
    """The rows as an Arrow table when they are few and small, else None."""
    table = df.limit(rows + 1).toArrow()
    return table if table.num_rows <= rows and table.nbytes <= size else None


def _key_pairs(on) -> list[tuple[str, str]]:
    if on is None:
        return []
    if isinstance(on, str):
        on = [on]
    return [(c, c) if isinstance(c, str) else tuple(c) for c in on]


def _is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _joined(parts: list[Column]) -> Column:
    """Several key parts as one text, NULL when any part is NULL."""
    whole = F.to_json(F.array(*[p.cast("string") for p in parts]))
    anything_null = parts[0].isNull()
    for p in parts[1:]:
        anything_null = anything_null | p.isNull()
    return F.when(~anything_null, whole)


def _keys(base: DataFrame, queries: DataFrame, pairs) -> tuple[Column, Column]:
    """The key of a base row, and the keys a query accepts as an array.

    A query column may be an array (the lists to probe): any element matches.
    """
    if not pairs:
        return F.lit(0).cast("bigint"), F.array(F.lit(0).cast("bigint"))
    left = [F.col(b) for b, _ in pairs]
    types = [queries.schema[q].dataType for _, q in pairs]
    many = [i for i, t in enumerate(types) if isinstance(t, T.ArrayType)]
    if len(many) > 1:
        raise ValueError("only one query key may be an array")

    def element(i):
        return types[i].elementType if i in many else types[i]

    plain = len(pairs) == 1 and _is_integer(base.schema[pairs[0][0]].dataType) and _is_integer(element(0))

    def combine(parts):
        return parts[0].cast("bigint") if plain else _joined(parts)

    def right(value=None):
        return combine([value if i in many else F.col(q) for i, (_, q) in enumerate(pairs)])

    accepted = F.transform(F.col(pairs[many[0]][1]), right) if many else F.array(right())
    return combine(left), F.filter(accepted, lambda x: x.isNotNull())


class _Sides:
    """Both sides of a join with their keys: a base row has one, a query accepts several."""

    def __init__(self, base, queries, base_id, base_vec, query_id, query_vec, on, payload, nulls, along=()):
        if query_id in (base_id, *payload):
            raise ValueError(f"the query id column needs a name of its own, not {query_id!r}")
        self.base, self.pairs, self.nulls = base, _key_pairs(on), nulls
        self.key, accepted = _keys(base, queries, self.pairs)
        self.columns = [as_col(base_vec).alias("__vec"), F.col(base_id), *[F.col(c) for c in payload]]
        values = [F.col(q).alias(f"__on{i}") for i, (_, q) in enumerate(self.pairs)]
        self.along = list(along)
        self.right = queries.select(accepted.alias("__keys"), as_col(query_vec).alias("__vec"), F.col(query_id), *values,
                                    *[F.col(c) for c in self.along])

    def left(self, table: pa.Table) -> DataFrame:
        """The base rows that the queries of ``table`` may want: each key column is filtered by its own values, so partition columns prune."""
        rows = self.base
        for i, (name, _) in enumerate(self.pairs):
            wanted = table.column(f"__on{i}").combine_chunks()
            if pa.types.is_list(wanted.type):
                wanted = wanted.flatten()
            rows = _among(rows, name, pa.compute.unique(wanted.drop_null()).to_pylist())
        rows = rows.select(self.key.alias("__key"), *self.columns)
        if self.pairs:
            rows = rows.filter(F.col("__key").isNotNull())
        return rows.filter(F.col("__vec").isNotNull()) if self.nulls == "skip" else rows

    def carried(self, table: pa.Table) -> pa.Table:
        """What of the queries travels with the tasks."""
        return table.select([*table.column_names[:3], *self.along])


def _among(rows: DataFrame, name: str, values: list) -> DataFrame:
    """The rows whose column is one of ``values``, by a literal filter where they are not too many."""
    dtype = rows.schema[name].dataType
    if _is_integer(dtype) and len(values) <= LITERAL_NUMBERS and all(isinstance(v, int) for v in values):
        return rows.filter(F.expr(f"`{name}` IN ({', '.join(map(str, values))})") if values else F.lit(False))
    if len(values) <= LITERAL_KEYS:
        return rows.filter(F.col(name).isin(values))
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("__among", dtype)]))
    return rows.join(F.broadcast(listed), F.col(name) == F.col("__among"), "left_semi")


def _candidate_schema(base, queries, base_id, query_id, payload) -> T.StructType:
    return T.StructType([queries.schema[query_id], base.schema[base_id], *[base.schema[c] for c in payload],
                         T.StructField("distance", T.DoubleType())])


class _QuerySide:
    """The queries of a task: vectors as one block, and which queries accept a key."""

    def __init__(self, metric: Metric, table: pa.Table):
        self.table = table = _near_together(metric, table.combine_chunks())
        self.ids = table.column(2)
        self.missing = table.column("__vec").is_null().to_numpy()
        self.place = np.cumsum(~self.missing) - 1
        self.block = kernels.block_from_arrow(metric, table.column("__vec").filter(pa.array(~self.missing)))
        keys = table.column("__keys").combine_chunks()
        owner = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
        flat = keys.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))
        self.spans = dict(zip(self.keys.tolist(), zip(self.first.tolist(), (self.first + self.count).tolist())))
        seen = {}
        # keys that the same queries accept have the same number
        self.alike = {key: seen.setdefault(self.owner[a:b].tobytes(), len(seen)) for key, (a, b) in self.spans.items()}

    def __len__(self):
        return len(self.missing)

    def of(self, key):
        """Queries that accept a key: those with a vector, and those without."""
        first, last = self.spans.get(key, (0, 0))
        who = self.owner[first:last]
        return who[~self.missing[who]], who[self.missing[who]]

    def accepting(self, keys):
        """How many queries accept each of ``keys``, and where they start in ``owner``."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.count[at], 0), self.first[at]

    def parts(self, batch):
        """Row positions of a batch with the queries that accept them, as ``of`` has them; rows of keys that the same queries accept come together."""
        together = {}
        for key, members in _batch_parts(batch):
            key = _plain(key)
            if key in self.spans:
                together.setdefault(self.alike[key], (key, []))[1].append(members)
        for key, members in together.values():
            yield np.sort(np.concatenate(members)), *self.of(key)

    def take(self, positions):
        if len(positions) == len(self.block) and (np.diff(positions) > 0).all():
            return self.block
        return self.block.take(self.place[positions])


def _near_together(metric: Metric, table: pa.Table) -> pa.Table:
    """Queries in few dimensions in an order in which those that follow each other lie near each other."""
    missing = table.column("__vec").is_null().to_numpy()
    block = kernels.block_from_arrow(metric, table.column("__vec").filter(pa.array(~missing)))
    if len(block) <= kernels.BOX_QUERIES or not block.boxed(metric):
        return table
    solid = np.flatnonzero(~missing)[kernels.in_boxes(block.data, kernels.BOX_QUERIES // 8)]
    return table.take(pa.array(np.concatenate([solid, np.flatnonzero(missing)]))).combine_chunks()


def _batch_parts(batch):
    """Row positions of each key in a batch."""
    keys = batch.column("__key").to_numpy(zero_copy_only=False)
    if len(keys) and (keys == keys[0]).all():
        return [(keys[0], np.arange(len(keys)))]
    values, inverse = np.unique(keys, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    ends = np.cumsum(np.bincount(inverse, minlength=len(values)))
    return [(v, order[e - c:e]) for v, e, c in zip(values, ends, np.diff(np.r_[0, ends]))]


def _plain(key):
    return key.item() if isinstance(key, np.generic) else key


class _Nearest:
    """The running k nearest rows per query over the batches of a task."""

    def __init__(self, metric: Metric, side: _QuerySide, k: int):
        self.metric, self.side, self.k = metric, side, k
        self.limit = np.full(len(side), np.inf)
        if LIMIT in side.table.column_names:
            far = side.table.column(LIMIT).to_numpy()
            with np.errstate(over="ignore"):
                rank = far * np.abs(far) if metric.name.endswith("l2") else far
                self.limit = np.where(np.isnan(far), np.inf, rank + np.abs(rank) * 1e-12 + np.finfo(float).tiny)
        self.parts, self.waiting = [], 0

    def add(self, batch: pa.RecordBatch):
        if batch.num_rows == 0:
            return
        carried = pa.Table.from_batches([batch]).drop_columns(["__key", "__vec"])
        codes = kernels.id_codes(carried.column(0))
        vectors = batch.column("__vec")
        missing = vectors.is_null().to_numpy(zero_copy_only=False)
        place = np.cumsum(~missing) - 1
        block = kernels.block_from_arrow(self.metric, vectors.filter(pa.array(~missing)) if missing.any() else vectors)
        rows, query, rank, empty = [], [], [], []

        def put(r, q, d, is_null):
            rows.append(r), query.append(q), rank.append(d), empty.append(np.full(len(r), is_null))

        keys = batch.column("__key").to_numpy(zero_copy_only=False)
        count, first = self.side.accepting(keys)
        if not missing.any() and not self.side.missing.any() and count.sum() <= DIRECT_PAIRS * len(keys):
            # few queries per row: measure every pair instead of visiting key by key
            put(*self._direct(block, codes, count, first), False)
            return self._keep(carried, rows, query, rank, empty)
        for members, asked, unasked in self.side.parts(batch):
            solid, holes = members[~missing[members]], members[missing[members]]
            if len(asked) and len(solid):
                base = block if len(solid) == len(block) else block.take(place[solid])
                r, q, d = kernels.nearest_in_block(self.metric, base, codes[solid], self.side.take(asked),
                                                   self.k, self.limit[asked])
                put(solid[r], asked[q], d, False)
                self._tighten(asked, q, d)
            # a missing vector on either side makes the distance NULL, which ranks last
            short = asked[np.isinf(self.limit[asked])]
            for lost, wanting in ((holes, short), (members, unasked)):
                if len(lost) and len(wanting):
                    first = lost[np.argsort(codes[lost], kind="stable")[:self.k]]
                    put(np.tile(first, len(wanting)), np.repeat(wanting, len(first)),
                        np.zeros(len(first) * len(wanting)), True)
        self._keep(carried, rows, query, rank, empty)

    def _tighten(self, asked, query, rank):
        """No row beyond the k-th of a block matters; ``query`` are places in ``asked``, each with its rows nearest first."""
        found = np.bincount(query, minlength=len(asked))
        full = found >= self.k
        worst = rank[np.cumsum(found)[full] - 1]
        self.limit[asked[full]] = np.fmin(self.limit[asked[full]], worst)

    def _direct(self, block, codes, count, first):
        row = np.repeat(np.arange(len(count)), count)
        query = self.side.owner[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(row))]
        if len(row):
            block.check(self.side.block)
        rank = block.exact(self.metric, row, self.side.block, query)
        near = np.flatnonzero(~(rank > self.limit[query]))
        keep = near[kernels.first_k(query[near], rank[near], codes[row[near]], self.k)]
        self._tighten(np.arange(len(self.side)), query[keep], rank[keep])
        return row[keep], query[keep], rank[keep]

    def _keep(self, carried, rows, query, rank, empty):
        if rows:
            row = np.concatenate(rows)
            self.parts.append((carried.take(pa.array(row)), np.concatenate(query), np.concatenate(rank),
                               np.concatenate(empty)))
            self.waiting += len(row)
            if self.waiting > 2 * self.k * len(self.side):
                self.compact()

    def compact(self):
        if not self.parts:
            return
        table = pa.concat_tables([p[0] for p in self.parts]).combine_chunks()
        query, rank, empty = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3))
        codes = kernels.id_codes(table.column(0))
        order = np.lexsort((codes, rank, empty, query))
        q = query[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(q)])
        keep = order[np.arange(len(q)) - np.repeat(starts, sizes) < self.k]
        table, query, rank, empty = table.take(pa.array(keep)).combine_chunks(), query[keep], rank[keep], empty[keep]
        self.parts, self.waiting = [(table, query, rank, empty)], 0
        full = np.bincount(query, minlength=len(self.side)) >= self.k
        worst = np.full(len(self.side), -np.inf)
        np.maximum.at(worst, query, np.where(empty | np.isnan(rank), np.inf, rank))
        self.limit = np.minimum(self.limit, np.where(full, worst, np.inf))

    def result(self, schema: pa.Schema) -> pa.Table:
        self.compact()
        if not self.parts:
            return schema.empty_table()
        table, query, rank, empty = self.parts[0]
        dist = pa.array(kernels.to_distance(self.metric, rank), mask=empty)
        columns = [self.side.ids.take(pa.array(query)), *table.columns, dist]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns],
                        names=schema.names).cast(schema)


def _in_one_order(*ids) -> list[np.ndarray]:
    """Columns of ids as numbers that compare as the ids do, NULL first."""
    whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids]
    if all(pa.types.is_integer(c.type) for c in whole):
        return [c.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy() for c in whole]
    place = pa.compute.rank(pa.concat_arrays(whole), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    return np.split(place, np.cumsum([len(c) for c in whole])[:-1])


class _Ahead:
    """How many rows come before each mark of a query, by distance, then id; marks are rows of the base, nearest first."""

    def __init__(self, metric: Metric, side: _QuerySide, k: int):
        self.metric, self.side = metric, side
        marks = side.table.column("__marks").combine_chunks()
        offsets, (distance, self.marked) = marks.offsets.to_numpy(), marks.flatten().flatten()
        sizes = np.diff(offsets)
        cell = np.repeat(np.arange(len(side)) * k, sizes) + np.arange(sizes.sum()) - np.repeat(offsets[:-1] - offsets[0], sizes)
        self.cells, self.count = cell, np.zeros((len(side), k), np.int64)
        # nothing comes before a mark that is not there
        self.at, self.there = np.zeros(self.count.shape), np.zeros(self.count.shape, bool)
        self.at.ravel()[cell], self.there.ravel()[cell] = distance.to_numpy(zero_copy_only=False), True
        # the last mark is the farthest, and NaN comes after all numbers
        worst = np.max(np.where(self.there, self.at, -np.inf), axis=1, initial=-np.inf)
        far = np.isnan(worst)
        with np.errstate(over="ignore"):
            rank = worst * np.abs(worst) if metric.name.endswith("l2") else worst
            self.limit = np.where(far, np.inf, rank + np.abs(rank) * 1e-12)

    def add(self, batch: pa.RecordBatch):
        if batch.num_rows == 0:
            return
        ids, marked = _in_one_order(batch.column(2), self.marked)
        of_mark = np.zeros(self.count.shape, np.int64)
        of_mark.ravel()[self.cells] = marked
        block = kernels.block_from_arrow(self.metric, batch.column("__vec"))
        for members, asked, unasked in self.side.parts(batch):
            if len(unasked):
                # without a vector all distances are NULL, and ids alone decide
                np.add.at(self.count, unasked, np.searchsorted(np.sort(ids[members]), of_mark[unasked]) * self.there[unasked])
            base = block if len(members) == len(block) else block.take(members)
            step = max(1, kernels.SCREEN_PAIRS // len(members))
            for start in range(0, len(asked), step):
                few = asked[start:start + step]
                r, q, d = kernels.within_limit(self.metric, base, self.side.take(few), self.limit[few])
                mine, d = few[q], d[:, None]
                at = self.at[mine]
                before, tie = d < at, d == at
                if np.isnan(at).any():
                    before, tie = before | (np.isnan(at) & ~np.isnan(d)), tie | (np.isnan(at) & np.isnan(d))
                if tie.any():
                    before |= tie & (ids[members[r]][:, None] < of_mark[mine])
                before &= self.there[mine]
                cell = (q[:, None] * at.shape[1] + np.arange(at.shape[1]))[before]
                np.add.at(self.count, few, np.bincount(cell, minlength=len(few) * at.shape[1]).reshape(len(few), -1))

    def result(self, schema: pa.Schema) -> pa.Table:
        some = np.flatnonzero(self.count.any(axis=1))
        width = self.count.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(self.count[some].ravel()))
        ids = self.side.ids.take(pa.array(some))
        return pa.table([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, lists], names=schema.names).cast(schema)


class _Within:
    """All rows whose distance to a query lies in a range."""

    def __init__(self, metric: Metric, side: _QuerySide, low: float, high: float):
        self.metric, self.side, self.low, self.high = metric, side, low, high

    def pieces(self, batch: pa.RecordBatch, schema: pa.Schema):
        """What a batch gives, in tables from at most ``RANGE_PAIRS`` pairs each."""
        if batch.num_rows == 0:
            return
        carried = pa.Table.from_batches([batch]).drop_columns(["__key", "__vec"])
        block = kernels.block_from_arrow(self.metric, batch.column("__vec"))
        for members, asked, _ in self.side.parts(batch):
            for first in range(0, len(asked), RANGE_QUERIES):
                few = asked[first:first + RANGE_QUERIES]
                queries, step = self.side.take(few), max(1, RANGE_PAIRS // len(few))
                for at in range(0, len(members), step):
                    part = members[at:at + step]
                    base = block if len(part) == len(block) else block.take(part)
                    r, q, d = kernels.within_block(self.metric, base, queries, self.low, self.high)
                    columns = [self.side.ids.take(pa.array(few[q])), *carried.take(pa.array(part[r])).columns, pa.array(d)]
                    yield pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns],
                                   names=schema.names).cast(schema)


def _together(tables, rows: int):
    """Small tables put together until they have ``rows`` rows."""
    waiting, count = [], 0
    for table in tables:
        waiting.append(table)
        count += table.num_rows
        if count >= rows:
            yield pa.concat_tables(waiting).combine_chunks()
            waiting, count = [], 0
    if count:
        yield pa.concat_tables(waiting).combine_chunks()


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _scan(sides: _Sides, table: pa.Table, id: str, metric: Metric, schema: T.StructType, make, flush: bool):
    """Pass the base once by queries that travel with the tasks."""
    left, table = sides.left(table), sides.carried(table)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    payload = sink.getvalue().to_pybytes()

    def run(batches):
        wanted = _arrow_schema(schema)
        state = make(metric, _QuerySide(metric, pa.ipc.open_stream(payload).read_all()))
        for batch in batches:
            if not flush:
                state.add(batch)
                continue
            for piece in _together(state.pieces(batch, wanted), RANGE_ROWS):
                yield from piece.to_batches(max_chunksize=10_000)
        if not flush:
            yield from state.result(wanted).to_batches(max_chunksize=10_000)

    return _spread(left, id).mapInArrow(run, schema)


def _spread(df: DataFrame, id: str) -> DataFrame:
    """Spread a small input over all cores: few files or row groups make few tasks.

    Large inputs have tasks enough and stay where they are.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    low, high = SPREAD_BYTES
    if low <= int(str(size)) <= high:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, id)
    return df


def block_rows_for(k: int) -> int:
    """How many queries a block may have for ``k`` rows of each: what a task keeps stays bounded, also where ``k`` is large."""
    return max(1, min(BROADCAST_ROWS, max(KEPT_ROWS // k, min(8192, 2 * KEPT_ROWS // k))))


def query_blocks(right: DataFrame, query_id: str, keyed: bool, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES):
    """The queries as Arrow tables of bounded rows and bytes, one at a time; those of one key in the same ones."""
    first = bounded_arrow(right, rows, size)
    if first is not None:
        yield first
        return
    right = materialize(right, "query-blocks")
    probe = right.limit(1000).toArrow()
    fits = max(1, min(rows, size // max(1, probe.nbytes // max(1, probe.num_rows))))
    # hashes deal unevenly, so blocks are planned smaller than they may be
    blocks = max(2, -(-right.count() * 4 // (3 * fits)))
    own = F.xxhash64(query_id, "__vec")
    place = F.xxhash64(F.get("__keys", F.lit(0))) if keyed else own
    waiting = [(F.pmod(place, F.lit(blocks)) == i, 0) for i in range(blocks)]
    while waiting:
        mine, bit = waiting.pop()
        found = bounded_arrow(right.filter(mine), rows, size)
        if found is None:
            if bit > 40:
                raise ValueError(f"queries of one id do not fit a block of {rows} rows and {size} bytes")
            # a key that many queries want is cut by one more bit of the queries' own hashes
            half = F.getbit(own, F.lit(bit + 8))
            waiting += [(mine & (half == 0), bit + 1), (mine & (half == 1), bit + 1)]
        elif found.num_rows:
            yield found


def _meet(base, queries, metric, base_id, base_vec, query_id, query_vec, on, payload, nulls, strategy, make, flush, reduce,
          block_rows, along=()):
    metric = metric_of(metric)
    sides = _Sides(base, queries, base_id, base_vec, query_id, query_vec, on, payload, nulls, along)
    schema = _candidate_schema(base, queries, base_id, query_id, payload)
    if strategy not in ("auto", "broadcast", "blocks"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "broadcast" and bounded_arrow(sides.right) is None:
        raise ValueError("the queries are too large to travel with the tasks")
    found = _rounds(sides, query_id, base_id, metric, schema, make, flush, reduce, block_rows)
    return reduce(base.sparkSession.createDataFrame([], schema)) if found is None else found


def _rounds(sides: _Sides, query_id, base_id, metric, schema, make, flush, reduce, block_rows) -> DataFrame | None:
    """What all blocks of queries give, or None where there are no queries."""
    done, last = None, None
    for table in query_blocks(sides.right, query_id, bool(sides.pairs), block_rows):
        if last is not None:
            # a round ends before the next block is fetched, so the driver holds one block
            found = materialize(last, "query-round")
            done = found if done is None else done.unionByName(found)
        last = reduce(_scan(sides, table, base_id, metric, schema, make, flush))
    return last if done is None else done.unionByName(last)


def _nearest(base, queries, k, metric, base_id, base_vec, query_id, query_vec, on, payload, nulls, strategy, block_rows, reduce):
    if k < 1:
        raise ValueError("k must be at least 1")
    return _meet(base, queries, metric, base_id, base_vec, query_id, query_vec, on, list(payload), nulls, strategy,
                 lambda metric, side: _Nearest(metric, side, k), False, reduce, block_rows or block_rows_for(k),
                 [LIMIT] if LIMIT in queries.columns else [])


def knn_candidates(base: DataFrame, queries: DataFrame, k: int, metric="l2", *, base_id="id", base_vec="embedding",
                   query_id="query_id", query_vec="embedding", on=None, payload=(), nulls="last",
                   strategy="auto", block_rows: int | None = None) -> DataFrame:
    """At most k rows per query and task, among them the k nearest of every query."""
    return _nearest(base, queries, k, metric, base_id, base_vec, query_id, query_vec, on, payload, nulls, strategy, block_rows,
                    lambda found: found)


def knn_join(base: DataFrame, queries: DataFrame, k: int, metric="l2", *, base_id="id", base_vec="embedding",
             query_id="query_id", query_vec="embedding", on=None, payload=(), nulls="last",
             strategy="auto", block_rows: int | None = None) -> DataFrame:
    """The k nearest base rows of every query: ``query_id, base_id, payload, distance, rank``.

    ``on`` names columns that must be equal on both sides, as ``"label"`` or
    ``("base_col", "query_col")``. NULL vectors rank last, or are left out with
    ``nulls="skip"``; ties go to the lower id. Queries beyond ``block_rows`` (by default
    up to 131,072, fewer for a large ``k``) or 64 MB are answered in rounds, which run when this is called.
    A column ``__limit`` of the queries holds a distance that at least ``k`` rows of the query id are known not to exceed.
    """
    return _nearest(base, queries, k, metric, base_id, base_vec, query_id, query_vec, on, payload, nulls, strategy, block_rows,
                    lambda found: take_nearest(found, k, [query_id], base_id))


def count_ahead(base: DataFrame, queries: DataFrame, found: DataFrame, k: int, metric="l2", *, base_id="id", base_vec="embedding",
                query_id="query_id", query_vec="embedding", on=None) -> DataFrame:
    """Add ``ahead`` to ``found``: how many rows that its query may visit come before a row by distance, then id.

    ``found`` are rows of the base with ``distance`` and ``rank`` (1 to ``k``) per query id, from a stored table. Rows without a
    vector are not counted. A task sends one row of ``k`` counts per query, however many rows lie ahead. Rows that agree in
    distance and id follow each other by rank; queries of one id count together.
    """
    marks = found.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "distance", base_id))).alias("__marks"))
    marks = marks.select(F.col(query_id).alias("__asker"), F.transform("__marks", lambda m: F.struct(
        m["distance"].alias("distance"), m[base_id].alias("id"))).alias("__marks"))
    asked = queries.join(marks, F.col(query_id).eqNullSafe(F.col("__asker"))).drop("__asker")
    metric = metric_of(metric)
    sides = _Sides(base, asked, base_id, base_vec, query_id, query_vec, on, [], "skip", ["__marks"])
    schema = T.StructType([queries.schema[query_id], T.StructField("__ahead", T.ArrayType(T.LongType()))])

    def added(counts):
        return counts.groupBy(query_id).agg(F.array(*[F.sum(F.get("__ahead", F.lit(j))) for j in range(k)]).alias("__ahead"))

    parts = _rounds(sides, query_id, base_id, metric, schema, lambda metric, side: _Ahead(metric, side, k), False, added, block_rows_for(k))
    if parts is None:
        return found.withColumn("ahead", F.lit(0).cast("bigint"))
    counts = added(parts).withColumnRenamed(query_id, "__asker")
    alike = F.rank().over(Window.partitionBy(query_id).orderBy(F.col("distance").asc_nulls_last(), F.col(base_id)))
    out = found.join(counts, F.col(query_id).eqNullSafe(F.col("__asker")), "left").withColumn("__alike", F.col("rank") - alike)
    ahead = F.coalesce(F.get("__ahead", F.col("rank") - 1), F.lit(0)) + F.col("__alike")
    return out.withColumn("ahead", ahead).select(*found.columns, "ahead")


def range_join(base: DataFrame, queries: DataFrame, below: float = float("inf"), above: float = float("-inf"),
               metric="l2", *, base_id="id", base_vec="embedding", query_id="query_id", query_vec="embedding",
               on=None, payload=(), strategy="auto", block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All (query, row) pairs with ``above < distance < below``."""
    return _meet(base, queries.filter(as_col(query_vec).isNotNull()), metric, base_id, base_vec, query_id, query_vec,
                 on, list(payload), "skip", strategy,
                 lambda metric, side: _Within(metric, side, above, below), True, lambda found: found, block_rows)
