"""Inverted-list index: k-means centres, rows stored by nearest centre, probed search.

An index is a folder: ``entries`` (parquet, by ``folder`` and ``list_id``), ``centers``
(one small table), ``deleted`` (ids taken out and not yet vacuumed) and ``manifest``,
whose latest version says which folders count. Inserts, deletes and vacuums write
folders of their own and then a version; no stored file is ever changed. Centres
are bounded by a checked size and travel with the tasks; everything else stays in
tables.
"""

from __future__ import annotations

import json
import uuid
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vecspark.functions import dense
from vecspark.operators import kernels
from vecspark.operators.kernels import METRICS, DenseBlock, Metric, metric_of
from vecspark.operators.knn import LIMIT, _key_pairs, count_ahead, knn_join, take_nearest
from vecspark.plans.manifest import Manifest, Part, State
from vecspark.session import folder_names, materialize, remove_matching, remove_path, scratch_path
from vecspark.types import as_col

# Fixed parameter ranges and defaults.
LISTS_DEFAULT, LISTS_MAX = 100, 32768
PROBES_DEFAULT, PROBES_MAX = 1, 32768
# From this many lists a query on, its nearest one is searched first in few dimensions, which bounds what is wanted of the others.
BOUNDED_LISTS = 4
SAMPLE_PER_LIST, SAMPLE_MIN = 50, 10_000

# Centres travel with every task, so their total size is limited.
CENTER_CELLS = 32 << 20
SAMPLE_ROWS_PER_TASK = 50_000
# Numbers of a sample that one task takes through all k-means steps.
SETTLE_CELLS = 8 << 20
# Pairs of centres measured at once.
RATIO_CELLS = 1 << 18


def check_range(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"value {value} out of bounds for option \"{name}\" (valid values {low} to {high})")
    return value


def features(metric: Metric, column) -> DenseBlock:
    """Vectors as k-means sees them: unit vectors for angular metrics, 0/1 for bits."""
    if metric.kind == "bit":
        bits = kernels.BitBlock.from_arrow(column)
        raw = bits.words.astype(">u8").view(np.uint8).reshape(len(bits), -1)
        length = int(bits.lengths[0]) if len(bits) else 0
        return DenseBlock(np.unpackbits(raw, axis=1)[:, :length].astype(np.float64))
    block = DenseBlock.from_arrow(column)
    if metric.train == "spherical":
        norm = np.sqrt(block.norms)[:, None]
        return DenseBlock(np.divide(block.data, norm, out=np.zeros_like(block.data), where=norm > 0))
    return block


def _round_centers(metric: Metric, centers: np.ndarray, half: bool) -> np.ndarray:
    """Centres in the type of the rows: bits by majority, halves rounded, floats clamped."""
    if metric.kind == "bit":
        return (centers > 0.5).astype(np.float64)
    if metric.train == "spherical":
        norm = np.sqrt((centers ** 2).sum(axis=1, keepdims=True))
        centers = np.divide(centers, norm, out=centers.copy(), where=norm > 0)
    centers = np.clip(centers, -kernels.FLOAT_MAX, kernels.FLOAT_MAX).astype(np.float32)
    if half:
        centers = np.clip(centers, -65504, 65504).astype(np.float16)
    return centers.astype(np.float64)


def usable(df: DataFrame, metric: Metric, vec: str, for_training: bool = False) -> DataFrame:
    """Rows an index holds: NULL vectors never, zero vectors not under angular metrics."""
    out = df.filter(F.col(vec).isNotNull())
    if metric.kind == "dense" and (metric.skip_zero or (for_training and metric.train == "spherical")):
        out = out.filter(dense.vector_norm(vec) > 0)
    return out


def training_sample(df: DataFrame, metric, lists: int, vec: str = "embedding", id: str = "id",
                    seed: int = 7) -> DataFrame:
    """About ``max(50 * lists, 10000)`` rows, picked by a hash of the id.

    The pick does not depend on partitioning, so a lost task picks the same rows.
    The sample is a table in the shared folder.
    """
    metric = metric_of(metric)
    rows = usable(df, metric, vec, for_training=True).select(F.col(id).alias("id"), F.col(vec).alias("vec"))
    total = rows.count()
    wanted = max(SAMPLE_PER_LIST * lists, SAMPLE_MIN)
    if total > wanted:
        scale = 1 << 31
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(scale)) < int(scale * wanted / total))
    tasks = max(1, min(wanted, total) // SAMPLE_ROWS_PER_TASK)
    return materialize(rows.repartition(tasks, "id") if total else rows, "ivf-sample")


def _collect_rows(df: DataFrame, metric: Metric) -> np.ndarray:
    return features(metric, df.select("vec").toArrow().column("vec")).data


def _partial_sums(sample: DataFrame, metric: Metric, centers: np.ndarray) -> DataFrame:
    """Per task and list: row count, sum of rows, sum of distances."""
    lists = len(centers)
    schema = "list_id int, n bigint, inertia double, total array<double>"

    def run(batches):
        base = DenseBlock(centers)
        count, inertia, total = np.zeros(lists, np.int64), np.zeros(lists), np.zeros_like(centers)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = features(metric, batch.column("vec"))
            nearest, rank = kernels.nearest_center(metric.train, rows, base)
            order = np.argsort(nearest, kind="stable")
            groups, first = np.unique(nearest[order], return_index=True)
            total[groups] += np.add.reduceat(rows.data[order], first, axis=0)
            count += np.bincount(nearest, minlength=lists)
            inertia += np.bincount(nearest, weights=train_distance(metric, rank), minlength=lists)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(inertia[used]),
             pa.array(list(total[used]), type=pa.list_(pa.float64()))], names=["list_id", "n", "inertia", "total"])

    return sample.select("vec").mapInArrow(run, schema)


def train_distance(metric: Metric, rank: np.ndarray) -> np.ndarray:
    """The k-means distance behind a ranking value."""
    if metric.train == "spherical":
        return np.arccos(np.clip(-rank, -1, 1)) / np.pi
    return rank if metric.kind == "bit" else np.sqrt(np.maximum(rank, 0))


def _lloyd_step(sample: DataFrame, metric: Metric, centers: np.ndarray):
    """Counts, means and total distance after assigning the sample once."""
    lists, dim = centers.shape
    partial = _partial_sums(sample, metric, centers)
    table = merge_partials(partial).toArrow()
    ids = table.column("list_id").to_numpy()
    count = np.zeros(lists, np.int64)
    count[ids] = table.column("n").to_numpy()
    means = np.zeros((lists, dim))
    if len(ids):
        means[ids] = DenseBlock.from_arrow(table.column("total")).data / count[ids][:, None]
    return count, means, float(np.sum(table.column("inertia").to_numpy()))


def merge_partials(partial: DataFrame) -> DataFrame:
    """Add up the tasks' counts, distances and sums: lists are shuffled, then summed in their task."""

    def run(batches):
        merged = {}
        for batch in batches:
            ids = batch.column("list_id").to_numpy()
            totals = DenseBlock.from_arrow(batch.column("total")).data
            for i, n, cost, total in zip(ids, batch.column("n").to_numpy(), batch.column("inertia").to_numpy(), totals):
                old = merged.get(i, (0, 0.0, 0.0))
                merged[i] = (old[0] + n, old[1] + cost, old[2] + total)
        if merged:
            n, cost, total = zip(*merged.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(merged), type=pa.int32()), pa.array(n, type=pa.int64()), pa.array(cost),
                 pa.array(list(total), type=pa.list_(pa.float64()))], names=batch.schema.names)

    return partial.repartition("list_id").mapInArrow(run, partial.schema)


def _seed_centers(sample: DataFrame, metric: Metric, lists: int, rng, rounds: int = 4) -> np.ndarray:
    """At most ``lists`` rows, drawn in a few passes in which rows far from those drawn before come up more often.

    Tasks draw; the driver holds what was drawn, somewhat more than ``lists`` rows at most, and of those keeps
    the ones that most of the sample lies near.
    """
    seed = int(rng.integers(1 << 30))
    picked = _collect_rows(sample.orderBy(F.xxhash64("id", F.lit(seed))).limit(1), metric)
    total = None
    for left in range(rounds, 0, -1):
        wanted = 1.2 * (lists - len(picked)) / left
        if wanted <= 0:
            break
        drawn, total = _draw_far(sample, metric, picked, wanted, rng, total)
        picked = np.unique(np.concatenate([picked, drawn]), axis=0)
    if len(picked) > lists:
        weight, _, _ = _lloyd_step(sample, metric, picked)
        picked = picked[np.sort(np.argsort(-weight, kind="stable")[:lists])]
    return picked


def _draw_far(sample: DataFrame, metric: Metric, picked: np.ndarray, wanted: float, rng, total: float | None):
    """About ``wanted`` rows, each drawn with a chance growing with its squared distance, and the sum of those.

    ``total`` is the sum as it was before the last draw; the sum only falls, so it draws rather fewer rows.
    """
    seed = int(rng.integers(1 << 30))
    rows = sample.select(F.xxhash64("id", F.lit(seed)).alias("id_hash"), "vec")
    schema = "cost double, vec " + dict(sample.dtypes)["vec"]

    def run(batches, scale):
        base, spent = DenseBlock(picked), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, rank = kernels.nearest_center(metric.train, features(metric, batch.column("vec")), base)
            cost = train_distance(metric, rank) ** 2
            spent += float(cost.sum())
            # a hash of the id stands for the random number, so a lost task draws the same rows
            uniform = (batch.column("id_hash").to_numpy() & ((1 << 31) - 1)) / float(1 << 31)
            drawn = np.flatnonzero(uniform < cost * scale)
            if len(drawn):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(drawn), pa.float64()), batch.column("vec").take(pa.array(drawn))], names=["cost", "vec"])
        yield pa.RecordBatch.from_arrays([pa.array([spent]), pa.nulls(1, batch_type(schema_of))], names=["cost", "vec"])

    schema_of = sample.schema["vec"].dataType

    def batch_type(dtype):
        from pyspark.sql.pandas.types import to_arrow_type
        return to_arrow_type(dtype)

    if total is None:
        total = rows.mapInArrow(lambda batches: run(batches, 0.0), schema).agg(F.sum("cost")).first()[0] or 0.0
    if total <= 0:
        return picked[:0], 0.0
    found = rows.mapInArrow(lambda batches: run(batches, wanted / total), schema).toArrow()
    cost = found.column("cost")
    drawn, total = found.filter(cost.is_null()), float(pa.compute.sum(cost).as_py() or 0.0)
    return (features(metric, drawn.column("vec")).data if drawn.num_rows else picked[:0]), total


def _settle(sample: DataFrame, metric: Metric, centers: np.ndarray, half: bool, steps: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Steps over a sample that lies in one task, all in it: (centres, rows per list, steps taken).

    Ends when nothing moves, or when a list has lost all its rows.
    """
    schema = "n bigint, steps int, center array<double>"

    def run(batches):
        blocks = [features(metric, b.column("vec")) for b in batches if b.num_rows]
        now, taken = centers, 0
        while True:
            count, total, base = np.zeros(len(now), np.int64), np.zeros_like(now), DenseBlock(now)
            for rows in blocks:
                nearest, _ = kernels.nearest_center(metric.train, rows, base)
                order = np.argsort(nearest, kind="stable")
                groups, first = np.unique(nearest[order], return_index=True)
                total[groups] += np.add.reduceat(rows.data[order], first, axis=0)
                count += np.bincount(nearest, minlength=len(now))
            taken += 1
            means = np.divide(total, count[:, None], out=now.copy(), where=(count > 0)[:, None])
            moved = _round_centers(metric, means, half)
            still = np.array_equal(moved, now)
            now = moved
            if still or taken >= steps or (count == 0).any():
                break
        yield pa.RecordBatch.from_arrays([pa.array(count), pa.array(np.full(len(now), taken, np.int32)),
                                          pa.array(list(now), type=pa.list_(pa.float64()))], names=["n", "steps", "center"])

    table = sample.coalesce(1).select("vec").mapInArrow(run, schema).toArrow()
    return DenseBlock.from_arrow(table.column("center")).data, table.column("n").to_numpy(), table.column("steps")[0].as_py()


def train_centers(df: DataFrame, metric="l2", lists: int = LISTS_DEFAULT, vec: str = "embedding", id: str = "id",
                  seed: int = 7, max_iter: int = 500, dim: int | None = None, half: bool = False) -> np.ndarray:
    """k-means centres of a sample of ``df``: Lloyd steps until nothing moves.

    A list that loses all its rows restarts at a random place. Without any rows
    the centres are random vectors of dimension ``dim``.
    """
    metric = metric_of(metric)
    if metric.train is None:
        raise ValueError(f"metric {metric.name} has no inverted-list index")
    check_range("lists", lists, 1, LISTS_MAX)
    rng = np.random.default_rng(seed)
    sample = training_sample(df, metric, lists, vec, id, seed)
    total = sample.count()
    if total < lists:
        warnings.warn("inverted-list index created with little data: recall will be low until it is rebuilt",
                      stacklevel=2)
    if total == 0:
        if dim is None:
            raise ValueError("the dimension must be declared when there are no rows")
        return _round_centers(metric, rng.random((lists, dim)), half)
    first = _seed_centers(sample, metric, lists, rng)
    dim = first.shape[1]
    if lists * dim > CENTER_CELLS:
        raise ValueError(f"{lists} centres of {dim} dimensions are too large to travel with the tasks")
    centers = _fill(metric, first, lists, dim, rng, half)
    if total <= SAMPLE_ROWS_PER_TASK and total * dim <= SETTLE_CELLS:
        # the sample is one task's, which can take all steps without a job for each
        while max_iter > 0:
            centers, count, taken = _settle(sample, metric, centers, half, max_iter)
            max_iter, lost = max_iter - taken, count == 0
            if not lost.any() or total < lists or max_iter <= 0:
                break
            centers[lost] = _fill(metric, centers[:0], int(lost.sum()), dim, rng, half, low=centers.min(axis=0), high=centers.max(axis=0))
        return centers
    for step in range(max_iter):
        count, means, _ = _lloyd_step(sample, metric, centers)
        moved = _round_centers(metric, np.where((count > 0)[:, None], means, centers), half)
        lost = count == 0
        if lost.any() and total >= lists and step < max_iter - 1:
            moved[lost] = _fill(metric, moved[:0], int(lost.sum()), dim, rng, half,
                                low=centers.min(axis=0), high=centers.max(axis=0))
        if np.array_equal(moved[~lost], centers[~lost]):
            break
        centers = moved
    return centers


def _fill(metric: Metric, rows: np.ndarray, lists: int, dim: int, rng, half: bool, low=0.0, high=1.0) -> np.ndarray:
    """Random centres for the places that rows do not fill."""
    more = lists - len(rows)
    if len(rows):
        low, high = rows.min(axis=0), rows.max(axis=0)
    random = low + (high - low) * rng.random((more, dim))
    return _round_centers(metric, np.concatenate([rows.reshape(-1, dim), random]), half)


def assign(df: DataFrame, centers: np.ndarray, metric="l2", vec: str = "embedding") -> DataFrame:
    """Add the nearest centre of every row as ``list_id`` (lower id on a tie) and the distance to it.

    Map-only, hence usable on a stream as well; rows an index skips are left out.
    """
    metric = metric_of(metric)
    rows = usable(df, metric, vec)
    schema = T.StructType([*rows.schema.fields, T.StructField("list_id", T.IntegerType()),
                           T.StructField("center_distance", T.DoubleType())])

    def run(batches):
        base = DenseBlock(centers)
        for batch in batches:
            if batch.num_rows:
                nearest, rank = kernels.nearest_center(metric.train, features(metric, batch.column(vec)), base)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(train_distance(metric, rank))],
                    names=[*batch.schema.names, "list_id", "center_distance"])

    return rows.mapInArrow(run, schema)


def probe_lists(queries: DataFrame, centers: np.ndarray, probes: int, metric="l2",
                vec: str = "query_vec") -> DataFrame:
    """Add ``lists``: the ids of the ``probes`` nearest centres of every query, nearest first.

    A query without a vector visits the first lists.
    """
    metric = metric_of(metric)
    probes = min(probes, len(centers))
    schema = T.StructType([*queries.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    ranker = METRICS["ip" if metric.train == "spherical" else "l2"]

    def run(batches):
        base, codes = DenseBlock(centers), np.arange(len(centers))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            missing = batch.column(vec).is_null().to_numpy(zero_copy_only=False)
            asked = features(metric, batch.column(vec).filter(pa.array(~missing)))
            row, query, rank = kernels.nearest_in_block(ranker, base, codes, asked, probes)
            order = np.lexsort((row, rank, query))
            lists = np.tile(np.arange(probes, dtype=np.int32), (len(missing), 1))
            lists[~missing] = row[order].reshape(len(asked), probes)
            offsets = pa.array(np.arange(len(missing) + 1, dtype=np.int32) * probes)
            column = pa.ListArray.from_arrays(offsets, pa.array(lists.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "lists"])

    return queries.mapInArrow(run, schema)


@dataclass
class IvfIndex:
    """A built index: where it is, and its centres."""

    spark: SparkSession
    path: str
    metric: Metric
    centers: np.ndarray
    vec: str
    id: str
    schema: T.StructType
    partition_by: list[str] = field(default_factory=list)
    half: bool = False

    @classmethod
    def build(cls, df: DataFrame, metric="l2", lists: int = LISTS_DEFAULT, vec: str = "embedding", id: str = "id",
              path: str | None = None, partition_by=(), centers=None, seed: int = 7, max_iter: int = 500,
              dim: int | None = None, half: bool = False) -> IvfIndex:
        """Train centres (unless given), assign every row and store the rows by list.

        ``partition_by`` adds columns above the list in the folder layout, so that a
        filter on them prunes files; build on a filtered ``df`` for a partial index.
        """
        metric = metric_of(metric)
        spark = df.sparkSession
        if centers is None:
            centers = train_centers(df, metric, lists, vec, id, seed, max_iter, dim, half)
        else:
            centers = _round_centers(metric, np.asarray(centers, dtype=np.float64), half)
        if centers.size > CENTER_CELLS:
            raise ValueError("the centres are too large to travel with the tasks")
        index = cls(spark, path or scratch_path(spark, "ivf"), metric, centers, vec, id, df.schema,
                    list(partition_by), half)
        index._save()
        index.manifest.create()
        index.insert(df, part="base")
        return index

    def _save(self):
        meta = json.dumps({"metric": self.metric.name, "vec": self.vec, "id": self.id, "half": self.half,
                           "partition_by": self.partition_by, "schema": self.schema.jsonValue()})
        rows = [(i, [float(x) for x in c], meta if i == 0 else None) for i, c in enumerate(self.centers)]
        self.spark.createDataFrame(rows, "list_id int, center array<double>, meta string").coalesce(1) \
            .write.parquet(f"{self.path}/centers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        table = spark.read.parquet(f"{path}/centers").orderBy("list_id").toArrow()
        meta = json.loads(table.column("meta")[0].as_py())
        return cls(spark, path, metric_of(meta["metric"]), DenseBlock.from_arrow(table.column("center")).data,
                   meta["vec"], meta["id"], T.StructType.fromJson(meta["schema"]), meta["partition_by"], meta["half"])

    def insert(self, df: DataFrame, part: str | None = None) -> None:
        """Assign new rows to the existing centres and store them; centres never move.

        Writing the same ``part`` again replaces it, so a repeated insert is harmless, and brings back its rows
        even where they had been deleted.
        """
        part, folder = part or f"insert-{uuid.uuid4().hex}", uuid.uuid4().hex
        placed = assign(df, self.centers, self.metric, self.vec)
        folders = [*self.partition_by, "list_id"]
        # rebalancing sends a list to one place but splits a list that is too large for it
        placed.hint("rebalance", *folders).write.partitionBy(*folders).parquet(f"{self.path}/entries/folder={folder}")
        self.manifest.commit(lambda state: State([p for p in state.parts if p.name != part] + [Part(part, folder)], state.deletes))

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, self.path)

    def _rows_of(self, state: State) -> DataFrame:
        """All rows of a version, deleted ones too."""
        fields = [*self.schema.fields, T.StructField("list_id", T.IntegerType()),
                  T.StructField("center_distance", T.DoubleType()), T.StructField("folder", T.StringType())]
        reader = self.spark.read.schema(T.StructType(fields))
        if not state.parts:
            return self.spark.createDataFrame([], T.StructType(fields))
        rows = reader.option("basePath", f"{self.path}/entries").parquet(*(f"{self.path}/entries/folder={f}" for f in dict.fromkeys(state.folders())))
        # lists that a vacuum has written anew; folder and list are folders of the layout, so nothing of them is read
        for part in state.parts:
            if part.without:
                rows = rows.filter(~((F.col("folder") == part.folder) & F.col("list_id").isin(part.without)))
        return rows

    def _gone(self, state: State) -> DataFrame | None:
        """(id, folder) of the rows that deletes took out of a folder."""
        if not state.deletes:
            return None
        schema = T.StructType([self.schema[self.id], T.StructField("folder", T.StringType())])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/deleted/{d}" for d in state.deletes)).distinct()

    @property
    def stored(self) -> DataFrame:
        return self._rows_of(self.manifest.read()[1])

    def entries(self) -> DataFrame:
        """The live rows with their list, of the version that is the latest now."""
        _, state = self.manifest.read()
        rows, gone = self._rows_of(state), self._gone(state)
        return rows if gone is None else rows.join(gone, [self.id, "folder"], "left_anti")

    def delete(self, ids: DataFrame) -> None:
        """Take rows out by id from the folders stored so far; an id inserted later lies in another folder and is live.

        Lists and centres stay. ``vacuum`` frees the space.
        """
        ids = ids.select(F.col(ids.columns[0]).cast(self.schema[self.id].dataType).alias(self.id)).distinct()
        name = uuid.uuid4().hex
        self.stored.select(self.id, "folder").join(ids, self.id, "left_semi").distinct().write.parquet(f"{self.path}/deleted/{name}")
        self.manifest.commit(lambda state: State(state.parts, [*state.deletes, name]))

    def vacuum(self) -> None:
        """Write the lists that lost rows anew, without them, beside the old ones; a reader keeps the version it has.

        Rows that other writers delete or replace meanwhile stay deleted or replaced.
        """
        _, state = self.manifest.read()
        gone = self._gone(state)
        if gone is None:
            return
        folders = ["folder", *self.partition_by, "list_id"]
        rows = self._rows_of(state)
        touched = rows.join(gone, [self.id, "folder"], "left_semi").select("folder", "list_id").distinct()
        # folders times lists at most
        lists: dict[str, set[int]] = {}
        for folder, list_id in touched.collect():
            lists.setdefault(folder, set()).add(list_id)
        run = uuid.uuid4().hex
        here = F.lit(False)
        for folder, numbers in lists.items():
            here = here | ((F.col("folder") == folder) & F.col("list_id").isin(sorted(numbers)))
        left = rows.filter(here).join(gone, [self.id, "folder"], "left_anti")
        left = left.withColumn("folder", F.concat(F.col("folder"), F.lit(f"-{run}")))
        left.hint("rebalance", *folders).write.mode("append").partitionBy(*folders).parquet(f"{self.path}/entries")
        written = {name.removeprefix("folder=") for name in folder_names(self.spark, f"{self.path}/entries")}

        def switch(now: State) -> State:
            parts, moved = [], {}
            for part in now.parts:
                parts.append(Part(part.name, part.folder, sorted({*part.without, *lists.get(part.folder, ())})))
                if part.folder in lists and f"{part.folder}-{run}" in written:
                    parts.append(Part(part.name, f"{part.folder}-{run}"))
                    moved[part.folder] = f"{part.folder}-{run}"
            later = [d for d in now.deletes if d not in state.deletes]
            if later and moved:
                # deletes of rows that have moved meanwhile
                again = uuid.uuid4().hex
                table = self._gone(State([], later))
                places = self.spark.createDataFrame(list(moved.items()), "folder string, __to string")
                table.join(places, "folder").select(self.id, F.col("__to").alias("folder")).write.parquet(f"{self.path}/deleted/{again}")
                later.append(again)
            return State(parts, later)

        self.manifest.commit(switch)

    def purge(self, keep: int = 1) -> None:
        """Remove versions but the latest ``keep`` and the folders none of them names; readers of older versions lose theirs."""
        named = self.manifest.forget_before(keep)
        for kind, used in (("entries", {f"folder={f}" for f in named.folders()}), ("deleted", set(named.deletes))):
            for name in folder_names(self.spark, f"{self.path}/{kind}"):
                if name not in used and not name.startswith("_"):
                    remove_path(self.spark, f"{self.path}/{kind}/{name}")
        for folder in set(named.folders()):
            # lists that no kept version reads from this folder
            for number in set.intersection(*(set(p.without) for p in named.parts if p.folder == folder)):
                remove_matching(self.spark, f"{self.path}/entries/folder={folder}{'/*' * len(self.partition_by)}/list_id={number}")

    def _asked(self, queries: DataFrame, query_id: str, query_vec: str, pairs, probes: int) -> DataFrame:
        # the stored column may share a name with a query column, hence the prefix
        cols = [F.col(query_id), as_col(query_vec).alias("__asked")]
        cols += [F.col(q).alias(f"__on{i}") for i, (_, q) in enumerate(pairs)]
        return probe_lists(queries.select(*cols), self.centers, probes, self.metric, "__asked")

    def search(self, queries: DataFrame, k: int, probes: int = PROBES_DEFAULT, *, query_id: str = "query_id",
               query_vec: str = "embedding", on=None, where: Column | None = None, payload=(),
               strategy: str = "auto") -> DataFrame:
        """The k nearest rows of every query among its ``probes`` nearest lists.

        ``where`` filters stored rows and ``on`` wants equal columns; both apply
        before the k are taken, so fewer than k rows mean the lists held no more.
        """
        check_range("probes", probes, 1, PROBES_MAX)
        pairs = _key_pairs(on)
        asked = self._asked(queries, query_id, query_vec, pairs, probes)
        if min(probes, len(self.centers)) >= BOUNDED_LISTS and self.metric.name in ("l1", "l2") and self.centers.shape[1] <= kernels.BOX_DIMS:
            asked = self._bounded(materialize(asked, "ivf-probes"), k, query_id, pairs, where, strategy)
        return self._probe(asked, k, query_id, pairs, where, payload, strategy)

    def _bounded(self, asked, k, query_id, pairs, where, strategy) -> DataFrame:
        """The queries with the distance of the k-th row of their nearest lists: rows beyond it, in far lists nearly all, are not compared."""
        first = self._probe(asked.withColumn("lists", F.slice("lists", 1, 1)), k, query_id, pairs, where, (), strategy)
        worst = first.groupBy(F.col(query_id).alias("__asker")).agg(F.max("distance").alias(LIMIT), F.count(F.lit(1)).alias("__n"))
        worst = materialize(worst.filter(F.col("__n") >= k).drop("__n"), "ivf-limits")
        return asked.join(worst, F.col(query_id).eqNullSafe(F.col("__asker")), "left").drop("__asker")

    def _probe(self, asked, k, query_id, pairs, where, payload, strategy="auto") -> DataFrame:
        rows = self.entries()
        if where is not None:
            rows = rows.filter(where)
        on = [("list_id", "lists"), *[(b, f"__on{i}") for i, (b, _) in enumerate(pairs)]]
        return knn_join(rows, asked, k, self.metric, base_id=self.id, base_vec=self.vec, query_id=query_id,
                        query_vec="__asked", on=on, payload=payload, nulls="skip", strategy=strategy)

    def count_ahead(self, queries: DataFrame, found: DataFrame, k: int, probes: int = PROBES_DEFAULT, *, query_id: str = "query_id",
                    query_vec: str = "embedding") -> DataFrame:
        """Add to rows that a filtered search found how many rows, of any kind, its unfiltered search would put ``ahead``."""
        asked = self._asked(queries, query_id, query_vec, [], probes)
        return count_ahead(self.entries(), asked, found, k, self.metric, base_id=self.id, base_vec=self.vec, query_id=query_id,
                           query_vec="__asked", on=[("list_id", "lists")])

    def search_iterative(self, queries: DataFrame, k: int, probes: int = PROBES_DEFAULT,
                         max_probes: int = PROBES_MAX, *, query_id: str = "query_id", query_vec: str = "embedding",
                         on=None, where: Column | None = None, payload=(), relaxed: bool = True) -> DataFrame:
        """Go on to the next ``probes`` lists while a query has fewer than k rows.

        Adds ``batch``, the round in which a row was found. With ``relaxed`` the
        order holds within a round only; otherwise rows are ranked by distance.
        """
        check_range("probes", probes, 1, PROBES_MAX)
        check_range("max_probes", max_probes, 1, PROBES_MAX)
        limit = min(max(max_probes, probes), len(self.centers))
        pairs = _key_pairs(on)
        asked = materialize(self._asked(queries, query_id, query_vec, pairs, limit), "ivf-probes")
        pending, found = asked, None
        for batch, start in enumerate(range(0, limit, probes)):
            now = pending.withColumn("lists", F.slice("lists", start + 1, probes))
            hits = self._probe(now, k, query_id, pairs, where, payload).drop("rank")
            hits = materialize(hits.withColumn("batch", F.lit(batch)), "ivf-hits")
            found = hits if found is None else found.unionByName(hits)
            if start + probes >= limit:
                break
            full = found.groupBy(query_id).count().filter(F.col("count") >= k).select(query_id)
            pending = asked.join(full, query_id, "left_anti")
            if pending.isEmpty():
                break
        if relaxed:
            place = F.struct(F.col("batch"), F.col("distance").isNull(), F.col("distance"), F.col(self.id))
            return take_nearest(found.withColumn("__place", place), k, [query_id], self.id, "__place").drop("__place")
        return take_nearest(found, k, [query_id], self.id)

    def range_search(self, queries: DataFrame, below: float, *, query_id: str = "query_id",
                     query_vec: str = "embedding", payload=()) -> DataFrame:
        """All rows closer than ``below`` to a query, visiting only lists that can hold one.

        Exact for L2: by the triangle inequality a list whose centre is farther
        than ``below`` plus its radius holds none.
        """
        from vecspark.operators.knn import range_join
        if self.metric.name != "l2":
            raise ValueError("lists can be ruled out for the l2 metric only")
        asked = self._asked(queries, query_id, query_vec, [], len(self.centers))
        centers = self.spark.read.parquet(f"{self.path}/centers").drop("meta")
        radius = self.stored.groupBy("list_id").agg(F.max("center_distance").alias("__radius"))
        near = (asked.select(query_id, "__asked", F.explode("lists").alias("list_id"))
                .join(radius.join(centers, "list_id"), "list_id")
                .filter(dense.l2_distance(F.col("__asked"), F.col("center")) <= (F.col("__radius") + below) * (1 + 1e-9))
                .groupBy(query_id).agg(F.collect_list("list_id").alias("lists")))
        reach = asked.drop("lists").join(near, query_id)
        return range_join(self.entries(), reach, below, metric=self.metric, base_id=self.id, base_vec=self.vec,
                          query_id=query_id, query_vec="__asked", on=[("list_id", "lists")], payload=payload)

    def comparisons(self, queries: DataFrame, probes: int, *, query_id: str = "query_id",
                    query_vec: str = "embedding") -> float:
        """Rows measured per query, on average: the sizes of the lists it visits."""
        asked = self._asked(queries, query_id, query_vec, [], probes)
        visited = asked.select(query_id, F.explode("lists").alias("list_id")).join(self.list_sizes(), "list_id")
        total, count = visited.agg(F.sum("rows"), F.countDistinct(query_id)).first()
        return float(total or 0) / max(1, count)

    def list_sizes(self) -> DataFrame:
        """Rows and mean distance to the centre per list, to see skew."""
        return self.entries().groupBy("list_id").agg(F.count(F.lit(1)).alias("rows"),
                                                     F.avg("center_distance").alias("mean_distance"))

    def inertia(self) -> float:
        return self.entries().agg(F.sum("center_distance")).first()[0] or 0.0

    def davies_bouldin(self) -> DataFrame:
        return davies_bouldin(self.list_sizes(), self.centers, self.spark, self.metric)


def center_table(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                 "list_id int, center array<double>")


def davies_bouldin(spread: DataFrame, centers: np.ndarray, spark: SparkSession, metric="l2") -> DataFrame:
    """How far lists overlap: mean over lists of the worst ``(s_i + s_j) / d(c_i, c_j)``.

    Works on one row per list: each task compares its lists with all centres.
    """
    metric = metric_of(metric)
    ranker = METRICS["ip" if metric.train == "spherical" else "l2"]
    full = center_table(spark, centers).join(spread, "list_id").select(
        "list_id", F.coalesce("mean_distance", F.lit(0.0)).alias("s"))
    # one number per list travels, beside the centres
    spreads = np.zeros(len(centers))
    for row in full.toLocalIterator():
        spreads[row["list_id"]] = row["s"]
    live = np.zeros(len(centers), bool)
    live[[row["list_id"] for row in spread.select("list_id").toLocalIterator()]] = True

    def run(batches):
        ids = np.flatnonzero(live)
        block = DenseBlock(centers[ids])
        for batch in batches:
            lists = batch.column("list_id").to_numpy()
            step = max(1, RATIO_CELLS // max(1, len(ids)))
            for at in range(0, len(lists), step):
                mine = lists[at:at + step]
                near = np.repeat(np.arange(len(mine)), len(ids))
                far = np.tile(np.arange(len(ids)), len(mine))
                gap = train_distance(metric, block.exact(ranker, far, DenseBlock(centers[mine]), near)).reshape(len(mine), -1)
                other = (ids[None, :] != mine[:, None]) & (gap > 0)
                ratio = np.divide(spreads[mine][:, None] + spreads[ids][None, :], gap, out=np.zeros_like(gap), where=other)
                yield pa.RecordBatch.from_arrays([pa.array(ratio.max(axis=1, initial=0.0))], names=["worst"])

    return full.mapInArrow(run, "worst double").agg(F.avg("worst").alias("davies_bouldin"))
