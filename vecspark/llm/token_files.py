"""Token ids as Parquet list columns, readable by column, row group and page.

Documents are range-partitioned and sorted by doc_id as text, encoded behind
that shuffle (ids would be larger than the text), and written as one shard per
range: id lists dictionary-encoded, the metadata columns delta-encoded, row
groups and pages of set sizes, with Parquet's page indexes. Reading metadata
touches no id page; reading some documents touches the pages that hold them.

Every row holds its place in its shard; the shards' places follow from one
number per shard, so no document passes a single task.

Defined cases: null and empty texts are the end id alone; a null doc_id comes
first; rows of one doc_id lie side by side in the order of their text's hash;
an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vecspark.llm.common import bounded_batches
from vecspark.llm.word_ids import word_ids

SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 64 << 20, 256 << 10, 1000


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int) -> None:
    """Writes one shard per range of doc_id to the folder ``out``."""
    def encode(batches):
        known, shard, start = word_ids(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            if not len(batch):
                continue
            ids, counts = known.encode([t or "" for t in batch.column(1).to_pylist()])
            ids = np.insert(ids, np.cumsum(counts), end_id).view(np.int32)
            sizes = counts + 1
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), shard, np.int32)), batch.column(0), pa.array(start + ends - sizes),
                 pa.array(sizes), lists], names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])
            start += int(ends[-1])

    with bounded_batches(docs.sparkSession):
        (docs.select("doc_id", "text").repartitionByRange("doc_id")
         .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
         .mapInArrow(encode, SCHEMA)
         .write.options(**{
             "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP_BYTES,
             "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
             "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
             "parquet.enable.dictionary#shard_start": "false", "parquet.enable.dictionary#n_tokens": "false"})
         .parquet(out))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


def read_starts(spark: SparkSession, out: str) -> DataFrame:
    """(shard, shard_offset): how many ids lie before each shard; reads two metadata columns."""
    totals = read_tokens(spark, out).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_offset"))


def digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def crc(batches):
        for batch in batches:
            lists = batch.column(3)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)),
                 pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())],
                names=["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, out).select("shard", "doc_id", "shard_start", "ids").mapInArrow(
        crc, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    return rows.join(read_starts(spark, out), "shard").select(
        "doc_id", (F.col("shard_offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
