"""Blocked Bloom filters over 64-bit hashes, built by tasks and bounded in size.

A key sets four bits of one 512-bit block. The number of bits follows the
number of keys up to ``max_bits``; beyond it there are more false hits, which
an exact step after the filter removes, and never a missed key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_BITS = 1 << 27
_SPREAD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint64)


def _bits(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Bit positions of every key: an array of shape (keys, 4)."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    low = ((h & np.uint64(0xFFFFFFFF))[:, None] * _SPREAD) & np.uint64(0xFFFFFFFF)
    return block[:, None] * np.uint64(512) + (low >> np.uint64(23))


class BlockedBloom:
    def __init__(self, words: np.ndarray):
        self.words, self.blocks = words, len(words) // 8

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        bits = _bits(np.ascontiguousarray(hashes, dtype=np.int64), self.blocks)
        found = self.words[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))
        return (found & np.uint64(1)).all(axis=1)


def build(keys: DataFrame, column: str, bits_per_key: int = 12, max_bits: int = MAX_BITS) -> BlockedBloom:
    """The filter of the non-null 64-bit hashes in ``column``; tasks set bits, the driver gets at most max_bits."""
    keys = keys.select(column).where(F.col(column).isNotNull())
    bits = 512
    wanted = keys.count() * bits_per_key
    while bits < min(wanted, max_bits):
        bits *= 2
    blocks = bits // 512

    def words(batches):
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False), blocks).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))],
                names=["word", "bits"])

    rows = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(bits // 64, dtype=np.uint64)
    filled[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return BlockedBloom(filled)
