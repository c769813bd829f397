"""Token counts of whole texts, with a table of strings known to be one token.

Offline, once per vocabulary, every vocabulary string is merged alone; those
that come out as one token are *whole*. A pre-token that equals a whole string
counts one without merging. Only the others are merged, and counts of frequent
pieces are kept per worker.

Defined cases: null and empty texts have no bytes and no tokens; strings of
added tokens inside a text count as the library counts them; extra columns stay
out of the way; repeated rows are counted each.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm.common import small_batches
from vecspark.llm.pieces import Pieces, added_tokens, in_alphabet, tokenizer


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (in the vocabulary's own alphabet) that merge to exactly themselves when alone."""
    found = tokenizer(path)
    merge = found.model.tokenize
    added = added_tokens(path)
    proven = []
    for token, number in found.get_vocab(with_added_tokens=False).items():
        if token not in added:
            alone = merge(token)
            if len(alone) == 1 and alone[0].id == number:
                proven.append(token)
    return frozenset(proven)


_COUNTERS: dict[str, Pieces] = {}


def _counter(path: str, whole: frozenset[str]) -> Pieces:
    """Counts of pieces, kept by the worker from task to task."""
    if path in _COUNTERS:
        return _COUNTERS[path]
    found, added = tokenizer(path), added_tokens(path)
    cut, merge = found.pre_tokenizer.pre_tokenize_str, found.model.tokenize

    def alone(pre: str) -> int:
        return 1 if pre in whole else len(merge(pre))

    def count(piece: str) -> int:
        if any(a in piece for a in added):
            return len(found.encode(piece, add_special_tokens=False).ids)
        return sum(alone(pre) for pre, _ in cut(piece))

    _COUNTERS[path] = Pieces(lambda piece: alone(in_alphabet(piece)), count, sum, added)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    # bounded by the vocabulary, not by the data
    proven = spark.sparkContext.broadcast(whole_tokens(path))

    def run(batches):
        of = _counter(path, proven.value).of
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [of(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
