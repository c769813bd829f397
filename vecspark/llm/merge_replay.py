"""Byte-level BPE by replaying all merges over the corpus's distinct words.

Documents are cut into the pattern's matches (*words*). A task gathers a block
of documents, numbers its distinct words, most frequent first, and writes the
documents as packed word numbers beside the block's word list, dealt into
buckets by the words' hash. A bucket holds every block's copy of its words, so
each distinct word of the corpus is encoded once.

A bucket's words lie end to end in one symbol array with links to both
neighbours. An inverted index takes each pair's rank to the positions where it
stands; ranks come off a heap in order, a rank's merges are applied at all its
positions, and only the two neighbours of a merged place enter the index anew.
A merge may bring up a pair of a lower rank (its bytes may be cut in two ways);
the rest of that word then waits until that rank has been applied, so every word
sees its merges in the order that encoding it alone would take.

The packed ids go back to their blocks and meet the documents' word numbers,
which lie bucketed by block and so are never shuffled; neither are texts.
Decoding joins the bytes of the ids.

Defined cases: null and empty texts have no ids; a null doc_id is kept; repeated
rows are encoded each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecspark.llm.common import bounded_batches, shuffle_partitions, stored
from vecspark.session import scratch_path

#: Characters of text a block holds at most, but for its last document; word numbers of a packed row of documents.
BLOCK_CHARS, PACK_WORDS = 24 << 20, 1 << 19
#: Bytes of distinct words whose merges are replayed together.
REPLAY_BYTES = 1 << 19
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: kind 0: words of a block (``codes`` their numbers, ``sizes`` their bytes); 1: documents (``sizes`` words each).
_PARTS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                    ("sizes", pa.binary()), ("codes", pa.binary()), ("data", pa.binary())])
_SQL_PARTS = "kind int, block long, bucket int, doc_ids array<long>, sizes binary, codes binary, data binary"


def pack(values) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class Ranks:
    """A vocabulary of byte strings by rank, as the tiktoken file lists it."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.first_pairs = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.pairs = _Pairs(self)


class _Pairs(dict):
    """The rank of two neighbouring symbols together, -1 where the vocabulary has none."""

    def __init__(self, of: Ranks, keep: int = 1_000_000):
        super().__init__()
        self.of, self.keep = of, keep

    def __missing__(self, key: int) -> int:
        if len(self) >= self.keep:
            self.clear()
        a, b = self.of.bytes[key >> 32], self.of.bytes[key & 0xFFFFFFFF]
        self[key] = rank = self.of.ranks.get(a + b, -1)
        return rank


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words end to end, ids per word): every merge applied to all words, in rank order."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    owners = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
    after[ends] = -1
    before[np.concatenate([[0], ends[:-1] + 1])] = -1
    starting = np.full(len(raw), -1)
    starting[:-1] = ranks.first_pairs[raw[:-1], raw[1:]]
    starting[ends] = -1
    places = np.flatnonzero(starting >= 0)
    places = places[np.argsort(starting[places], kind="stable")]
    found, cuts = np.unique(starting[places], return_index=True)
    index = {int(r): p.tolist() for r, p in zip(found, np.split(places, cuts[1:]))}
    symbols, owner, after, before = ranks.single[raw].tolist(), owners.tolist(), after.tolist(), before.tolist()
    heap, pairs = list(index), ranks.pairs

    def enter(rank, place):
        if rank in index:
            index[rank].append(place)
        else:
            index[rank] = [place]
            heapq.heappush(heap, rank)

    heapq.heapify(heap)
    while heap:
        rank, waiting = heapq.heappop(heap), -1
        for place in sorted(index.pop(rank)):
            right = after[place]
            if right < 0 or pairs[symbols[place] << 32 | symbols[right]] != rank:
                continue  # a merge has taken one of the two since
            if owner[place] == waiting:
                enter(rank, place)
                continue
            symbols[place], symbols[right] = rank, -1
            far, near = after[right], before[place]
            after[place], after[right] = far, -1
            lowest = rank
            if far >= 0:
                before[far] = place
                new = pairs[rank << 32 | symbols[far]]
                if new >= 0:
                    enter(new, place)
                    lowest = min(lowest, new)
            if near >= 0:
                new = pairs[symbols[near] << 32 | rank]
                if new >= 0:
                    enter(new, near)
                    lowest = min(lowest, new)
            if lowest < rank:
                waiting = owner[place]
    symbols = np.array(symbols)
    left = symbols >= 0
    return symbols[left], np.bincount(owners[left], minlength=len(words))


def encode_words(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids per word) of distinct words; one that the vocabulary lists is its own token, as in the library."""
    ids, counts, part, size = [], [], [], 0

    def flush():
        listed = np.array([ranks.ranks.get(w, -1) for w in part], dtype=np.int64)
        own, n = replay([b"" if r >= 0 else w for w, r in zip(part, listed)], ranks)
        at = np.cumsum(n) - n
        ids.append(np.insert(own, at[listed >= 0], listed[listed >= 0]))
        counts.append(np.where(listed >= 0, 1, n))

    for word in words:
        part.append(word)
        size += len(word)
        if size >= REPLAY_BYTES:
            flush()
            part, size = [], 0
    if part:
        flush()
    return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int64),) * 2


def _row(kind, block, bucket=None, doc_ids=None, sizes=None, codes=None, data=None):
    return kind, block, bucket, doc_ids, sizes, codes, data


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Block:
    """Documents by word numbers, and the words, until they are written."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.words, self.codes, self.ids, self.chars = _Numbers(), [], [], 0

    def add(self, doc_id, text: str, cut):
        found = cut(text)
        self.codes.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
        self.ids.append(doc_id)
        self.chars += len(text)

    def rows(self):
        sizes = np.fromiter(map(len, self.codes), np.int64, len(self.codes))
        codes = np.concatenate(self.codes)
        often = np.argsort(-np.bincount(codes, minlength=len(self.words)), kind="stable")
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often))
        words = [w.encode() for w in self.words]
        words = [words[i] for i in often.tolist()]
        self.words.clear()
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.buckets
        order = np.argsort(bucket, kind="stable")
        used, cuts = np.unique(bucket[order], return_index=True)
        for b, mine in zip(used.tolist(), np.split(order, cuts[1:])):
            mine_words = [words[i] for i in mine.tolist()]
            yield _row(0, self.number, b, sizes=pack(list(map(len, mine_words))), codes=pack(np.diff(mine, prepend=0)),
                       data=zstandard.ZstdCompressor(level=6).compress(b"".join(mine_words)))
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            low = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, low + PACK_WORDS, side="right")))
            yield _row(1, self.number, doc_ids=self.ids[start:stop], sizes=pack(sizes[start:stop]),
                       data=pack(place[codes[low:ends[stop - 1]]]))
            start = stop


def word_blocks(docs: DataFrame, pattern: str, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents as word numbers, and their words by bucket."""
    def cut_blocks(batches):
        cut, block = regex.compile(pattern).findall, _Block(TaskContext.get().partitionId() << 32, buckets)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc_id, text or "", cut)
                if block.chars >= block_chars:
                    yield from (_batch([row]) for row in block.rows())
                    block = _Block(block.number + 1, buckets)
        if block.ids:
            yield from (_batch([row]) for row in block.rows())

    return docs.select("doc_id", "text").mapInArrow(cut_blocks, _SQL_PARTS)


def encode_buckets(parts: DataFrame, path: str) -> DataFrame:
    """The words' rows with ids in place of bytes: ``sizes`` ids each, ``data`` the ids; each bucket's words are encoded once."""
    def encode(batches):
        ranks = ranks_of(path)
        for rows in _groups(batches, "bucket"):
            numbers, asked = _Numbers(), []
            for row in rows:
                data, at = zstandard.ZstdDecompressor().decompress(row["data"]), 0
                ends = np.cumsum(unpack(row["sizes"])).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends)]
                asked.append((row["block"], row["codes"], np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))))
            ids, counts = encode_words(list(numbers), ranks)
            starts = np.cumsum(counts) - counts
            for block, codes, which in asked:
                n = counts[which]
                at = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield _batch([_row(0, block, sizes=pack(n), codes=codes, data=pack(ids[at]))])

    return (parts.where("kind = 0").repartition(shuffle_partitions(parts.sparkSession), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(encode, _SQL_PARTS))


def _groups(batches, key: str):
    """Rows of each run of equal keys, as an iterator each; a run is read to its end before the next."""
    rows = (row for batch in batches for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist())
    row = next(rows, None)

    def run(first):
        nonlocal row
        row = first
        while row is not None and row[key] == first[key]:
            yield row
            row = next(rows, None)

    while row is not None:
        yield run(row)


def _joined(docs: DataFrame, path: str, pattern: str, block_chars: int, give, schema: str) -> DataFrame:
    """``give(words, documents)`` of each block: the rows of its encoded words, and those of its documents."""
    spark: SparkSession = docs.sparkSession
    n, name = shuffle_partitions(spark), f"word_blocks_{uuid.uuid4().hex}"
    with bounded_batches(spark):
        (word_blocks(docs, pattern, n, block_chars).write.option("compression", "uncompressed").option("path", scratch_path(spark, name))
         .bucketBy(n, "block").saveAsTable(name))
        parts = spark.read.table(name)
        words = encode_buckets(parts, path).groupBy("block")
        # a block is bounded, and so are both sides of it
        joined = parts.where("kind = 1").groupBy("block").cogroup(words).applyInArrow(
            lambda documents, words: give(words.to_pylist(), documents.to_pylist()), schema)
        found, _ = stored(joined, "merge-replay")
    # only the name goes; the files lie in the shared folder
    spark.sql(f"DROP TABLE {name}")
    return found


def token_ids(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) of every row."""
    def ids_of(words, documents):
        known, doc_ids, lists = {}, [], []
        for row in words:
            known |= zip(np.cumsum(unpack(row["codes"])).tolist(), np.split(unpack(row["data"]).astype(np.int32), np.cumsum(unpack(row["sizes"]))[:-1]))
        for row in documents:
            codes, ends = unpack(row["data"]).tolist(), np.cumsum(unpack(row["sizes"])).tolist()
            doc_ids += row["doc_ids"]
            lists += [np.concatenate([known[c] for c in codes[a:b]]) if b > a else np.zeros(0, np.int32) for a, b in zip([0, *ends], ends)]
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _joined(docs, path, pattern, block_chars, ids_of, "doc_id long, ids array<int>")


def encode_documents(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    def digests(words, documents):
        table, size = ranks_of(path).bytes, 1 + max((int(np.cumsum(unpack(row["codes"]))[-1]) for row in words), default=-1)
        texts, numbers, counts = [b""] * size, [b""] * size, np.zeros(size, np.int64)
        for row in words:
            ids, n, codes = unpack(row["data"]).tolist(), unpack(row["sizes"]), np.cumsum(unpack(row["codes"]))
            counts[codes] = n
            ends = np.cumsum(n).tolist()
            for code, a, b in zip(codes.tolist(), [0, *ends], ends):
                mine = ids[a:b]
                texts[code] = b"".join([table[i] for i in mine])
                numbers[code] = " ".join(map(str, mine)).encode()
        out = []
        for row in documents:
            codes = unpack(row["data"])
            spent, codes, ends = np.concatenate([[0], np.cumsum(counts[codes])]), codes.tolist(), np.cumsum(unpack(row["sizes"])).tolist()
            for doc_id, a, b in zip(row["doc_ids"], [0, *ends], ends):
                mine = codes[a:b]
                out.append((doc_id, int(spent[b] - spent[a]), hashlib.sha256(b" ".join(map(numbers.__getitem__, mine))).hexdigest(),
                            hashlib.sha256(b"".join(map(texts.__getitem__, mine))).hexdigest()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _joined(docs, path, pattern, block_chars, digests, RESULT)
