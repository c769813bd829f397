"""BPE encoding and decoding that encodes shared content-defined chunks once.

A rolling hash over 32 bytes cuts texts where the content says so, so equal
passages give equal chunks wherever they lie. Chunks found in two documents or
more are encoded once for the whole table and joined back by hash; a Bloom
filter of them, bounded in size, tells the tasks which chunks to leave out
(a false hit only sends a chunk the longer way). What lies between shared chunks
is encoded where the text lies, and a document without shared chunks never
leaves its task. Texts are not shuffled but for one copy of each shared chunk.

Chunks end anywhere between two characters, so their ids need not be those of
the text around a join. Each join is repaired: the words before it that the next
chunk may change are cut and encoded anew together with that chunk's first
words, until a word ends where one of the chunk alone ends; from there on the
ids agree with those of the whole text.

Decoding goes from ids to the bytes of their vocabulary strings.

Defined cases: null and empty texts have no ids; a text with the string of an
added token is encoded whole, as the library takes it; repeated rows are encoded each;
an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vecspark.llm import bloom
from vecspark.llm.common import bounded_batches, stored
from vecspark.llm.pieces import ALPHABET, added_tokens, tokenizer
from vecspark.llm.word_ids import cutter, word_ids

WINDOW, LEAST_BYTES, MEAN_BITS = 32, 64, 9
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: kind: 0 a result, 1 ids of a stretch, 2 a reference to a shared chunk, 3 the bytes of a shared chunk.
PARTS = "kind int, row long, at int, doc_id long, fp1 long, fp2 long, data binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def cut_batch(texts: list[bytes], added: tuple[bytes, ...]) -> list[list[bytes]]:
    """The chunks of every text."""
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    h, width = _GEAR[joined], 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h, width = h + older, width * 2
    # a chunk starts at a character, behind a window whose hash has its top bits clear
    places = np.flatnonzero((h[:-1] >> np.uint32(32 - MEAN_BITS) == 0) & ((joined[1:] & 0xC0) != 0x80)) + 1
    out, start = [], 0
    ends = np.cumsum([len(t) for t in texts])
    for text, end in zip(texts, ends.tolist()):
        inside = places[np.searchsorted(places, start + LEAST_BYTES):np.searchsorted(places, end)] - start
        banned = [m.span() for a in added for m in re.finditer(re.escape(a), text)] if any(a in text for a in added) else []
        chunks, last = [], 0
        for place in inside.tolist():
            if place - last >= LEAST_BYTES and not any(a < place < b for a, b in banned):
                chunks.append(text[last:place])
                last = place
        chunks.append(text[last:])
        out.append(chunks if text else [])
        start = end
    return out


def _print_of(chunk: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id."""
    found = tokenizer(path)
    back = {chr(c): b for b, c in ALPHABET.items()}
    added = {t.content for t in found.get_added_tokens_decoder().values()}
    table = [b""] * found.get_vocab_size(with_added_tokens=True)
    for token, number in found.get_vocab(with_added_tokens=True).items():
        table[number] = token.encode() if token in added else bytes(back.get(c, ord(c) & 255) for c in token)
    return table


def decode(ids: bytes, path: str) -> bytes:
    """The text of packed ids, in UTF-8."""
    data = b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


class Joiner:
    """Packed ids of a text that grows chunk by chunk.

    ``ids`` are those of the part whose words no later chunk can change; the rest waits as text. A chunk's own
    words and those of the whole text agree from the first place where both break on, so what lies before it
    is encoded anew and the chunk's ids are taken from there. A chunk inside one long word only makes the
    waiting text longer, which is read once, when a break comes.
    """

    #: Last words that a later chunk may change: a quote and the letters of a contraction, and one for safety.
    OPEN = 3

    def __init__(self, path: str):
        self.known, self.table, self.ids, self.waiting, self.begun = word_ids(path), token_bytes(path), bytearray(), [], False

    def add(self, ids: bytes):
        if not ids:
            return
        strings = [self.table[i] for i in np.frombuffer(ids, "<u4").tolist()]
        text = b"".join(strings).decode()
        ends = [m.end() for m in cutter(text).finditer(text)]
        if len(ends) <= self.OPEN:
            self.waiting.append(text)
            self.begun = True
            return
        last = ends[-1 - self.OPEN]
        if self.begun:
            joined = "".join(self.waiting) + text
            before, own = len(joined) - len(text), {0, *ends}
            words, start = [], len(text)
            for m in cutter(joined).finditer(joined):
                words.append(m.group())
                if m.end() - before in own:
                    start = m.end() - before
                    break
            if start > last:
                self.waiting = [joined]
                return
            self.ids += self.known.packed_words(words)
        else:
            start = 0
        self.begun = True
        # words end where ids end, counted in bytes
        places = np.cumsum([len(x) for x in strings])
        a, b = (int(np.searchsorted(places, len(text[:at].encode()), side="right")) if at else 0 for at in (start, last))
        self.ids += ids[4 * a:4 * b]
        self.waiting = [text[last:]]

    def finish(self) -> bytes:
        """The ids of the whole text."""
        if self.waiting:
            self.ids += self.known.packed(["".join(self.waiting)])[0]
            self.waiting = []
        return bytes(self.ids)


def _result(ids: bytes, path: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()


def shared_chunks(docs: DataFrame, path: str) -> DataFrame:
    """(fp1, fp2) of the chunks that two rows or more hold."""
    added = tuple(a.encode() for a in added_tokens(path))

    def prints(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            if not texts:
                continue
            rows: dict = {}
            for chunks in cut_batch(texts, added):
                for fp in {_print_of(c) for c in chunks}:
                    rows[fp] = rows.get(fp, 0) + 1
            fps = np.array(list(rows), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(list(rows.values()), pa.int64())],
                                             names=["fp1", "fp2", "n"])

    return (docs.select("text").mapInArrow(prints, "fp1 long, fp2 long, n long").groupBy("fp1", "fp2")
            .agg(F.sum("n").alias("n")).where("n > 1").select("fp1", "fp2"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    spark = docs.sparkSession
    with bounded_batches(spark):
        return stored(_encoded(docs, path), "chunk-ids")[0]


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    added = tuple(a.encode() for a in added_tokens(path))
    shared, _ = stored(shared_chunks(docs, path), "shared-chunks")
    listed = spark.sparkContext.broadcast(bloom.build(shared, "fp1"))
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("fp1", pa.int64()),
                        ("fp2", pa.int64()), ("data", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def parts(batches):
        known, row, sent = word_ids(path), TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            if not texts:
                continue
            all_chunks = [[] if any(a in text for a in added) else chunks for text, chunks in zip(texts, cut_batch(texts, added))]
            fps = [_print_of(c) for chunks in all_chunks for c in chunks]
            hits = iter(listed.value.might_contain(np.array([f[0] for f in fps], dtype=np.int64)).tolist() if fps else [])
            # out: rows whose data, where it is a text, is still to be encoded
            fps, out = iter(fps), []
            for doc_id, text, chunks in zip(batch.column(0).to_pylist(), texts, all_chunks):
                row += 1
                flags = [(next(hits), next(fps)) for _ in chunks]
                if not any(hit for hit, _ in flags):
                    out.append((0, row, 0, doc_id, None, None, text.decode()))
                    continue
                at, stretch = 0, []
                for chunk, (hit, fp) in zip(chunks, flags):
                    if not hit:
                        stretch.append(chunk)
                        continue
                    if stretch:
                        out.append((1, row, at, doc_id, None, None, b"".join(stretch).decode()))
                        at, stretch = at + 1, []
                    out.append((2, row, at, doc_id, *fp, None))
                    at += 1
                    if fp not in sent:
                        # a bounded memory of what this task has sent
                        if len(sent) >= 100_000:
                            sent.clear()
                        sent.add(fp)
                        out.append((3, None, None, None, *fp, chunk))
                if stretch:
                    out.append((1, row, at, doc_id, None, None, b"".join(stretch).decode()))
            ids = iter(known.packed([r[6] for r in out if r[0] < 2]))
            rows = []
            for kind, *rest, data in out:
                if kind == 0:
                    rows.append((kind, *rest, None, *_result(next(ids), path)))
                else:
                    rows.append((kind, *rest, next(ids) if kind == 1 else data, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    made, _ = stored(docs.select("doc_id", "text").mapInArrow(parts, PARTS), "chunk-parts", compression="zstd")

    def encode(batches):
        known = word_ids(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                known.packed([c.decode() for c in batch.column(2).to_pylist()]), pa.binary())], names=["fp1", "fp2", "data"])

    once = made.where("kind = 3").groupBy("fp1", "fp2").agg(F.first("data").alias("data")).mapInArrow(encode, "fp1 long, fp2 long, data binary")
    refs = made.where("kind = 2").select("row", "at", "doc_id", "fp1", "fp2").join(once, ["fp1", "fp2"])
    pieces = made.where("kind = 1").select("row", "at", "doc_id", "data").unionByName(refs.select("row", "at", "doc_id", "data"))

    def assemble(batches):
        now, doc, joiner = None, None, None
        for batch in batches:
            out = []
            for row, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if row != now:
                    if joiner:
                        out.append((doc, *_result(joiner.finish(), path)))
                    now, doc, joiner = row, doc_id, Joiner(path)
                joiner.add(ids)
            if out:
                yield _results(out)
        if joiner:
            yield _results([(doc, *_result(joiner.finish(), path))])

    def _results(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    joined = pieces.select("row", "at", "doc_id", "data").repartition("row").sortWithinPartitions("row", "at").mapInArrow(assemble, RESULT)
    return made.where("kind = 0").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(joined)
