"""Exact Jaccard self-join of documents' word shingles, by universe partition and pigeonhole.

Sets are put in size bands such that linked sets lie in the same band or in
neighbouring ones. In a band's space, the universe of shingles is hashed into m
segments. Two linked sets differ in at most H shingles; so if segments have
weights v + 1 that add up to H + 1 or more, in some segment they differ by at
most v. A segment of v = 0 is indexed by its subset; one of v = 1 by its subset
and the subset's one-deletion neighbourhood. ``allocate`` takes, per band, the
cheapest numbers of segments and of one-deletion segments, with slack for empty
subsets: a set whose empty segments weigh no more than the slack leaves them
out, which only depends on the subset, so both sides of a pair leave out the
same.

Each task combines equal signatures of its batch to a representative before the
shuffle, so a signature of very many copies leaves a task once. Each member of a
signature is compared, on the words themselves, with the signature's first
document, its root: one pair per member, unless their sketches rule a link out.
A sketch has one bit per hash of a shingle, set where an odd number of shingles
fall on it; two sketches differ in no more bits than the sets do in shingles,
so no link is ruled out, and few texts travel that don't link.
Linked documents get a common label. Members that don't link with the root may
still link with each other. Of a root whose members have different labels, up to
``SMALL`` members are compared with each other. Of more, the shingles by which
two that link differ from the root share one of the rarest few
(``shared_differences``), which very few members share; only shared differences
whose members have different labels are compared further, with eight times as
many pivots each round, until all such pairs have been compared. No link between
components is lost, and large groups of near copies, or near misses, cost a
pass, not a square. Rarity is an order by counts in a table of bounded size,
so shingles are counted and picked where they lie. Texts travel beside pairs in
rounds of about as many pairs as there are texts. Tables are dropped after
their last reader.

Defined cases: documents without words have no shingles and link with nothing;
fewer words than a shingle are one shingle; a null doc_id links with nothing
and has a null component; rows that repeat a doc_id are one document; an empty
table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vecspark.llm import bloom
from vecspark.llm.common import CLEAN_UP, ascii_lower, bounded_batches, forget, settings, shuffle_partitions, stored, words

SPACES = b" \t\n\x0b\x0c\r"
MOST_DELETION_SEGMENTS = 6
#: Members of one root that are compared each with each.
SMALL = 24
#: Most counters that put shingles in order of rarity.
MOST_COUNTERS = 1 << 22


@lru_cache(maxsize=None)
def bounds(top: int, num: int, den: int) -> np.ndarray:
    """The least sizes of all bands up to that of size ``top`` and two more; a set's partners are at most one band away."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * den // num + 1)
    for _ in range(2):
        out.append(out[-1] * den // num + 1)
    return np.array(out)


@lru_cache(maxsize=None)
def allocate(least: int, most: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, one-deletion segments, slack) for sets of ``least`` to ``most`` shingles that link at num / den."""
    differ = (den - num) * 2 * most // (den + num)
    # without slack, sets with empty segments index those too
    best = math.inf, differ + 1, 0, 0
    for deletions in range(MOST_DELETION_SEGMENTS + 1):
        for segments in range(max(1, differ + 1 - deletions, deletions), differ + 2 + differ // 2 + 8):
            empty = (1 - 1 / segments) ** least
            single = least / segments * (1 - 1 / segments) ** (least - 1)
            idle = (segments - deletions) * empty + deletions * (2 * empty + single)
            slack = math.ceil(idle + 3 * math.sqrt(idle)) if idle > 1e-4 and differ else 0
            if segments + deletions >= differ + 1 + slack:
                cost = segments + deletions * most / segments
                if cost < best[0]:
                    best = cost, segments, deletions, slack
                break
    return best[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of hashes make keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _space(h, doc, sizes, space, limits, num, den):
    """(keys, documents) of all sets in the space of a band for each; ``h`` are the shingles, ``doc`` their sets."""
    configs = {int(s): allocate(int(limits[max(s - 1, 0)]), int(limits[s + 1] - 1), num, den) for s in np.unique(space)}
    m, t, slack = (np.array([configs[int(s)][i] for s in space], dtype=np.int64) for i in range(3))
    first = np.concatenate([[0], np.cumsum(m)])
    place = (h % m[doc].astype(np.uint64)).astype(np.int64)
    cell = first[doc] + place
    total = np.zeros(first[-1], dtype=np.uint64)
    np.add.at(total, cell, h)
    count = np.bincount(cell, minlength=first[-1])
    owner = np.repeat(np.arange(len(m)), m)
    index = np.arange(first[-1]) - first[owner]
    deletion = index < t[owner]
    idle = np.where(count == 0, 1 + deletion, np.where((count == 1) & deletion, 1, 0))
    all_kept = np.bincount(owner, weights=idle, minlength=len(m)) > slack
    seed = _mix((space[owner].astype(np.uint64) << np.uint64(32)) + index.astype(np.uint64))
    keep = (count > 0) | all_kept[owner]
    gone = deletion[cell] & ((count[cell] > 1) | all_kept[doc])
    return (np.concatenate([_mix(total[keep] ^ seed[keep]), _mix((total[cell[gone]] - h[gone]) ^ seed[cell[gone]])]),
            np.concatenate([owner[keep], doc[gone]]))


def signatures(ids: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, num: int, den: int):
    """(keys, ids, members) of a batch: a key's first document with member -1, and further ones beside that document."""
    sizes = np.diff(offsets)
    h, doc = hashes.astype(np.int64).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    whole = np.zeros((2, len(sizes)), dtype=np.uint64)
    np.add.at(whole[0], doc, h)
    np.add.at(whole[1], doc, _mix(h))
    firsts: dict = {}
    first = np.array([firsts.setdefault(key, i) for i, key in enumerate(zip(*whole.tolist(), sizes.tolist()))], dtype=np.int64)
    new = (first == np.arange(len(sizes))) & (sizes > 0)
    copies = np.flatnonzero((first != np.arange(len(sizes))) & (sizes > 0))
    number = np.cumsum(new) - 1
    mine = new[doc]
    h, doc, picked = h[mine], number[doc[mine]], np.flatnonzero(new)
    keys, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(picked):
        limits = bounds(int(sizes.max()), num, den)
        band = np.searchsorted(limits, sizes[picked], side="right") - 1
        for up in (0, 1):
            k, o = _space(h, doc, sizes[picked], band + up, limits, num, den)
            keys, owners = np.concatenate([keys, k]), np.concatenate([owners, o])
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], ids[picked[owners[order]]]
    start = np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]
    lead = docs[np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))] if len(keys) else docs
    return (np.concatenate([keys, whole[0][copies]]).view(np.int64), np.concatenate([lead, ids[first[copies]]]),
            np.concatenate([docs, ids[copies]]), np.concatenate([start, np.zeros(len(copies), bool)]))


_EDGE = "key long, a long, b long"


def _edges(keys, a, b):
    return pa.RecordBatch.from_arrays([keys, a, b], names=["key", "a", "b"])


def shingle_hashes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, hashes): the distinct shingles of every row."""
    texts = docs.select("doc_id", words(ascii_lower("text")).alias("w"))
    hashed = texts.select("doc_id", "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    runs = F.transform(F.sequence(F.lit(0), F.col("n") - k), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(k))))
    return hashed.select("doc_id", F.when(F.col("n") >= k, F.array_distinct(runs)).when(
        F.col("n") > 0, F.array(F.xxhash64(F.lit("short"), F.array_join("w", " ")))).otherwise(F.array().cast("array<bigint>")).alias("hashes"))


def candidates(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows (key, a, b) of signatures that several documents share, and (null, doc_id, n_shingles) of every row."""
    spark = docs.sparkSession

    def sign(batches):
        for batch in batches:
            lists, null = batch.column(1), np.asarray(batch.column(0).is_null())
            offsets = lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            yield _edges(pa.nulls(len(batch), pa.int64()), batch.column(0), pa.array(sizes.astype(np.int64)))
            ids = batch.column(0).fill_null(0).to_numpy()[~null]
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
            values = values[np.repeat(~null, sizes)]
            keys, lead, docs_, start = signatures(ids, np.concatenate([[0], np.cumsum(sizes[~null])]), values, num, den)
            yield _edges(pa.array(keys), pa.array(lead), pa.array(docs_, mask=start))

    def runs(batches):
        last, pivot = None, 0
        for batch in batches:
            alone = np.asarray(batch.column(2).is_null())
            passed = batch.filter(pa.array(~alone))
            if len(passed):
                yield passed
            key = batch.column(0).fill_null(0).to_numpy()[alone]
            a = batch.column(1).fill_null(0).to_numpy()[alone]
            if not len(key):
                continue
            start = np.concatenate([[key[0] != last], key[1:] != key[:-1]]) if last is not None else np.concatenate([[True], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
            lead = np.where(at < 0, pivot, a[at])
            last, pivot = key[-1], lead[-1]
            pairs = ~start & (lead != a)
            if pairs.any():
                yield _edges(pa.array(key[pairs]), pa.array(lead[pairs]), pa.array(a[pairs]))

    place = F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("key", "a", "b"))
    return (shingle_hashes(docs, k).mapInArrow(sign, _EDGE).repartition(shuffle_partitions(spark), place)
            .sortWithinPartitions("key", "a").mapInArrow(runs, _EDGE))


@lru_cache(maxsize=64)
def _shingles(text: str, k: int) -> frozenset:
    """The exact shingle set of a text, A-Z lower-cased."""
    w = text.encode().lower().translate(_TO_SPACE).split(b" ") if text else []
    w = [x for x in w if x]
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


_TO_SPACE = bytes(32 if i in SPACES else i for i in range(256))


def _joined(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, "ta", "tb")


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets meet num / den, counted on the words."""
    def check(batches):
        for batch in batches:
            a, b, ta, tb = batch.columns
            good = []
            for x, y in zip(ta.to_pylist(), tb.to_pylist()):
                x, y = _shingles(x or "", k), _shingles(y or "", k)
                both = len(x & y)
                good.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _joined(pairs, texts).mapInArrow(check, "a long, b long").distinct()


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """(id, size, bits) of every row: the number of its shingles, and two bits or more per shingle, flipped by each one's hash."""
    def flip(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            sizes = np.diff(offsets).astype(np.int64)
            h = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].view(np.uint64)
            width = np.int64(1) << np.ceil(np.log2(np.maximum(sizes * 2, 64) / 64)).astype(np.int64)
            first, doc = np.concatenate([[0], np.cumsum(width)]), np.repeat(np.arange(len(sizes)), sizes)
            at = (h & (width[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
            bits = np.zeros(first[-1], dtype=np.uint64)
            np.bitwise_xor.at(bits, first[doc] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(bits)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), packed], names=["id", "size", "bits"])

    return shingle_hashes(texts, k).mapInArrow(flip, "id long, size long, bits binary")


def least_differences(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many shingles the sets behind two sketches differ by at least; the larger sketch is folded to the smaller one's width."""
    def parts(x):
        x = x.cast(pa.large_binary())
        offsets = np.frombuffer(x.buffers()[1], dtype=np.int64)[x.offset:x.offset + len(x) + 1]
        return np.frombuffer(x.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view(np.uint64), (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8

    (u, at_u, width_u), (v, at_v, width_v) = parts(a), parts(b)
    out = np.zeros(len(a), dtype=np.int64)
    for x, y in np.unique(np.stack([width_u, width_v], axis=1), axis=0):
        rows, width = np.flatnonzero((width_u == x) & (width_v == y)), min(x, y)
        left, right = (np.bitwise_xor.reduce(words_[at[rows][:, None] + np.arange(w)].reshape(len(rows), w // width, width), axis=1)
                       for words_, at, w in ((u, at_u, x), (v, at_v, y)))
        out[rows] = np.bitwise_count(left ^ right).sum(axis=1)
    return out


def possible(pairs: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link: all but those whose sketches differ too much for it."""
    def check(batches):
        for batch in batches:
            if len(batch):
                a, b, size_a, size_b, bits_a, bits_b = batch.columns
                may = (den + num) * least_differences(bits_a, bits_b) <= (den - num) * (size_a.to_numpy() + size_b.to_numpy())
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(may))

    side = lambda x: sketched.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b")
            .mapInArrow(check, "a long, b long").distinct())


def among(table: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``table`` whose id is in ``ids`` and few others, found by a Bloom filter."""
    listed = table.sparkSession.sparkContext.broadcast(bloom.build(ids.select(F.xxhash64(ids.columns[0]).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def might(h: pd.Series) -> pd.Series:
        return pd.Series(listed.value.might_contain(h.to_numpy(dtype=np.int64)))

    return table.withColumn("h", F.xxhash64(column)).where(might("h")).drop("h")


def in_rounds(pairs: DataFrame, texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The pairs in parts by their ``a``, each about as many as there are texts, with the texts that the part needs."""
    parts = max(1, -(-pairs.count() // max(1, texts.count())))
    some = [pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [pairs]
    return [(part, among(texts, part.select(F.explode(F.array("a", "b"))))) for part in some]


def linked(pairs: DataFrame, sketched: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """The pairs that link, and the tables they lie in; texts of pairs that their sketches rule out stay where they are."""
    close, at = stored(possible(pairs, sketched, num, den), "close")
    found = [stored(verify(part, near, k, num, den), "links") for part, near in in_rounds(close, texts)]
    forget(pairs.sparkSession, at)
    return reduce(DataFrame.unionByName, [links for links, _ in found]), [path for _, path in found]


def differences(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, label, most, tokens): pairs of a root a and a member b with the member's label, and the shingles in which they differ.

    ``most`` bounds how many shingles b and any set that links with it differ by.
    """
    def check(batches):
        for batch in batches:
            a, b, label, ta, tb = batch.columns
            most, tokens = [], []
            for x, y in zip(ta.to_pylist(), tb.to_pylist()):
                x, y = _shingles(x or "", k), _shingles(y or "", k)
                most.append((den - num) * (len(y) + len(y) * den // num) // (den + num))
                tokens.append([_hash(t) for t in x ^ y])
            yield pa.RecordBatch.from_arrays(
                [a, b, label, pa.array(most, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["a", "b", "label", "most", "tokens"])

    return _joined(pairs, texts).mapInArrow(check, "a long, b long, label long, most long, tokens array<long>")


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, rows, keys) of the tokens of a batch (a, ..., tokens): how many a row has, whose each is, and its key among the members of that root."""
    lists = batch.column(batch.schema.get_field_index("tokens"))
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    tokens = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].view(np.uint64)
    return sizes, row, _mix(tokens ^ _mix(batch.column(0).to_numpy().view(np.uint64))[row])


def rarity(apart: DataFrame) -> np.ndarray:
    """Counters of the differing shingles by the low bits of their keys: never less than the members that share a shingle."""
    cells, counters = apart.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0], 1 << 10
    while counters < min(2 * cells, MOST_COUNTERS):
        counters *= 2

    def count(batches):
        seen = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            keys = _keys(batch)[2]
            seen += np.bincount((keys & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        used = np.flatnonzero(seen)
        for i in range(0, len(used), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(used[i:i + (1 << 16)]), pa.array(seen[used[i:i + (1 << 16)]])], names=["slot", "n"])

    with settings(apart.sparkSession, {CLEAN_UP: "true"}):
        rows = apart.select("a", "tokens").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).select(
            F.col("slot").cast("int"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(counters, dtype=np.int32)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def shared_differences(apart: DataFrame) -> DataFrame:
    """(key, id, label, size, most, first): members of a root by the differing shingles that others of its members share.

    Members differ from each other by the difference of their differences from the root. Two that link either both
    link with the root, or share a shingle that lies, rarest first, in the first H / 2 + 1 of the smaller difference
    (``first``) and in the first H + 1 of the larger. Any order that all members of a root follow will do, so counters
    that shingles share cost comparisons, never a link.
    """
    counts = apart.sparkSession.sparkContext.broadcast(rarity(apart))

    def pick(batches):
        for batch in batches:
            sizes, row, keys = _keys(batch)
            often = counts.value[(keys & np.uint64(len(counts.value) - 1)).astype(np.int64)]
            order = np.lexsort((keys, often, row))
            row, keys, often = row[order], keys[order], often[order]
            most = batch.column(3).to_numpy()
            # shingles of one member only come first and match nothing
            place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + 1
            kept = (place <= most[row] + 1) & (often > 1)
            row, keys, place = row[kept], keys[kept], place[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(sizes[row]),
                 pa.array(most[row]), pa.array(place <= most[row] // 2 + 1)], names=["key", "id", "label", "size", "most", "first"])

    return apart.select("a", "b", "label", "most", "tokens").mapInArrow(pick, "key long, id long, label long, size long, most long, first boolean")


def still_open(members: DataFrame) -> DataFrame:
    """The rows, with ``n``, of the keys whose members have different labels, ``n`` of them in front; labels only merge, so others never open again."""
    keys = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count_if("first").alias("n"))
    return members.join(keys.where("x < y AND n > 0").select("key", "n"), "key")


def _hash(shingle: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(shingle), digest_size=8).digest(), "little", signed=True)


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label) of every node: the least id that links reach."""
    spark = nodes.sparkSession
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, at = stored(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        step, mid = stored(step, "labels")
        far = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new, path = stored(step.join(far, "label").select("id", F.col("far").alias("label"), "was"), "labels")
        changed = not new.where("label <> was").isEmpty()
        forget(spark, mid, at)
        labels, at = new.select("id", "label"), path
        if not changed:
            return labels


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) after joining the components that links connect; only their labels are walked."""
    a, b = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    between, _ = stored(links.join(a, "a").join(b, "b").where("x <> y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "between")
    if between.isEmpty():
        return labels
    ends = between.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    moved = components(between, ends).select(F.col("label").alias("to"), F.col("id").alias("label"))
    return stored(labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")[0]


def link_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links are sets whose Jaccard similarity is num / den or more."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with bounded_batches(spark):
        return _components(docs, k, num, den)


def _components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    edges, edges_at = stored(candidates(docs, k, num, den), "edges")
    sizes = edges.where("key IS NULL").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    edges = edges.where("key IS NOT NULL AND a <> b")
    nodes, nodes_at = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    # only texts of candidates are kept and shuffled
    wanted = among(docs.where("doc_id IS NOT NULL"), nodes)
    texts, texts_at = stored(wanted.join(nodes, F.col("doc_id") == F.col("id"), "left_semi"), "texts", compression="zstd")
    sketched, sketched_at = stored(sketches(texts, k), "sketches")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # a signature's members against its root: one pair each
    members = edges.select("key", F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = edges.groupBy("key").agg(F.min(F.least("a", "b")).alias("root"))
    n = sizes.join(nodes, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(
        F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    pairs = members.join(roots, "key").where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()
    fits = lambda x, y: den * F.least(f"high{x}", f"high{y}") >= num * F.greatest(f"low{x}", f"low{y}")
    sized = lambda x: n.select(F.col("doc_id").alias(x), F.col("low").alias(f"low{x}"), F.col("high").alias(f"high{x}"))
    tested, tested_at = stored(pairs.join(sized("a"), "a").join(sized("b"), "b"), "tested")
    links, at = linked(tested.where(fits("a", "b")).select("a", "b"), sketched, texts, k, num, den)
    labels = merge_labels(nodes.select("id", F.col("id").alias("label")), links)
    forget(spark, *at)
    # roots with members of different components, which may still link with each other
    open_, open_at = stored(tested.join(labels, F.col("b") == F.col("id")).select("a", "b", F.col("lowb").alias("low"), F.col("highb").alias("high"), "label"), "open")
    groups = open_.groupBy("a").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("a", "n")
    left, right = (open_.join(groups.where(F.col("n") <= SMALL), "a").select("a", *(F.col(c).alias(f"{c}{i}") for c in ("b", "low", "high", "label"))) for i in "12")
    each = left.join(right, "a").where((F.col("b1") < F.col("b2")) & (F.col("label1") != F.col("label2")) & fits(1, 2)).select(F.col("b1").alias("a"), F.col("b2").alias("b")).distinct()
    links, at = linked(each, sketched, texts, k, num, den)
    labels = merge_labels(labels, links)
    forget(spark, *at)
    # labels are joined per member, before its shingles
    large, large_at = stored(open_.join(groups.where(F.col("n") > SMALL).select("a"), "a").select("a", "b").join(
        labels, F.col("b") == F.col("id")).select("a", "b", "label"), "large")
    shared = []
    for part, near in in_rounds(large, texts):
        apart, apart_at = stored(differences(part, near, k, num, den), "apart")
        shared.append(stored(shared_differences(apart), "shared"))
        forget(spark, apart_at)
    members, members_at = stored(reduce(DataFrame.unionByName, [part for part, _ in shared]), "members")
    forget(spark, open_at, large_at, *(path for _, path in shared))
    tested, tables, pivots = tested.select("a", "b"), [edges_at, nodes_at, texts_at, sketched_at, tested_at], 8
    while True:
        here, here_at = stored(still_open(members), "open")
        forget(spark, members_at)
        if here.isEmpty():
            break
        # all members of small groups are pivots, which closes them; of larger ones as many as the round has
        closed = 4 * pivots
        slot = F.when(F.col("n") <= closed, F.xxhash64("id", "size")).otherwise(F.pmod(F.xxhash64("id", F.lit(pivots)), F.lit(pivots)))
        heads = here.where("first").groupBy("key", slot.alias("slot")).agg(F.min_by(F.struct("id", "label", "size", "most"), F.xxhash64("id")).alias("p")).select(
            "key", F.col("p.id").alias("pivot"), F.col("p.label").alias("of"), F.col("p.size").alias("least"), F.col("p.most").alias("room"))
        new = (here.join(heads, "key").where("label <> of AND size >= least AND size - least <= greatest(most, room)").select(*pair("pivot", "id")).distinct().join(tested, ["a", "b"], "left_anti"))
        new, new_at = stored(new, "tested")
        tables.append(new_at)
        links, at = linked(new, sketched, texts, k, num, den)
        labels = merge_labels(labels, links)
        tested = tested.unionByName(new)
        pivots *= 8
        # only what the round left open is labelled anew
        members, members_at = stored(here.where(F.col("n") > closed).drop("label", "n").join(labels, "id"), "members")
        forget(spark, *at, here_at)
    found, _ = stored(sizes.join(labels, sizes.doc_id == labels.id, "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")), "jaccard")
    forget(spark, *tables, here_at)
    return found


def one_of_each(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The documents with the least doc_id of their component; those without an id stay."""
    gone = link_components(docs, k, num, den).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
