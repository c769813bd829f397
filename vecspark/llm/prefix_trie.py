"""A prefix trie of conversations, its subtree totals passed up by time-forward processing.

Turns are range-sorted by conversation and turn, which also cuts a very long
conversation over many tasks; each task hashes its stretch, and the stretches'
hashes are put together from one row per task. A node is a depth and the hash of
the first turns' digests: two polynomials modulo 2^61 - 1, so the hash of a
rebuilt conversation follows from those of its parts. Nodes are combined in the
tasks before they are shuffled, so a turn that very many conversations start
with leaves a task once.

Subtree totals go from children to parents. A node of at most ``unit`` members
whose parent has more is a shard's root; its subtree lies in one task, sorted by
reverse level (deepest first), and every node sends its totals to its parent
through a priority queue that spills sorted runs. Across shard roots the same
step runs again: the roots' totals are summed by parent, the nodes above them
are cut by ``unit`` squared members, and so on until the root itself lies in a
shard. Nodes of one member are chains; their totals are known without a queue.

Defined cases: turns of a conversation are ordered by turn, null first, ties by
the digest of role and text; repeated rows are turns of their own; null role or
text is empty; rows without a conv_id are left out; without conversations there
is no root; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vecspark.llm.common import bounded_batches, shuffle_partitions, stored

#: A conversation takes up to MOST_SHARED - 1 first turns of the first one of its block.
BLOCK, MOST_SHARED = 100, 6
UNIT = 1000
PRIME, BASES = (1 << 61) - 1, (0x1B3F0C5D9E7A2461, 0x0A4D8E36C17B5F29)
BACK = tuple(pow(b, -1, PRIME) for b in BASES)
NO_TURNS = hashlib.sha256(b"").hexdigest()
#: Messages a queue holds in memory; bytes of one packed piece of a list of ids.
QUEUE, PIECE_BYTES = 100_000, 1 << 16
_KEY = ["depth", "k1", "k2"]


def _columns(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of longs."""
    data = zip(*rows) if rows else [[] for _ in names.split()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in data], names=names.split())


def _longs(names: str) -> str:
    return ", ".join(f"{n} long" for n in names.split())


def _rows(batch, step: int = 10_000):
    for at in range(0, len(batch), step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def _append(h, d):
    """The hashes of a sequence and one more turn."""
    return tuple((x * b + y + 1) % PRIME for x, y, b in zip(h, d, BASES))


_TURN = "kind part conv_id pos h1 h2 d1 d2 chars"


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Turns (kind 0) with place and hash within their task's stretch of the conversation; of each task (kind 1, 2) its first and last stretch."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.sha2(role, 256), text), 256)
    long = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), long(1).alias("d1"), long(16).alias("d2"),
        F.char_length(text).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")]

    def hash_stretches(batches):
        part, conv, pos, h, first, several = TaskContext.get().partitionId(), None, 0, (0, 0), None, 0
        for batch in batches:
            out = []
            for c, _, d1, d2, chars in _rows(batch):
                if c != conv:
                    first = (1, part, conv, pos, *h, 0, 0, 0) if conv is not None and first is None else first
                    conv, pos, h, several = c, 0, (0, 0), several + 1
                pos, h = pos + 1, _append(h, (d1, d2))
                out.append((0, part, conv, pos, *h, d1, d2, chars))
            if out:
                yield _columns(_TURN, out)
        if conv is not None:
            last = (2, part, conv, pos, *h, 0, 0, several)
            yield _columns(_TURN, [first or (1, *last[1:-1], 0), last])

    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(hash_stretches, _longs(_TURN))


def carried(marks) -> dict:
    """Per task, what its first conversation has in the tasks before: (conversation, turns, hashes)."""
    out, conv, n, h = {}, None, 0, (0, 0)
    edges = {}
    for kind, part, c, pos, h1, h2, several in marks:
        edges.setdefault(part, {})[kind] = (c, pos, (h1, h2), several)
    for part in sorted(edges):
        (first, pos, own, _), last = edges[part][1], edges[part][2]
        if first == conv:
            out[part] = conv, n, h
            pos, own = n + pos, tuple((x * pow(b, pos, PRIME) + y) % PRIME for x, y, b in zip(h, own, BASES))
        conv, n, h = (first, pos, own) if last[3] == 1 else last[:3]
    return out


_ENTRY = "conv_id pos k1 k2 p1 p2 chars"


def entries(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, p1, p2, chars): each original turn with the hash up to it and up to the one before."""
    turns, _ = stored(sorted_turns(conversations), "turns")
    # two rows per task of the sort
    marks = turns.where("kind > 0").select("kind", "part", "conv_id", "pos", "h1", "h2", "chars").collect()
    before = turns.sparkSession.sparkContext.broadcast(carried(marks))

    def place(batches):
        for batch in batches:
            out = []
            for _, part, conv, pos, h1, h2, d1, d2, chars in _rows(batch):
                h, (c, n, past) = (h1, h2), before.value.get(part, (None, 0, (0, 0)))
                if c == conv:
                    h = tuple((x * pow(b, pos, PRIME) + y) % PRIME for x, y, b in zip(past, h, BASES))
                    pos += n
                parent = tuple((x - y - 1) * b % PRIME for x, y, b in zip(h, (d1, d2), BACK))
                out.append((conv, pos, *h, *parent, chars))
            yield _columns(_ENTRY, out)

    return turns.where("kind = 0").mapInArrow(place, _longs(_ENTRY))


_PATH = "conv_id depth k1 k2 p1 p2 chars rest"


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, k1, k2, p1, p2, chars, rest) of every rebuilt turn, ``rest`` turns below it; (conv_id, depth, k1, k2) of every end)."""
    shared = F.when(F.col("conv_id") % BLOCK == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).cast("long")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max(F.when(F.col("pos") == shared, F.struct("k1", "k2"))).alias("own"))
    heads = (turns.where(f"conv_id % {BLOCK} = 0 AND pos < {MOST_SHARED}").groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "p1", "p2", "chars"))).alias("head")))
    plan = (convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("shared", shared)
            .join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("shared").cast("int")))
            .withColumn("kept", F.size("head").cast("long")).withColumn("last", F.get("head", F.size("head") - 1))
            .withColumn("total", F.col("kept") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))))
    zero = F.lit(0).cast("long")
    plan, _ = stored(plan.select("conv_id", "shared", "kept", "total", "head", *(
        F.coalesce(c, zero).alias(a) for c, a in (("last.k1", "h1"), ("last.k2", "h2"), ("own.k1", "o1"), ("own.k2", "o2")))), "rebuild-plan")
    names = "conv_id pos k1 k2 p1 p2 chars shared kept total h1 h2 o1 o2"
    own = turns.join(plan.drop("head"), "conv_id").where("pos > shared").select(*names.split())

    def shift(batches):
        for batch in batches:
            out = []
            for conv, pos, k1, k2, p1, p2, chars, shared, kept, total, h1, h2, o1, o2 in _rows(batch):
                more, keys = pos - shared, []
                for k, p, h, o, b in ((k1, p1, h1, o1, BASES[0]), (k2, p2, h2, o2, BASES[1])):
                    if h != o:
                        step = (h - o) * pow(b, more - 1, PRIME) % PRIME
                        k, p = (k + step * b) % PRIME, (p + step) % PRIME
                    keys.append((k, p))
                (k1, p1), (k2, p2) = keys
                out.append((conv, kept + more, k1, k2, p1, p2, chars, total - kept - more))
            yield _columns(_PATH, out)

    taken = plan.select("conv_id", "total", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.k1", "t.k2", "t.p1", "t.p2", "t.chars", (F.col("total") - F.col("t.pos")).alias("rest"))
    paths, _ = stored(own.mapInArrow(shift, _longs(_PATH)).unionByName(taken), "paths")
    ends = paths.where("rest = 0").select("conv_id", "depth", "k1", "k2").unionByName(
        plan.where("total = 0").select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2")))
    return paths, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the digest of each node's conversations that end there, sorted, however many they are."""
    order = [*_KEY, "conv_id"]
    names, kinds = [*_KEY, "first", "piece"], [pa.int64()] * 4 + [pa.binary()]

    def pieces(batches):
        key, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for *k, conv in _rows(batch.select(order)):
                if k != key or size >= PIECE_BYTES:
                    if ids:
                        out.append((*key, first, ",".join(ids).encode()))
                    key, first, ids, size = k, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, first, ",".join(ids).encode()), kinds)], names=names)

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *k, _, piece in _rows(batch):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
            yield _digested(out)
        if key is not None:
            yield _digested([(*key, sha.hexdigest())])

    def _digested(out):
        data = zip(*out) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, [pa.int64()] * 3 + [pa.string()])], names=[*_KEY, "ends_sha256"])

    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, k1 long, k2 long, first long, piece binary")
    return (packed.repartition(shuffle_partitions(ends.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "first")
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


class Messages:
    """A priority queue of (level, k1, k2, children, leaves, saved) that spills sorted runs to files of the task's own, gone with it."""

    SHAPE, SIZE = "<6q", 48

    def __init__(self, keep: int = QUEUE):
        self.keep, self.heap, self.runs, self.spilled = keep, [], [], 0

    def send(self, message: tuple):
        heapq.heappush(self.heap, message)
        if len(self.heap) >= self.keep:
            self._spill()

    def _spill(self):
        file = tempfile.TemporaryFile()
        for message in sorted(self.heap):
            file.write(struct.pack(self.SHAPE, *message))
        file.seek(0)
        self.heap, self.spilled = [], self.spilled + 1
        self._next(file)

    def _next(self, file):
        data = file.read(self.SIZE)
        if data:
            heapq.heappush(self.runs, (struct.unpack(self.SHAPE, data), len(self.runs), id(file), file))
        else:
            file.close()

    def receive(self, to: tuple) -> tuple[int, int, int]:
        """The sums of all messages to a node, which leave the queue."""
        children = leaves = saved = 0
        while self.heap and self.heap[0][:3] == to:
            _, _, _, c, n, s = heapq.heappop(self.heap)
            children, leaves, saved = children + c, leaves + n, saved + s
        while self.runs and self.runs[0][0][:3] == to:
            (_, _, _, c, n, s), _, _, file = heapq.heappop(self.runs)
            children, leaves, saved = children + c, leaves + n, saved + s
            self._next(file)
        return children, leaves, saved


_NODE = "depth k1 k2 p1 p2 u1 u2 children leaves saved own"
_TOTAL = "depth k1 k2 p1 p2 top children leaves saved"


def pass_up(nodes: DataFrame, keep: int = QUEUE) -> DataFrame:
    """Totals of all nodes of shards (u1, u2): what they have received already and what comes from below within the shard."""
    def run(batches):
        queue = Messages(keep)
        for batch in batches:
            out = []
            for depth, k1, k2, p1, p2, u1, u2, children, leaves, saved, own in _rows(batch):
                c, n, s = queue.receive((-depth, k1, k2))
                children, saved = children + c, saved + s + own
                leaves = leaves + n if children else 1
                top = (k1, k2) == (u1, u2)
                out.append((depth, k1, k2, p1, p2, int(top), children, leaves, saved))
                if not top:
                    queue.send((1 - depth, p1, p2, 1, leaves, saved))
            yield _columns(_TOTAL, out)

    return (nodes.select(*_NODE.split()).repartition(shuffle_partitions(nodes.sparkSession), "u1", "u2")
            .sortWithinPartitions("u1", "u2", F.desc("depth"), "k1", "k2").mapInArrow(run, _longs(_TOTAL)))


def subtree_totals(nodes: DataFrame, paths: DataFrame, unit: int = UNIT, keep: int = QUEUE) -> DataFrame:
    """(depth, k1, k2, children, leaves, saved) of every node of more than one member, and of the root."""
    wide = nodes.where("n_convs > 1 OR depth = 0")
    zero = F.lit(0).cast("long")
    levels, most = 1, wide.agg(F.max("n_convs")).first()[0] or 0
    while unit ** levels < most:
        levels += 1
    # along a conversation members never grow, so a shard's root is the first node that is small enough
    small = wide.where("depth > 0").select(*_KEY, "n_convs")
    along = paths.select("conv_id", *_KEY).join(small, _KEY)
    roots = along.groupBy("conv_id").agg(*(F.min_by(F.struct("k1", "k2"), F.when(F.col("n_convs") <= unit ** i, F.col("depth"))).alias(f"at{i}")
                                           for i in range(1, levels + 1)))
    below = nodes.where("n_convs = 1 AND depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("children"), F.count("*").alias("leaves"))
    above, _ = stored(wide.join(roots, "conv_id", "left").join(below, _KEY, "left").select(
        *_KEY, "p1", "p2", "n_convs", *(f"at{i}" for i in range(1, levels + 1)), F.coalesce("children", zero).alias("children"),
        F.coalesce("leaves", zero).alias("leaves"), zero.alias("saved"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")), "wide-nodes")
    done = None
    for i in range(1, levels + 1):
        here = above.where(F.col("n_convs") <= unit ** i)
        root = F.col("depth") == 0
        # the conversations' root is its own shard's root, and where it is small enough that of everything
        whole = F.lit(most <= unit ** i)
        here = here.withColumn("u1", F.when(root | whole, zero).otherwise(F.col(f"at{i}.k1"))).withColumn(
            "u2", F.when(root | whole, zero).otherwise(F.col(f"at{i}.k2")))
        totals, _ = stored(pass_up(here, keep), "totals")
        done = totals if done is None else done.unionByName(totals)
        if i == levels:
            break
        sums = totals.where("top = 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count("*").alias("c"), F.sum("leaves").alias("n"), F.sum("saved").alias("s"))
        above, _ = stored(above.where(F.col("n_convs") > unit ** i).join(sums, _KEY, "left").withColumns({
            "children": F.col("children") + F.coalesce("c", zero), "leaves": F.col("leaves") + F.coalesce("n", zero),
            "saved": F.col("saved") + F.coalesce("s", zero)}).drop("c", "n", "s"), "wide-nodes")
    return done.select(*_KEY, "children", "leaves", "saved")


def trie(conversations: DataFrame, unit: int = UNIT, keep: int = QUEUE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    spark = conversations.sparkSession
    zero = F.lit(0).cast("long")
    with bounded_batches(spark, rows=10_000):
        turns, _ = stored(entries(conversations), "trie-entries")
        paths, ends = rebuilt(turns)
        nodes = paths.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"),
                                         F.max("p2").alias("p2"), F.max("chars").alias("chars"), F.max("rest").alias("rest"))
        root = turns.where("pos = 1").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
            zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("p1"), zero.alias("p2"),
            zero.alias("chars"), zero.alias("rest"))
        nodes, _ = stored(nodes.unionByName(root), "trie-nodes")
        totals, digests = subtree_totals(nodes, paths, unit, keep), end_digests(ends)
        parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                  F.col("conv_id").alias("parent_conv_id"))
        first = nodes.where("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("root"))
        single = F.col("children").isNull()
        found = (nodes.join(parents, ["depth", "p1", "p2"], "left").join(F.broadcast(first), "depth", "left")
                 .join(totals, _KEY, "left").join(digests, _KEY, "left").select(
            "conv_id", "depth", F.coalesce("root", "parent_conv_id").alias("parent_conv_id"), "n_convs",
            F.when(single, (F.col("rest") > 0).cast("long")).otherwise(F.col("children")).alias("n_children"),
            F.when(single, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
            F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_TURNS)).alias("ends_sha256")))
        return stored(found, "trie")[0]
