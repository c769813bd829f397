"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

from vecspark.llm.prefix_trie import Messages, trie


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + (text or "")).encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, len(text or "")))
    own = {c: [(k, n) for _, _, k, n in sorted(t)] for c, t in own.items()}
    members, ends, chars = defaultdict(list), defaultdict(list), {(): 0}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(__import__("math").fmod(conv, 100))
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            key = tuple(k for k, _ in path[:d])
            members[key].append(conv)
            chars[key] = path[d - 1][1] if d else 0
        ends[tuple(k for k, _ in path)].append(conv)
    out = []
    for key, who in members.items():
        below = [k for k in members if k[:len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(not any(len(o) == len(k) + 1 and o[:len(k)] == k for o in members) for k in below)
        out.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(kids), leaves,
                    sum((len(members[k]) - 1) * chars[k] for k in below),
                    hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(0, 40), *range(100, 130), *range(205, 220), -5, -100, -101, 10 ** 12]:
        start = draw.choice([[], ["hi"], ["hi", "yo"], ["hi", "yo", "é漢"], ["long " * 50, "x"]])
        for turn, text in enumerate(start + [draw.choice(["a", "b", f"own {conv}"]) for _ in range(draw.randint(0 if start else 1, 7))]):
            rows.append((conv, turn, draw.choice(["user", "user", None]) if turn > 2 else "user", text))
    for conv in (301, 302, 303, 399):
        rows += [(conv, turn, "user", "copied") for turn in range(9)]
    # ties, repeats, nulls, no id
    rows += [(7, 3, "user", "tie"), (7, 3, "tool", "tie"), (7, 3, "user", "tie"), (8, None, None, None), (9, None, "user", "first"),
             (None, 1, "user", "lost"), (10, 2, "user", "")]
    draw.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_plain(spark):
    rows = made(2)
    want = plain(rows)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{SCHEMA}, depth int, k1 string").repartition(5)
    assert sorted(map(tuple, trie(df).collect()), key=repr) == want
    # shards of few members, queues that spill
    assert sorted(map(tuple, trie(df, unit=3, keep=2).collect()), key=repr) == want
    one = [r for r in rows if r[0] in (0, 205, 301)]
    assert sorted(map(tuple, trie(spark.createDataFrame(one, SCHEMA)).collect()), key=repr) == plain(one)


def test_a_long_conversation_over_many_tasks(spark):
    rows = [(100, i, "user", f"turn {i}") for i in range(600)] + [(c, i, "user", f"turn {i + (i > 40) * c}") for c in (101, 102, 200) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert sorted(map(tuple, trie(df, unit=2, keep=3).collect()), key=repr) == plain(rows)


def test_conversations_without_turns_and_empty_tables(spark):
    conv = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(conv, 0, "user", "goes")]
    assert list(map(tuple, trie(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows) == [
        (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_messages_spill_and_come_back_in_order():
    queue, draw = Messages(4), random.Random(1)
    sent = defaultdict(list)
    for _ in range(500):
        to = (-draw.randint(0, 9), draw.randint(0, 3), draw.randint(0, 3))
        sent[to].append(draw.randint(0, 1 << 40))
        queue.send((*to, 1, 2, sent[to][-1]))
    assert queue.spilled > 100
    for to in sorted(sent):
        assert queue.receive(to) == (len(sent[to]), 2 * len(sent[to]), sum(sent[to]))
    assert not queue.heap and not queue.runs
