"""Operator 11 against a dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from preflight.llm import prefix_trie as pt

TURNS = "conv_id long, turn int, role string, text string"


def brute(data, rebuild=True):
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == p))).encode()).hexdigest())
            for p, m in nodes.items()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(2)
    say = lambda d: (rnd.choice("ua"), f"é{rnd.randrange(2 if d < 3 else 3)}" * rnd.randrange(1, 3))
    out = []
    for c in range(-7, 300):
        if c % 11 == 0:
            continue
        out += [(c, t, *(("u", "hello") if t == 0 and c % 3 else say(t))) for t in range(rnd.randrange(1, 12))]
    out += [(400, None, "u", "first"), (400, 0, None, None), (400, 1, "u", ""), (401, 2, "a", "ab"), (401, 2, "a", "aa"),
            (401, 2, "", "z"), (402, 1, "u", "x"), (402, 1, "u", "x"), (None, 0, "u", "nobody"), (None, None, None, None),
            (404, 0, "ab", "c"), (409, 0, "a", "bc")]
    out += [(c, t, "u", f"t{t}") for c in (500, 501, 700) for t in range(300 + c % 2)]
    out += [(c, t, "u", "same") for c in range(600, 640) for t in range(4)]
    out += [(800, 0, "u", "long " * 300_000), (805, 0, "u", "long " * 300_000)]
    rnd.shuffle(out)
    return out


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, TURNS).select(
        "*", *[F.lit("own").alias(c) for c in ("n", "depth", "chunk", "path", "at", "head", "len")]).repartition(parts)


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, talks, rebuild):
    assert rows(pt.prefix_trie(frame(spark, talks), rebuild)) == sorted(brute(talks, rebuild), key=repr)


def test_small_shards_blocks_and_many_tasks(spark, talks, monkeypatch):
    """Spines within and between tasks, conversations over several blocks and tasks."""
    monkeypatch.setattr(pt, "SHARD", 20)
    monkeypatch.setattr(pt, "BLOCK", 7)
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("false", "13")):
            spark.conf.set(k, v)
        few = [r for r in talks if r[0] is None or r[0] < 120 or r[0] > 390]
        got = rows(pt.prefix_trie(frame(spark, few, 5), True))
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert got == sorted(brute(few), key=repr)


def test_one_conversation_over_many_tasks(spark):
    turns, convs = pt.numbered(frame(spark, [(5, t // 2, "u", f"x{t}") for t in range(2000)] + [(6, 0, "u", "y")], 6))
    got = turns.collect()
    assert sorted(r["j"] for r in got if r["conv_id"] == 5) == list(range(1, 2001))
    assert {r["conv_id"]: r["total"] for r in convs.collect()} == {5: 2000, 6: 1}


def test_no_conversations(spark):
    assert pt.prefix_trie(frame(spark, []), True).collect() == []
    assert pt.prefix_trie(frame(spark, [(None, 1, "u", "x")]), True).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_findclose(seed):
    rnd = random.Random(seed)
    bits, depth = [True], 1
    while len(bits) < 5000 * (seed + 1) or depth > 1:
        up = depth == 1 or (len(bits) < 5000 * (seed + 1) and rnd.random() < (0.5, 0.52, 0.6, 0.5)[seed])
        bits.append(up)
        depth += 1 if up else -1
    bits.append(False)
    want, stack = {}, []
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    p = pt.Parentheses(np.array(bits))
    opens = np.array(sorted(want))
    assert p.findclose(opens).tolist() == [want[i] for i in opens.tolist()]
    assert p.pairs[-1] == sum(x and not y for x, y in zip(bits, bits[1:]))
