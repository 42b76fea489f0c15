"""Operator 12 against context trees in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from preflight.llm import context_tree as ct

DOCS = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def brute(data):
    def steps(text):
        x = b"\xff" * ct.DEPTH + lower(text).encode() + b"\xff"
        for i in range(ct.DEPTH, len(x)):
            node = 1
            for k in range(7, -1, -1):
                bit = x[i] >> k & 1
                yield node, x[i - ct.DEPTH:i], bit
                node = node << 1 | bit

    count = Counter()
    for i, text in data:
        if learns(i):
            for node, ctx, bit in steps(text):
                for d in range(ct.DEPTH + 1):
                    count[node, ctx[ct.DEPTH - d:], bit] += 1
    contexts = {(n, c) for n, c, _ in count}
    pe = {}
    for k in contexts:
        a, b = count[*k, 0], count[*k, 1]
        pe[k] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    kids, pw = Counter(), {}
    for k in sorted(contexts, key=lambda k: -len(k[1])):
        pw[k] = pe[k] if len(k[1]) == ct.DEPTH else math.log(0.5) + np.logaddexp(pe[k], kids[k])
        if k[1]:
            kids[k[0], k[1][1:]] += pw[k]

    def p(node, ctx, bit):
        out, rest = 0.0, 1.0
        for d in range(ct.DEPTH + 1):
            k = (node, ctx[ct.DEPTH - d:])
            stop = 1.0 if d == ct.DEPTH else math.exp(pe[k] + math.log(0.5) - pw[k]) if k in pe else 0.5
            out += rest * stop * (count[*k, bit] + 0.5) / (count[*k, 0] + count[*k, 1] + 1)
            rest *= 1 - stop
        return out

    token = lambda text: re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [None]
    c = Counter(t for i, text in data if learns(i) for t in token(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in data:
        own = token(text)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(c[t] > 0 for t in own), n,
                    sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own),
                    sum(math.log10(p(*s)) for s in steps(text))))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    out = [(0, None), (1, ""), (2, " \n"), (3, "A b\x1ca É 中 文 \x00"), (None, "no id"), (None, "no id"), (5, "again"), (5, "again")]
    w = ["the", "of", "Étude", "mañana", "и", "over"]
    return out + [(i, " ".join(rnd.choice(w) + rnd.choice(["", "s", "."]) for _ in range(rnd.randrange(40)))) for i in range(10, 70)]


def check(df, data):
    got = sorted(df.select("doc_id", F.coalesce(ct.held_out(), F.lit(False)), "n_tokens", "n_known", "train_tokens",
                           "base_score", "score").collect(), key=repr)
    want = sorted(brute(data), key=repr)
    assert sorted(r[:5] for r in got) == sorted(r[:5] for r in want) if all(r[0] is not None for r in want) else True
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:5], round(r[6], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-10, abs=1e-10)


@pytest.mark.parametrize("limit", [None, 50, 0])
def test_scores(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(ct, "GROUP", 100)
    monkeypatch.setattr(ct, "HELD", 3000)
    df = spark.createDataFrame(texts, DOCS).select(
        "*", *[F.lit("own").alias(c) for c in ("row", "key", "n", "train", "score", "val")]).repartition(3)
    out = ct.score(df, ~ct.held_out(), limit)
    check(out, texts)
    for r in out.collect():
        assert r["code_bits"] == pytest.approx(-r["score"] * math.log2(10)) and (r["bits_per_byte"] is None) == (r["doc_id"] in (0, 1))


def test_probabilities_add_up(spark):
    """Over all bytes that may follow a context, the model's probability is 1."""
    data = [(i, "abracadabra " * (i % 3 + 1)) for i in range(8)]
    ask = [b"\xff" * 4 + b"a", b"dabra", b"zzzzz"]
    rows = [(int.from_bytes(c[::-1], "big") << 8 | b, 0) for c in ask for b in range(256)]
    df = spark.createDataFrame(data, DOCS)
    counts = df.withColumn("train", F.lit(True)).select("text", "train").mapInArrow(ct._count, "key long, n long").filter("key >= 0")
    counts = counts.unionByName(spark.createDataFrame(rows, "key long, n long")).groupBy("key").agg(F.sum("n").alias("n"))
    got = ct.tree_values(counts, 1000).groupBy(F.shiftright("key", 8).alias("c")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.pow(F.lit(10.0), F.col("val"))).alias("p")).collect()
    whole = [r["p"] for r in got if r["k"] == 256]
    assert len(whole) == 3 and whole == pytest.approx([1.0] * 3)


def test_a_long_text_and_held_out_gain(spark):
    rnd = random.Random(1)
    w = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(w) for _ in range(n))
    data = [(i, say(300)) for i in range(60)] + [(100, say(400_000))]
    got = ct.score(spark.createDataFrame(data, DOCS), ~ct.held_out()).collect()
    assert len(data[-1][1]) > 1 << 20 and len(got) == 61
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert held and all(0 < r["bits_per_byte"] < 2.5 and r["score"] > 1.2 * r["base_score"] for r in held)


def test_no_documents(spark):
    assert ct.score(spark.createDataFrame([], DOCS), ~ct.held_out()).collect() == []
    [r] = ct.score(spark.createDataFrame([(1, "ab")], DOCS), F.lit(False)).collect()
    assert r["score"] == pytest.approx(-24 * math.log10(2)) and r["train_tokens"] == r["n_known"] == r["base_score"] == 0
