"""Operator 13 against whole-text encoding and decoded bytes."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from preflight.llm import token_alignment as ta
from preflight.llm.token_count import byte_symbols, vocabulary

DOCS = "doc_id long, text string"


def brute(data):
    """Rows of the operator, each text encoded whole."""
    a = tokenizers.Tokenizer.from_file(vocabulary(ta.A_NAME))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(ta.B_NAME))
    byte = {s: i for i, s in enumerate(byte_symbols())}

    def a_bytes(i):
        return bytes(byte[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    docs, holds = [], Counter()
    for doc_id, text in data:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[f(i) for i in x] for f, x in zip((a_bytes, b_bytes), ids)]
        if not text or any(b"".join(x) != (" " + text).encode() for x in parts):
            docs.append((doc_id, [], [], []))
            continue
        ends = []
        for x in parts:
            at, out = 0, []
            for y in x:
                at += len(y)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k in (0, 1):
            for i, e in zip(ids[k], ends[k]):
                groups[bisect_left(cuts, e)][k].append(i)
        links = [(i, j) for x, y in groups for i in x for j in y]
        holds.update(set(links))
        docs.append((doc_id, ids, groups, links))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for doc_id, ids, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), len(links),
                    sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if ids else ""))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    odd = [None, "", " ", "  a  b ", "a\u2581b", "<s> hi</s> <unk> <|endoftext|> x", "a\x00b \x1c c", "\ta\n b\r\n\r\n c",
           "\ufb01 \uff57 \u00a0x \u3000y \u0085z", "\u4e2d\u6587\u5b57 \U0001f600\u200d\U0001f469 \u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35",
           "It's we'll  don't\n\n\n  12345 -- 3.14 == ...", "h\u00e9llo \u00c9tion \u0301 e\u0301 \U00010348\U0001d11e",
           "<0x41> <0xFF> \u2028 x", "x" * 5000, "\u20ac" * 700 + " \U0001f600" * 300]
    pool = [c for c in "abcdefghij  \n\u00e9\u4e2d\U0001f600.,'1"]
    odd += ["".join(rnd.choices(pool, k=rnd.randrange(1, 80))) for _ in range(60)]
    data = [(i, t) for i, t in enumerate(odd)] + [(None, "no id"), (None, "no id"), (3, "no id"), (3, "no id")]
    long = " ".join(rnd.choice(["Wort", "mot", "\u0441\u043b\u043e\u0432\u043e", "palabra,", "(x)"]) + str(rnd.randrange(99)) for _ in range(260_000))
    return data + [(900, long), (901, long[:3000])]


@pytest.fixture(scope="module")
def want(texts):
    return sorted(brute(texts), key=repr)


@pytest.mark.parametrize("limit", [None, 40])
def test_alignment(spark, texts, want, limit):
    df = spark.createDataFrame(texts, DOCS).select(
        "*", *[F.lit("own").alias(c) for c in ("row", "pairs", "n", "groups", "n_a", "best")]).repartition(3)
    got = ta.align(df, digest=True, limit=limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_alignment_groups_and_small_memory(spark, texts, monkeypatch):
    monkeypatch.setattr(ta, "MEMO", 3)
    monkeypatch.setattr(ta, "SLICE", 50)
    data = [x for x in texts if x[0] != 900]
    df = spark.createDataFrame(data, DOCS)
    links = ta.linked(df)
    worker = ta.Aligned(ta.Tokenizers(vocabulary(ta.A_NAME), vocabulary(ta.B_NAME)))
    for _ in range(2):
        for i, t in data:
            worker.documents([t, t], False)
            assert len(worker.memo) <= 3 + len(ta.CUT.split(t or ""))
    for r in links.collect():
        if r["groups"]:
            parts = [g.split("|") for g in r["groups"].split(";")]
            assert sum(len(a.split(",")) for a, _ in parts) == r["n_a"]
            assert sum(len(a.split(",")) * len(b.split(",")) for a, b in parts) == r["n_links"] == sum(r["times"])


def test_no_documents(spark):
    assert ta.align(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r)[1:] for r in ta.align(spark.createDataFrame([(1, None)], DOCS), digest=True).collect()] == [(0,) * 6 + ("",)]
