"""The operators against direct definitions (``brute``), on inputs with nulls,
empty and very long texts, ties, repeated rows and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from preflight.llm import (decontaminate, language, line_dedup, minhash, neighbours, packing, suffix_dedup,
                           token_count, toxicity, url_filter)
from preflight.llm.arrow_text import RangeHash, text_slices
from preflight.session import materialize, scratch_files

DOCS = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ordered(x):
    return sorted((tuple(r) for r in x), key=repr)


def words(rnd, n, pool=4000):
    return " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared lines and passages, odd texts."""
    rnd = random.Random(3)
    passage, line = words(rnd, 90), "A line that many documents share, é"
    out = [(0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "One"), (5, words(rnd, 3000)), (None, words(rnd, 80))]
    base = words(rnd, 160).split()
    for i in range(10, 30):
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append((i, " ".join(w)))
    out += [(i, f"{words(rnd, 30)}\n {line.upper() if i % 2 else line}\t\n{passage}\n{words(rnd, 30)}") for i in range(30, 37)]
    out += [(7, out[5][1]), (8, out[5][1]), (8, out[5][1]), (9, "ab" * 700), (40, "é" * 450), (41, "\n\n" + line)]
    return out


def with_others(spark, data, schema=DOCS):
    """The frame with columns that clash with names the operators make."""
    df = spark.createDataFrame(data, schema).repartition(3)
    names = ("n_lines", "n_dropped", "row", "id", "n", "fp", "key", "keys", "score", "lang_pred", "length", "bucket", "core")
    return df.select("*", *[F.lit("own").alias(c) for c in names])


def test_suffix_dedup(spark, corpus):
    df = with_others(spark, corpus)
    want = ordered(brute.repeats(corpus))
    assert rows(suffix_dedup.suffix_dedup(df, digest=True)) == want
    # every core treated as one with too many contexts
    assert rows(suffix_dedup.suffix_dedup(df, digest=True, max_contexts=1)) == want
    short = suffix_dedup.suffix_dedup(df, length=40, k=24)
    got = {(r["doc_id"], r["n_removed"]) for r in short.collect()}
    assert got == {(r[0], r[2]) for r in brute.repeats(corpus, 40)}
    for r in short.collect():
        assert len(r["kept"]) + r["n_removed"] == r["n_bytes"] and sum(y - x for x, y in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("floor", [1, 4])
def test_longest_previous_factors(floor):
    """The LPF array against trying every earlier start, also of suffixes whose
    places are not in order or come up twice."""
    rnd = random.Random(floor)
    for n in (1, 2, 30, 200):
        for letters in ("a", "ab", "abcd"):
            text = "".join(rnd.choice(letters) for _ in range(n))
            place = rnd.sample(range(3 * n), n) if n < 30 else [rnd.randrange(2 * n) for _ in range(n)]
            order = sorted(range(n), key=lambda i: text[i:])
            common = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or text[i + k] != text[j + k]), n)
            lcp = np.array([0] + [common(a, b) for a, b in zip(order, order[1:])])
            want = [max([common(i, j) for j in range(n) if place[j] < place[i]], default=0) for i in order]
            got = suffix_dedup.lpf(np.array(place)[order], lcp, floor)
            assert got.tolist() == [x if x >= floor else 0 for x in want]
            top = suffix_dedup.lpf(np.array(place)[order], np.minimum(lcp, 5), 5, 5)
            assert (top >= 5).tolist() == [x >= 5 for x in want]


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    """Places of the minimum hash of every string, whatever the size of a block."""
    rnd = random.Random(4)
    texts = [words(rnd, 200), "", "ab" * 300, "short", words(rnd, 9), "x" * 90, words(rnd, 120)]
    (t,) = text_slices(pa.RecordBatch.from_pydict({"text": texts}))
    length, k = 60, 24
    want = set()
    gram = RangeHash(t.data).rolling(k)
    for lo, hi in zip(t.starts.tolist(), t.ends.tolist()):
        for i in range(lo, hi - length + 1):
            here = gram[i:i + length - k + 1]
            want |= {i + j for j in np.flatnonzero(here == here.min()).tolist()}
    for block in (100, 1 << 15):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert suffix_dedup.Anchors(t, length, k).at.tolist() == sorted(want)


def test_suffix_ranks():
    """Against sorting the suffixes; keys that leave no room for a place too."""
    rnd = random.Random(5)
    for letters in ("a", "ab", "abc\0", "".join(map(chr, range(256)))):
        text = "".join(rnd.choice(letters) for _ in range(300)).encode("latin-1")
        for depth in (1, 5, 30):
            got = suffix_dedup.suffix_ranks(np.frombuffer(text, np.uint8), depth)[:len(text) - depth + 1]
            heads = [text[i:i + depth] for i in range(len(text) - depth + 1)]
            assert [x == y for x in got for y in got] == [x == y for x in heads for y in heads]
            assert [heads[i] for i in np.argsort(got, kind="stable")] == sorted(heads)
    key = np.array([5, 1 << 63, 5, 0], np.uint64)
    for x in (key, key & np.uint64(7)):
        order, s = suffix_dedup._sorted(x, int(x.max()).bit_length())
        assert order.tolist() == np.argsort(x, kind="stable").tolist() and s.tolist() == sorted(x.tolist())


def test_what_suffix_dedup_moves(spark):
    """Ranges that meet are one before they go to their texts, and contexts of
    hot cores are written once, not string by string."""
    rnd = random.Random(6)
    passage = words(rnd, 150)
    data = [(i, words(rnd, 20) + passage + words(rnd, 20)) for i in range(40)]
    before = set(scratch_files(spark))
    for keep in ("none", "first"):
        got = {}
        for most in (1, suffix_dedup.MAX_CONTEXTS):
            got[most] = rows(suffix_dedup.suffix_dedup(spark.createDataFrame(data, DOCS), keep, digest=True, max_contexts=most))
        assert got[1] == got[suffix_dedup.MAX_CONTEXTS]
    new = [f for f in scratch_files(spark) if f not in before]
    spans = [r for f in new if "-spans-" in f for r in spark.read.parquet(f).collect()]
    assert len(spans) == 2 * (40 + 39) and all(len(r["lo"]) == len(r["hi"]) == 1 for r in spans)
    assert not any("strings" in spark.read.parquet(f).columns for f in new if "-strings-" not in f)


def test_suffix_dedup_keeps_the_first(spark):
    rnd = random.Random(8)
    shared = words(rnd, 100)
    data = [(1, words(rnd, 20) + shared), (2, shared + words(rnd, 20)), (3, words(rnd, 100)), (4, shared)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(
        spark.createDataFrame(data, DOCS), keep="first").collect()}
    assert got[1] == 0 and got[3] == 0 and got[2] >= len(shared) and got[4] == len(shared)


def test_line_dedup(spark, corpus):
    df = with_others(spark, corpus)
    assert rows(line_dedup.line_dedup(df, digest=True)) == ordered(brute.line_dedup(corpus))
    out = line_dedup.line_dedup(df)
    assert {(r["doc_id"], brute.sha(r["text"])) for r in out.collect()} == {
        (r[0], r[3]) for r in brute.line_dedup(corpus)}
    assert out.columns.count("keys") == 1


def test_line_dedup_groups_no_rows_without_an_id(spark):
    rnd = random.Random(9)
    shared = [words(rnd, 8) for _ in range(40)]
    data = [(i, "\n".join(shared)) for i in range(3)]
    data += [(None, x + "\n" + words(rnd, 8)) for x in shared] + [(None, shared[0]), (None, shared[0]), (None, None)]
    df = with_others(spark, data)
    lost = line_dedup.repeated_lines(df).select("doc_id", F.size("keys").alias("n")).collect()
    assert sorted(r["n"] for r in lost if r["doc_id"] is None) == [1] * 41
    assert rows(line_dedup.line_dedup(df, digest=True)) == ordered(brute.line_dedup(data))


def test_line_dedup_small_filter(spark, corpus):
    """A filter far too small lets strangers pass and changes nothing."""
    df = spark.createDataFrame(corpus, DOCS)
    old, line_dedup.MAX_BITS = line_dedup.MAX_BITS, 16
    try:
        assert rows(line_dedup.line_dedup(df, digest=True)) == ordered(brute.line_dedup(corpus))
    finally:
        line_dedup.MAX_BITS = old


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = with_others(spark, corpus)
    assert rows(minhash.near_duplicates(df)) == ordered(brute.near_duplicates(corpus))


def test_only_classes_that_share_a_bucket_are_compared(spark, corpus, monkeypatch):
    """Also where the bitmap of crowded buckets is full, as on large tables."""
    rnd = random.Random(12)
    data = corpus + [(i, words(rnd, 20, 10**9)) for i in range(1000, 1060)]
    wanted = {}

    def kept(df, label="stage", *a, **k):
        out = materialize(df, label, *a, **k)
        if label == "wanted":
            wanted["ids"] = {r["id"] for r in out.collect()}
        return out

    monkeypatch.setattr(minhash, "materialize", kept)
    monkeypatch.setattr(minhash, "FILTER_BITS", 6)
    assert rows(minhash.near_duplicates(with_others(spark, data))) == ordered(brute.near_duplicates(data))
    assert {10, 11, 12} <= wanted["ids"] and not wanted["ids"] & set(range(1000, 1060))


def test_one_document_of_each_group_stays(spark, corpus):
    df = with_others(spark, corpus)
    got = minhash.deduplicated(df, 85)
    assert got.columns == df.columns
    sizes = {i: len(brute.shingles(t)) for i, t in corpus}
    want = sorted({c for d, n, c, _ in brute.near_duplicates(corpus) if n and c is not None} |
                  {i for i, n in sizes.items() if not n})
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == want


def test_super_minhash_estimates():
    """Places agree as often as the sets are similar, with less variance than
    independent hashes have; equal sets agree everywhere."""
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2))
        s = minhash.signatures(np.concatenate([a, b, a]), np.array([len(a), len(b), len(a)]))
        assert (s[0] == s[2]).all()
        agree.append((s[0] == s[1]).mean())
    j = 80 / 100
    assert abs(np.mean(agree) - j) < 0.01
    assert np.var(agree) < 1.1 * j * (1 - j) / minhash.PLACES


def test_decontaminate(spark, corpus):
    rnd = random.Random(4)
    item = corpus[12][1].split()
    items = [(1, " ".join(item[20:60])), (2, " ".join(item[20:60])), (10, "One"), (3, None), (4, ""), (5, "! ?"),
             (6, words(rnd, 50)), (None, " ".join(item[100:112])), (7, " ".join(item[3:9])), (8, corpus[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = with_others(spark, corpus)
    assert rows(decontaminate.decontaminate(df, bench)) == ordered(brute.decontaminate(corpus, items))
    left = decontaminate.clean(df, bench)
    bad = {(d, t) for (d, t), r in zip(corpus, brute.decontaminate(corpus, items)) if r[5]}
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == set(corpus) - bad
    assert left.columns == df.columns


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_count.vocabulary("word_bpe_49k.json"))
    odd = [(50, "It's <|endoftext|>x<|startoftext|>"), (51, "ΣΑΣ İı ẞ ǅ é ½Ⅷ 中文 😀👩‍💻"), (52, "a\x1cb\x85c\u2003d\u3000e"),
           (53, "supercalifragilistic" * 400), (54, "'s't'LL  don't")]
    data = corpus + odd
    got = token_count.count_tokens(spark.createDataFrame(data, DOCS).select("text", "doc_id", F.lit(1).alias("n")))
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got.collect()) == sorted(
        (i or -1, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in data)


def test_language(spark):
    rnd = random.Random(6)
    vocab = {"aa": [f"{x}ung" for x in "bdfgklmn"], "bb": [f"{x}tion" for x in "bdfgklmn"], "ru": ["добрый", "день", "привет"]}
    text = lambda lang, n: " ".join(rnd.choice(vocab[lang]) for _ in range(n))
    data = [(i, text(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "ru"] * 40)]
    schema = DOCS + ", lang string"
    model = language.train(spark.createDataFrame(data + [(900, None, "aa"), (901, "x", None)], schema))
    assert model.langs == ["aa", "bb", "ru"]
    mixed = text("aa", 40) + " " + text("bb", 20)
    new = [(1, text("aa", 5)), (2, text("bb", 5)), (3, "Привет"), (4, None), (5, "12 — 3 €"), (6, mixed), (6, mixed),
           (7, "中文"), (8, "")]
    got = language.identify(with_others(spark, new), model, spans=True, text=True)
    by = {r["doc_id"]: r for r in got.collect()}
    assert {i: r["lang_pred"] for i, r in by.items() if i != 7} == {
        1: "aa", 2: "bb", 3: "ru", 4: "und", 5: "und", 6: "aa", 8: "und"}
    assert by[7]["lang_pred"] in model.langs and by[7]["score"] < 0.5 and by[4]["score"] == 0
    assert [(s["lang"], mixed.encode()[s["lo"]:s["hi"]].decode()) for s in by[6]["spans"]] == [
        ("aa", " ".join(mixed.split()[:40])), ("bb", " ".join(mixed.split()[40:]))]
    none = language.train(spark.createDataFrame([], schema))
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame(new, DOCS), none).collect()} == {"und"}


def test_more_languages_than_a_byte_holds(spark):
    rnd = random.Random(7)
    pools = {f"l{j:03d}": ["".join(rnd.choices("abcdefghijklmnop", k=9)) for _ in range(12)] for j in range(300)}
    text = lambda g, n: " ".join(rnd.choice(pools[g]) for _ in range(n))
    data = [(10 * j + i, text(g, 25), g) for j, g in enumerate(pools) for i in range(2)]
    model = language.train(spark.createDataFrame(data, DOCS + ", lang string"))
    new = [(j, text(g, 12)) for j, g in enumerate(pools)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(new, DOCS), model).collect()}
    assert got == {j: g for j, g in enumerate(pools)}


def test_a_rare_language_is_learned(spark, monkeypatch):
    """One text in 400 is in a language that a uniform sample of 100 would miss."""
    monkeypatch.setattr(language, "LEAST_DOCS", 20)
    rnd = random.Random(8)
    vocab = {"aa": [f"{x}ung" for x in "bdfgklmn"], "bb": [f"{x}tion" for x in "bdfgklmn"], "zz": [f"{x}ovik" for x in "bdfgklmn"]}
    text = lambda g, n: " ".join(rnd.choice(vocab[g]) for _ in range(n))
    data = [(i, text(g, 20), g) for i, g in enumerate(["aa"] * 2000 + ["bb"] * 2000 + ["zz"] * 10)]
    model = language.train(spark.createDataFrame(data, DOCS + ", lang string"), train_docs=100)
    assert model.langs == ["aa", "bb", "zz"]
    new = [(i, text(g, 8)) for i, g in enumerate(vocab)]
    got = language.identify(spark.createDataFrame(new, DOCS), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == dict(enumerate(vocab))


def test_word_scores_against_plain_loops():
    """A word's score is the sum of its trigrams' and its own log-likelihoods,
    counted and summed one by one."""
    import pyarrow as pa
    texts = ["abba cab", "cab abba abba", "dada bad"]
    langs = ["x", "x", "y"]
    counts = {g: {} for g in "xy"}
    feats = []
    for t in texts + ["abba dada zap"]:
        [sl] = list(language.text_slices(pa.RecordBatch.from_pydict({"text": [t]})))
        w = language.Words(sl)
        own = [[int(w.gram[i]) for i in range(a, b)] + [int(h)] for a, b, h in zip(w.starts, w.ends, w.whole)]
        feats.append(own)
    for g, own in zip(langs, feats):
        for word in own:
            for f in word:
                counts[g][f] = counts[g].get(f, 0) + 1
    batch = pa.RecordBatch.from_pydict({"lang": langs, "text": texts})
    got = {}
    for b in language._counts([batch]):
        for g, f, n in zip(*(c.to_pylist() for c in b.columns)):
            if f < language.FEATURES:
                got.setdefault(g, {})[f] = n
    assert got == counts
    logp = {}
    for g in "xy":
        for part in (range(language.BUCKETS), range(language.BUCKETS, language.FEATURES)):
            total = sum(counts[g].get(f, 0) + language.ALPHA for f in part)
            for f in part:
                logp[g, f] = np.log((counts[g].get(f, 0) + language.ALPHA) / total)
    seen = set(counts["x"]) | set(counts["y"])
    weights = np.zeros((language.FEATURES + 1, 2), np.float32)
    for f in seen:
        mean = (logp["x", f] + logp["y", f]) / 2
        weights[f] = [logp["x", f] - mean, logp["y", f] - mean]
    writes = np.zeros((language.SCRIPTS, 2), bool)
    writes[1] = True
    [sl] = list(language.text_slices(pa.RecordBatch.from_pydict({"text": ["abba dada zap"]})))
    e = language.word_scores(language.Words(sl), language.Model(["x", "y"], weights, writes))
    for row, word in zip(e, feats[3]):
        s = np.array([sum(weights[f, j] for f in word) for j in (0, 1)])
        assert row == pytest.approx(np.maximum(s - s.max(), -language.CUT), abs=1e-4)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    counts = np.array([0, 5, 1, 7])
    e = -10 * rng.random((counts.sum(), 3)).astype(np.float32)
    got, lo = language.viterbi(e, counts, 4.0), 0
    for n in counts:
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n) if n else []
        cost = lambda p: e[lo + np.arange(n), p].sum() - 4.0 * (np.diff(p) != 0).sum()
        if n:
            assert cost(got[lo:lo + n]) == pytest.approx(max(map(cost, paths)), abs=1e-4)
        lo += n


def test_toxicity(spark):
    rnd = random.Random(9)
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = ["".join(rnd.choices("abcd", k=4)) for _ in range(60)] + ["grobb"] * (bad * (1 + i % 7))
        rnd.shuffle(w)
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5000, 1), (3, 0), (1, None)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(data, DOCS), lab)
    new = [(1, "Grobb words here"), (2, "grobb " * 9), (3, data[1][1] * 9), (4, None), (4, None), (5, "")]
    by = {r["doc_id"]: r for r in toxicity.severity(with_others(spark, new), model).collect()}
    assert {i: r["toxic"] for i, r in by.items()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert 0 <= by[3]["severity"] < by[1]["severity"] < by[2]["severity"] <= 3
    assert list(model.thresholds) == sorted(model.thresholds)
    none = toxicity.train(spark.createDataFrame([], DOCS), lab)
    assert not any(r["toxic"] for r in toxicity.severity(spark.createDataFrame(new, DOCS), none).collect())


def test_url_filter(spark):
    urls = [("https://a.com/x", "com/", "allow"), ("http://b.example.com/en/1", "example.com/en/", "block"),
            ("http://www.EXAMPLE.com/en/1", "www.example.com/en/", "allow"), ("http://a.net/es/?x", "net/es/", "block"),
            ("http://a.net/en/free-win", None, "block"), ("http://a.net/free-free", None, "allow"),
            ("http://a.org/spamming", None, "allow"), ("http://a.org/SPAM-farm", None, "block"),
            ("http://xcom/y", None, "allow"), ("http://com?x", None, "allow"), ("no-url/porn", None, "block"),
            (None, None, "allow"), ("", None, "allow"), ("x://y://z.com/", None, "allow"), ("a://com/#f", "com/", "allow")]
    data = [(i, u) for i, (u, _, _) in enumerate(urls)] * 2
    df = spark.createDataFrame(data, "page_id long, url string").withColumns({"host": F.lit("own"), "rule": F.lit(1)})
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {i: (rule, v) for i, (_, rule, v) in enumerate(urls)}
    parts = {r["page_id"]: (r["host"], r["path"]) for r in url_filter.judge(df).collect()}
    assert parts[2] == ("www.example.com", "/en/1") and parts[3] == ("a.net", "/es/") and parts[9] == ("com", "")
    assert parts[10] == ("", "") and parts[11] == ("", "") and parts[13] == ("y:", "//z.com/")


def test_bounds_are_optimal():
    import itertools
    rng = np.random.default_rng(1)
    for _ in range(100):
        h = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(50, h, replace=False)), rng.integers(1, 20, h), int(rng.integers(1, 5))
        pad = lambda e: sum(c * (min(x for x in e if x >= n) - n) for n, c in zip(lengths, counts))
        got = packing.bounds(lengths, counts, k)
        best = min(pad([*x, lengths[-1]]) for n in range(min(k, h)) for x in itertools.combinations(lengths[:-1], n))
        assert len(got) <= k and got[-1] == lengths[-1] and pad(got) == best


def test_packing(spark, corpus):
    data = corpus * 3
    got = packing.pack_documents(with_others(spark, data), n_buckets=4, budget=400).collect()
    from tokenizers import Tokenizer
    count = Tokenizer.from_file(token_count.vocabulary("word_bpe_49k.json"))
    assert sorted((r["doc_id"] or -1, r["length"]) for r in got) == sorted(
        (i or -1, len(count.encode(t or "", add_special_tokens=False).ids)) for i, t in data)
    batches = {}
    for r in got:
        assert r["length"] <= r["pad_to"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, _), rs in batches.items():
        cap = max(1, 400 // max(rs[0]["pad_to"], 1))
        assert sorted(r["slot"] for r in rs) == list(range(len(rs))) and len(rs) <= cap
    full = {b: [len(v) for (x, _), v in batches.items() if x == b] for b, _ in batches}
    assert all(sorted(v)[1:] == sorted(v)[1:2] * (len(v) - 1) for v in full.values())   # one batch may be short
    many = packing.pack(spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("length")), 2, 60, 100)
    assert many.groupBy("bucket", "batch", "slot").count().filter("count > 1").count() == 0


def test_packing_a_row_that_a_third_repeats(spark, monkeypatch):
    """100,000 equal rows without an id: one row until places are known, then
    listed in parts; places are whole, and the batches keep to the budget."""
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("length"))
    rest = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("length"))
    rows_ = hot.unionByName(rest)
    out = packing.pack(rows_, 4, 1000).cache()
    assert out.count() == 300_000 and out.filter("doc_id IS NULL").count() == 100_000
    assert out.groupBy("bucket", "batch", "slot").count().filter("count > 1").count() == 0
    used = out.groupBy("bucket", "batch").agg(F.sum("pad_to").alias("t"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("s"))
    assert used.filter("t > 1000 OR s <> n - 1").count() == 0
    want = sorted(map(tuple, packing.pack(rows_.limit(5000), 4, 1000).collect()), key=repr)
    monkeypatch.setattr(packing, "COPIES", 100)
    assert sorted(map(tuple, packing.pack(rows_.limit(5000), 4, 1000).collect()), key=repr) == want


def padding(lengths, counts, k):
    """The least padding of k buckets, by trying every cut."""
    t, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * t[1:] - s[1:]
    for _ in range(1, k):
        best = np.array([min([best[j], *(best[:j] + lengths[j] * (t[j + 1] - t[1:j + 1]) - (s[j + 1] - s[1:j + 1]))])
                         for j in range(len(lengths))])
    return int(best[-1])


def test_one_huge_text_moves_no_other_bound(spark):
    rng = np.random.default_rng(2)
    size = np.concatenate([np.ceil(rng.lognormal(5, 0.8, 3000)).astype(np.int64), [5_000_000]])
    rows_ = spark.createDataFrame([(i, n) for i, n in enumerate(size.tolist())], "doc_id long, length long")
    got = packing.pack(rows_, 16).collect()
    lengths, counts = np.unique(size, return_counts=True)
    assert len(got) == len(size) and {r["pad_to"] for r in got} <= set(size.tolist())
    assert sum(r["pad_to"] - r["length"] for r in got) == padding(lengths, counts, 16)
    for k in (2, 5, 9):
        ends = np.array(packing.bounds(lengths, counts, k))
        assert int((counts * (ends[np.searchsorted(ends, lengths)] - lengths)).sum()) == padding(lengths, counts, k)


@pytest.mark.parametrize("size", [1e-25, 1.0, 1e25])
def test_nearest_at_any_magnitude(spark, size):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1500, 32)) * size).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    y = x.astype(float) / size
    hits = 0
    for q in range(0, 1500, 50):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 30


def test_nearest_of_doubles(spark):
    """Components beyond single precision, and lengths 10^200 apart."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)) * np.where(np.arange(400) % 2, 1e-150, 1e90)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 50 == 1, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(1, 400, 50):
        s = (x / 1e90) @ (x[q] * 1e150)
        s[q] = -np.inf
        assert [v for _, v in sorted(got[q])] == np.argsort(-s)[:5].tolist()


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[40:90] = x[40]                                              # one vector held by many rows
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0]), (None, data[3][1]),
             (2080, [None] + [1.0] * 23), (0, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "cid": F.lit(2)})
    got = neighbours.nearest(df, lambda i: i % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 1500, 20)) and all(len(v) == 20 for v in by.values())
    y, hits = x.astype(float), 0
    for q, found in by.items():
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(len(y)), -np.round(s, 9))) if i != q][:20]
        hits += len(set(best) & {i for i, _ in found})
        assert q not in [i for i, _ in found]
        assert [i for i, _ in found] == [i for i, _ in sorted(found, key=lambda f: (-f[1], f[0]))]
        assert all(v == pytest.approx(s[i], rel=1e-9) for i, v in found)
    assert hits / (20 * len(by)) >= 0.9
    ties = [sorted(i for i, _ in v if 40 <= i < 90 and i != q) for q, v in by.items()]
    assert all(t == [i for i in range(40, 90) if i != q][:len(t)] for q, t in zip(by, ties))     # the smallest ids
    few = neighbours.nearest(df.filter("vec_id in (0, 1, 2, 20)"), lambda i: i % 20 == 0)
    assert few.groupBy("query_id").count().collect()[0]["count"] == 3


def test_nearest_of_uneven_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12000, 64))
    x *= (rng.lognormal(0, 0.1, 12000) / np.sqrt((x * x).sum(1)))[:, None]
    x[5] *= 10                                                    # one long vector
    x[6:9] *= 1e-6                                                # a band of three
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, lambda i: i % 100 == 0).select("query_id", "vec_id").collect()
    y, hits = x.astype(float), 0
    for q in range(0, 12000, 100):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / (20 * 120) >= 0.9


def test_runs_with_many_queries_are_split(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    ask = lambda: sorted(map(tuple, neighbours.nearest(df, lambda i: i % 2 == 0, 5).collect()))
    whole = ask()
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 40)
    monkeypatch.setattr(neighbours, "SCORES", 100)
    assert len(whole) == 1500 and ask() == whole


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS + ", lang string")
    bench = spark.createDataFrame([], "item_id long, text string")
    model = language.train(docs)
    for df in (suffix_dedup.suffix_dedup(docs, digest=True), line_dedup.line_dedup(docs, digest=True),
               minhash.near_duplicates(docs), minhash.deduplicated(docs), decontaminate.decontaminate(docs, bench),
               decontaminate.clean(docs, bench), token_count.count_tokens(docs), language.identify(docs, model),
               packing.pack_documents(docs),
               url_filter.judge(spark.createDataFrame([], "page_id long, url string")),
               neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0)):
        assert df.collect() == []
