"""The pipeline's stages, each against the direct definition on its own input."""


import pytest

import brute
import corpus_pipeline as P
from preflight.llm.queries import ORACLE_SQL, QUERIES
from preflight.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_language_keeps_clean_documents(stages):
    assert stages[1].count() == stages[0].filter("text rlike '[A-Za-z]'").count()


def test_lines(stages):
    want = {(d, h) for d, _, _, h in brute.line_dedup(pairs(stages[1]))}
    assert {(d, brute.sha(t)) for d, t in pairs(stages[2])} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_duplicates(stages):
    before = pairs(stages[2])
    sets = [brute.shingles(t) for _, t in before]
    parent = list(range(len(before)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(before):
        groups.setdefault(find(i), []).append(d)
    assert sorted(d for d, _ in pairs(stages[3])) == sorted(min(g) for g in groups.values())


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in brute.decontaminate(pairs(stages[3]), items) if not r[5])
    assert sorted(d for d, _ in pairs(stages[4])) == want


def test_run(spark, stages):
    from preflight.session import scratch_files
    before = set(scratch_files(spark))
    got = P.run(spark, SF)
    left = [p.rsplit("/preflight-", 1)[1].rsplit("-", 1)[0] for p in scratch_files(spark) if p not in before]
    assert left == ["decontamination", "lengths"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].collect()))
    assert got.count() == stages[4].count()


def test_registered():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and P.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(want, key=repr)
