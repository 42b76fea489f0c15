"""The command line over the library (review, dry run, status)."""

import json
import os
import tempfile

from preflight.__main__ import main

from conftest import MANIFEST


def _tables(spark):
    d = tempfile.mkdtemp(prefix="pf-cli-", dir="/tmp")
    spark.createDataFrame([(1, "Ulm", "d"), (2, None, "d")], "station_id long, city string, opened_on string") \
        .write.parquet(os.path.join(d, "stations.parquet"))
    spark.createDataFrame([(70, 1, "day", 10), (70, 3, "dusk", 10)],
                          "ride_id long, station_id long, kind string, minutes int") \
        .write.parquet(os.path.join(d, "rides.parquet"))
    return d


def test_cli_review_and_checks(spark, capsys):
    d = _tables(spark)
    out = tempfile.mkdtemp(prefix="pf-cli-out-", dir="/tmp")
    assert main(["review", "--manifest", MANIFEST, "--tables", d, "--models", "rides", "--out", out]) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert doc["summary"] == {"fail": 2, "warn": 1, "pass": 5}
    assert os.path.isdir(os.path.join(out, "compare"))
    assert main(["checks", "--manifest", MANIFEST, "--models", "rides"]) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert {r["status"] for r in doc["results"]} == {"SKIP"}
    assert {r["check"] for r in doc["results"] if r["has_sample"]} == {"pk_duplicates", "null_rate", "fk_match_rate"}
    assert main(["status", "--manifest", MANIFEST, "--out", out]) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert doc["last_review_summary"].startswith("2 FAIL / 1 WARN / 5 PASS (20")


def test_cli_edge_cases_and_verdicts(spark, capsys):
    d = _tables(spark)
    out = tempfile.mkdtemp(prefix="pf-cli-ec-", dir="/tmp")
    files = {"cases": [{"model": "rides", "description": "kinds", "risk": "LOW",
                        "sql": "SELECT COUNT(*) AS odd_rides FROM {rides} WHERE kind = 'dusk'"}],
             "verdicts": [{"index": 0, "verdict": "known", "status": "expected"}]}
    for k, v in files.items():
        json.dump(v, open(os.path.join(out, k + ".json"), "w"))
    assert main(["edge-cases", "--tables", d, "--cases", os.path.join(out, "cases.json"), "--out", out]) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (doc["flagged"], doc["results"][0]["result"]) == (1, "1 odd rides")
    assert main(["verdicts", "--verdicts", os.path.join(out, "verdicts.json"), "--out", out]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"updated": 1, "total": 1}


def test_cli_status(spark, capsys):
    f = tempfile.NamedTemporaryFile("w", suffix=".txt", delete=False, dir="/tmp")
    f.write("models/core/rides.sql\nmodels/new_one.sql\nmacros/x.sql\n")
    f.close()
    assert main(["status", "--manifest", MANIFEST, "--changed-files", f.name]) == 0
    doc = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert doc["changed_models"] == ["rides", "new_one"]
    assert doc["blast_radius"] == ["city_report", "station_load"]


def test_cli_context(spark, capsys):
    d = tempfile.mkdtemp(prefix="pf-cli-ctx-", dir="/tmp")
    os.makedirs(os.path.join(d, "models"))
    files = {"changed.txt": "models/core/rides.sql\nmodels/new_one.sql\n",
             "models/new_one.sql": "select * from {{ ref('rides') }} join {{ ref('rides') }}",
             "change.diff": "diff --git a/models/new_one.sql b/models/new_one.sql\n+select 1\n"}
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    at = lambda name: os.path.join(d, name)
    assert main(["context", "--manifest", MANIFEST, "--changed-files", at("changed.txt"), "--diff", at("change.diff"),
                 "--project", d]) == 0
    doc = {r["name"]: r for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1])}
    assert doc["new_one"]["is_new"] and doc["new_one"]["upstream"] == ["rides", "rides"]
    assert "+select 1" in doc["new_one"]["diff"] and doc["rides"]["downstream"] == ["station_load"]
