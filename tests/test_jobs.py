"""The jobs: growing input, repeated runs, batches that are run again, their command lines and their SQL."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import commit_mining, common, queries, series_validation

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
SETTINGS = {"select": "SELECT repo, hash AS commit_hash, subject, body FROM {input}", "max_files": 1}
SCHEMA = "repo string, hash string, subject string, body string"


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "orders", "events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, got = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    at = [list(got.columns).index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())


FIRST = [("a", "1", "Fix memory leak (#4)", None), ("a", "2", "Update docs", ""), ("b", "1", "Fix deadlock and resource leak", "x"), (None, "7", None, "connection leak"), ("a", "1", "Fix memory leak (#4)", None)]
SECOND = [("a", "1", "Fix memory leak (#4)", None), ("a", "3", "Memory leak in pool", None), ("a", "4", "Refactor lock contention", None), ("b", "1", "Fix deadlock and resource leak", "x")]


def add(spark, given, folder, name):
    made = Path(folder).parent / name
    spark.createDataFrame(given, SCHEMA).coalesce(1).write.parquet(str(made))
    part = next(made.glob("part-*"))
    os.makedirs(folder, exist_ok=True)
    os.rename(part, f"{folder}/{name}.parquet")


def test_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "millrace.jobs")
    source, out, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    add(spark, FIRST, source, "one")
    assert commit_mining.run(spark, source, out, marks, settings=SETTINGS) == {"batches": 1, "read": 5, "written": 3}
    first = rows(commit_mining.written(spark, out))
    assert sorted((r.repo, r.commit_hash) for r in commit_mining.written(spark, out).collect()) == [("", "7"), ("a", "1"), ("b", "1")]
    assert commit_mining.run(spark, source, out, marks, settings=SETTINGS) == {"batches": 0, "read": 0, "written": 0}
    assert "nothing new" in caplog.text
    add(spark, SECOND, source, "two")
    assert commit_mining.run(spark, source, out, marks, settings=SETTINGS) == {"batches": 1, "read": 4, "written": 1}  # one is known, one ruled out, one of another batch
    found = commit_mining.written(spark, out)
    assert rows(found.filter("batch = 0")) == first and [r.commit_hash for r in found.filter("batch = 1").collect()] == ["3"]
    whole = f"{tmp_path}/whole"
    commit_mining.run(spark, source, whole, f"{tmp_path}/other", settings=SETTINGS | {"max_files": 100})
    assert rows(found.drop("batch")) == rows(commit_mining.written(spark, whole).drop("batch"))
    assert rows(spark.read.parquet(f"{out}/repos")) == rows(spark.read.parquet(f"{whole}/repos"))
    assert {r.repo: (r.total, r.multi) for r in spark.read.parquet(f"{out}/repos").collect()} == {"": (1, 0), "a": (2, 0), "b": (1, 1)}


def test_a_batch_run_again_replaces_what_it_left(spark, tmp_path):
    source, out, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    add(spark, FIRST, source, "one")
    commit_mining.run(spark, source, out, marks, settings=SETTINGS)
    add(spark, SECOND, source, "two")
    commit_mining.run(spark, source, out, marks, settings=SETTINGS)
    before = rows(commit_mining.written(spark, out))
    for f in Path(f"{marks}/commits").glob("*1*"):  # as if the driver had been lost between the write and the mark
        f.unlink()
    assert commit_mining.run(spark, source, out, marks, settings=SETTINGS)["batches"] == 1
    assert rows(commit_mining.written(spark, out)) == before


def test_pull_requests_and_filters(spark, tmp_path):
    add(spark, FIRST, f"{tmp_path}/in", "one")
    spark.createDataFrame([("b", "1", 5, "u5", "t", True), ("a", "1", 6, "u6", None, False)], "repo string, commit_hash string, pr_number int, pr_url string, pr_title string, merged boolean").write.parquet(f"{tmp_path}/prs")
    commit_mining.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks", f"{tmp_path}/prs", SETTINGS | {"merged_only": True})
    r = commit_mining.written(spark, f"{tmp_path}/out").collect()
    assert [(x.repo, x.pr_number, x.pr_details) for x in r] == [("b", "5", "PR #5 · t | PR: u5 | Commit: https://github.com/b/commit/1")] and r[0].fault_class == "LC+RL"


SERIES = "entry long, variant string, ordinal long, value double, threads int"


def test_validation_replaces_classes_alone(spark, tmp_path):
    up = [(1, "buggy", i, 10.0 * i, 32) for i in range(8)] + [(1, "fixed", i, 5.0, 32) for i in range(8)]
    lone = [(2, "buggy", i, 10.0 * i, 32) for i in range(8)]
    bad = [(None, "buggy", 0, 1.0, 32), (1, "other", 0, 1.0, 32), (1, "buggy", 99, None, 32)]
    spark.createDataFrame(up + lone + bad, SERIES).write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(1, True), (1, None)], "entry long, confirmed boolean").write.parquet(f"{tmp_path}/f")
    s, out = f"{tmp_path}/s", f"{tmp_path}/out"
    given = {"benchmarks": s, "memory": s, "descriptors": s, "findings": f"{tmp_path}/f"}
    assert series_validation.run(spark, out, **given) == {"lock_contention": 2, "memory_leak": 2, "resource_leak": 2}
    found = series_validation.written(spark, out)
    got = {(r.fault_category, r.entry): (r.disposition, r.reason) for r in found.collect()}
    assert got["memory_leak", 1] == got["resource_leak", 1] == ("validated", None) and got["lock_contention", 1][0] == "rejected"
    assert {v for k, v in got.items() if k[1] == 2} == {("rejected", "one side was not measured")}
    before = rows(found)
    series_validation.run(spark, out, **given)
    assert rows(series_validation.written(spark, out)) == before
    spark.createDataFrame(lone, SERIES).write.parquet(f"{tmp_path}/t")
    assert series_validation.run(spark, out, {"kinds": ["memory_leak"]}, memory=f"{tmp_path}/t", benchmarks=s) == {"memory_leak": 1}
    after = series_validation.written(spark, out)
    assert rows(after.filter("fault_category != 'memory_leak'")) == [r for r in before if "'memory_leak'" not in r] and after.count() == 5
    spark.createDataFrame([], SERIES).write.parquet(f"{tmp_path}/none")
    assert series_validation.run(spark, f"{tmp_path}/empty", descriptors=f"{tmp_path}/none", settings={"kinds": ["resource_leak"]}) == {"resource_leak": 0}
    with pytest.raises(ValueError, match="unknown classes"):
        series_validation.run(spark, out, {"kinds": ["x"]})


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"max_files": 3}')
    assert common.config(spark, str(tmp_path / "c.json"), **commit_mining.SETTINGS)["max_files"] == 3
    (tmp_path / "d.json").write_text('{"max_file": 3}')
    with pytest.raises(ValueError, match="max_file"):
        common.config(spark, str(tmp_path / "d.json"), **commit_mining.SETTINGS)
    for job in (commit_mining, series_validation):
        assert set(json.loads((ROOT / "jobs" / f"{job.__name__.split('.')[1]}.json").read_text())) <= set(job.SETTINGS)


def test_command_lines(spark, tmp_path):
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    os.makedirs(tmp_path / "docs")
    os.symlink(f"{SF}/documents.parquet", tmp_path / "docs" / "a.parquet")
    at = [sys.executable, str(ROOT / "jobs" / "commit_mining.py"), "--input", f"{tmp_path}/docs", "--output", f"{tmp_path}/m", "--checkpoint", f"{tmp_path}/cp", "--config", str(ROOT / "jobs" / "commit_mining.json")]
    said = subprocess.run(at, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and "read 200 rows" in said.stderr, said.stderr[-2000:]
    series = "SELECT user_id AS entry, CASE WHEN event_id % 2 = 0 THEN 'buggy' ELSE 'fixed' END AS variant, event_id AS ordinal, value FROM {input}"
    (tmp_path / "c.json").write_text(json.dumps({"memory": series, "kinds": ["memory_leak"]}))
    at = [sys.executable, str(ROOT / "jobs" / "series_validation.py"), "--memory", f"{SF}/events.parquet", "--output", f"{tmp_path}/v", "--config", f"{tmp_path}/c.json"]
    said = subprocess.run(at, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-2000:]
    users = spark.read.parquet(f"{SF}/events.parquet").select(F.countDistinct("user_id")).first()[0]
    assert series_validation.written(spark, f"{tmp_path}/v").count() == users
