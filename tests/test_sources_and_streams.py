"""Sources, sinks, streams and the registry."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators.findings import Rule, overlaid
from tracewright.plans import registry
from tracewright.sources import files, sarif
from tracewright.streaming import events


def test_tree_scan_skips_ignored_and_unknown(spark, tmp_path):
    for name, text in {"src/a.py": b"import os\r\nos.system(x)\xff\n", "src/b.txt": b"x", "node_modules/c.js": b"eval(1)", "gen/d.js": b"x", "run": b"#!/usr/bin/node\n", "e.c": b"int LLVMFuzzerTestOneInput;"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    got = {r["path"]: r for r in files.read_tree(spark, str(tmp_path), files.ignore_patterns("# x\n!y\ngen/*\n\n")).collect()}
    assert set(got) == {"src/a.py", "run", "e.c"}
    assert got["src/a.py"]["text"] == "import os\nos.system(x)\n" and got["src/a.py"]["loc"] == 2 and got["run"]["language"] == "javascript" and got["e.c"]["has_fuzz"]
    assert [tuple(r) for r in files.language_counts(files.read_tree(spark, str(tmp_path))).collect()] == [("c", 1), ("javascript", 2), ("python", 1)]


def test_rules_manifest_and_ledger_files(spark, tmp_path):
    (tmp_path / "r.toml").write_text("[[rule]]\nrule_id='b'\npattern='(x)'\ncwe='CWE-1'\n[[rule]]\nrule_id='a'\npattern='y\\('\ncwe='CWE-2'\nlanguages=['c']\n")
    rules = files.read_rules(str(tmp_path))
    assert [(r.rule_id, r.token_group, r.languages) for r in rules] == [("a", 0, ("c",)), ("b", 1, ())]
    assert [(r.status, r.precision) for r in overlaid(rules, {"a": {"status": "shadow"}, "b": {"status": "odd", "precision_estimate": 0.5}})] == [("shadow", 0.0), ("enabled", 0.5)]
    (tmp_path / "s.toml").write_text("[[rule]]\nrule_id='a'\npattern='z'\n")
    with pytest.raises(files.SourceError):
        files.read_rules(str(tmp_path))
    (tmp_path / "m.toml.txt").write_text("name='m'\n[[expected]]\npath='p'\nline=3\n[[expected]]\npath='q'\nrule_id='r'\n")
    assert [(r["key"], r["e_ord"], r["line"], r["rule_id"]) for r in files.read_expected(spark, str(tmp_path / "m.toml.txt")).collect()] == [("m", 0, 3, None), ("m", 1, None, "r")]
    ledger = spark.createDataFrame([("f", "p", "c", "unreachable_path", "why", "s:c", None)], files.LEDGER)
    path = files.write_ledger(ledger, str(tmp_path / "ledger"), "1")
    assert files.read_ledger(spark, path).first()["demotion"] == 0.5
    assert files.read_ledger(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "l.json").write_text(json.dumps({"learnings": [{"finding_id": "r:p:1", "path": "d/p", "vulnerability_class": "c", "reason": "duplicate", "evidence": "e", "scope": "d:c"}]}, indent=2))
    assert tuple(files.read_ledger(spark, str(tmp_path / "l.json"), document=True).first()) == ("r:p:1", "d/p", "c", "duplicate", "e", "d:c", 0.5)
    bad = files.write_ledger(ledger.withColumn("reason", F.lit("odd")), str(tmp_path / "ledger"), "2")
    with pytest.raises(Exception, match="unknown reason"):
        files.read_ledger(spark, bad).collect()


def test_sarif_in_and_out(spark, tmp_path):
    place = lambda p, n: [{"physicalLocation": {"artifactLocation": {"uri": p}, "region": {"startLine": n}}}]
    run = {"tool": {"driver": {"name": "My Tool", "rules": [{"id": "r1", "name": "One", "properties": {"security-severity": "8.1"}}, {"id": "r2", "properties": {"security-severity": "2"}}]}}, "results": [{"ruleId": "r1", "level": "none", "message": {"text": "m"}, "locations": place("./src/x.c", 4), "fingerprints": {"k": "v"}}, {"ruleId": "r2", "level": "note", "locations": place(".github/y", 1)}, {"ruleId": "r3", "level": "error", "locations": place("a", 2)}, {"ruleId": "r3", "level": "warning"}]}
    (tmp_path / "a.sarif").write_text(json.dumps({"version": "2.1.0", "runs": [run]}))
    got = [(r["path"], r["line"], r["severity"], r["title"], r["analyzer"], r["fingerprint"]) for r in sarif.read_hints(spark, [str(tmp_path / "absent.sarif"), str(tmp_path / "a.sarif")]).collect()]
    assert got == [("a", 2, "high", "r3", "my_tool", None), ("github/y", 1, "medium", "r2", "my_tool", None), ("src/x.c", 4, "high", "One", "my_tool", "v")]
    rows = spark.createDataFrame([("r:p:1", "r", "p", 1, "tok", "high")], "finding_id string, rule_id string, path string, line int, token string, severity string")
    sarif.write_results(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back["ruleId"] == "r" and back["level"] == "error" and back["locations"][0]["physicalLocation"]["region"]["startLine"] == 1


def test_streams_windows_dedupe_and_ledger(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (1, "2024-01-01 00:30:00", "b")]
    table = spark.createDataFrame(rows, "k int, t string, event_type string").select("k", F.to_timestamp("t").alias("ts"), "event_type")
    table.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = lambda: events.read_events(spark, str(tmp_path / "e"), 1)
    assert {(r["event_type"], r["events"]) for r in events.drained(events.windowed_counts(stream()), "complete").collect()} == {("a", 2), ("b", 1)}
    assert {r["k"] for r in events.drained(events.deduplicated(stream(), ["k"])).collect()} == {1, 2} and events.drained(events.deduplicated(stream(), ["k"])).count() == 2
    merged = events.upserted_ledger(stream().select("k", "event_type"), "k int, event_type string", "k")
    assert {r["k"] for r in merged.collect()} == {1, 2} and merged.count() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_late_data_counts_every_event(spark, tmp_path, files):
    """The last windows, events days late in a later file and events without a time; one file or a folder."""
    import duckdb

    times = ["2024-01-01 10:10:00", "2024-01-05 23:59:00", "2024-01-05 22:00:00", "2024-01-01 10:59:59", None, "2023-12-31 00:30:00"]
    path = str(tmp_path / "events.parquet")
    duckdb.sql("select unnest(?::timestamp[]) as ts, 'a' as event_type", params=[times]).write_parquet(path if files == 1 else str(tmp_path / "all.parquet"))
    if files > 1:
        (tmp_path / "events.parquet").mkdir()
        for k in range(files):
            duckdb.sql(f"select * from '{tmp_path}/all.parquet' limit 2 offset {2 * k}").write_parquet(f"{path}/part-{k}.parquet")
    got = {(r["start"] and r["start"].isoformat(), r["events"]) for r in registry.QUERIES["q43_late_data"](spark, str(tmp_path)).collect()}
    files_of = path if files == 1 else f"{path}/*.parquet"
    want = duckdb.sql(registry.ORACLES["q43_late_data"].replace("from events", f"from '{files_of}'")).fetchall()
    assert got == {(start and start.isoformat(), n) for start, _, n in want} and sum(n for _, n in got) == 6 and len(want) == 5


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
    assert set(registry.QUERIES) == set(registry.ORACLES)


TABLES = "customer documents embeddings events benchmark labels lineitem nation orders pages conversations region supplier".split()


def _rows(frame):
    cell = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["q03_pattern_findings", "q04_findings_with_policy", "q10_rank_priority", "q17_calibrate", "q19_project_score", "q16_learnings", "q26_detection_rollup", "q51_manifest_metrics", "q34_retrieval_budget", "q42_session_window", "q48_trajectories"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    assert _rows(registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()) == _rows(con.sql(registry.ORACLES[name]).df())
