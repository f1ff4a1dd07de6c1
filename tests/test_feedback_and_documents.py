"""Documents written by tasks, ledgers across runs, JSON out of texts, rule ledgers and journals, retrieval packages, mapping records."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from tracewright.operators import entrypoints, findings, lifecycle, model_output, policy, retrieve, verify
from tracewright.sources import documents, files, sarif
from tracewright.streaming import events

FINDING = "finding_id string, rule_id string, title string, path string, line int, ord int, function_name string, severity string, confidence string, evidence_level string, reachability string, conditions array<string>, priority double, tags array<string>, rationale string, token string"


def finding(rule, path, line, severity, priority=2.0, **more):
    row = {"finding_id": f"{rule}:{path}:{line}", "rule_id": rule, "title": f"Title {rule}", "path": path, "line": line, "ord": 0, "function_name": None, "severity": severity, "confidence": "medium", "evidence_level": "static_corroboration", "reachability": "reachable", "conditions": [], "priority": priority, "tags": ["t", rule], "rationale": f"{rule} \"matched\" Bearer abcdefghijklmnop", "token": "x"}
    return tuple({**row, **more}[f.split()[0]] for f in FINDING.split(", "))


@pytest.fixture
def found(spark):
    rows = [finding("r2", f"p{i:02}", i, "medium", 1.0 + i % 3) for i in range(40)] + [finding("r1", "a b", 3, "critical"), finding("r3", "c", 4, "low", conditions=["k", "l"], function_name="go")]
    return spark.createDataFrame(rows, FINDING).repartition(7)


def test_one_sarif_document_from_many_tasks(spark, found, tmp_path):
    verdicts = spark.createDataFrame([("r1:a b:3", 1, "rejected"), ("r1:a b:3", 2, "accepted"), ("zz", 1, "accepted")], "finding_id string, ord int, status string")
    assert {(r["finding_id"], r["status"]) for r in verify.latest_verification(verdicts).collect()} == {("r1:a b:3", "accepted"), ("zz", "accepted")}
    path = str(tmp_path / "out" / "report.sarif")
    (tmp_path / "out").mkdir()
    for _ in range(2):  # a second write replaces the first
        documents.write_sarif(found, path, verdicts)
    with open(path) as f:
        doc = json.load(f)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["results"]) == 42 and [x.name for x in (tmp_path / "out").iterdir()] == ["report.sarif"]
    order = [(r["properties"]["finding_id"], r["level"]) for r in run["results"]]
    assert order[0] == ("r1:a b:3", "error") and order[-1] == ("r3:c:4", "note")
    want = [r["finding_id"] for r in findings.in_report_order(found).collect()]
    assert [x[0] for x in order] == want
    assert run["results"][0]["properties"]["verification"] == {"finding_id": "r1:a b:3", "status": "accepted"} and run["results"][1]["properties"]["verification"] is None
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "r2", "r3"] and run["tool"]["driver"]["rules"][0]["shortDescription"] == {"text": "Title r1"}
    back = sarif.read_hints(spark, [path])
    assert {(r["path"], r["line"], r["rule_id"], r["severity"], r["fingerprint"]) for r in back.collect()} == {(r["path"], r["line"], r["rule_id"], {"critical": "high", "medium": "medium", "low": "low"}[r["severity"]], r["finding_id"]) for r in found.collect()}
    documents.write_sarif(found.where("false"), path)
    with open(path) as f:
        assert json.load(f)["runs"][0] == {"results": [], "tool": {"driver": {"name": "tracewright", "rules": []}}}


def test_one_report(spark, found, tmp_path):
    path = str(tmp_path / "report.md")
    documents.write_report(found.where("rule_id <> 'r2'"), path)
    with open(path) as f:
        text = f.read()
    head, *parts = text.split("\n## ")
    assert head == "# Report\n\nFindings: 2\n\n## Title r1".removesuffix("## Title r1").rstrip("\n") + "\n" or head.startswith("# Report\n\nFindings: 2")
    assert "***REDACTED***" in text and "abcdefghijklmnop" not in text and text.endswith("\n") and not text.endswith("\n\n")
    assert "- ID: `r3:c:4`" in text and "- Function: `go`" in text and "- Conditions: `k, l`" in text and "- Verification: `not_run`" in text and text.index("r1:a b:3") < text.index("r3:c:4")
    documents.write_report(found.where("false"), path)
    with open(path) as f:
        assert f.read() == "# Report\n\nFindings: 0\n\nNo quick-mode findings were emitted.\n"


def test_rule_ledgers_and_journals(spark, tmp_path):
    path, folder = str(tmp_path / "rules.json"), str(tmp_path / "journal")
    assert files.read_rule_ledger(spark, path).count() == 0 and files.read_journal(spark, folder).count() == 0
    ledger = spark.createDataFrame([("b", "shadow", None, 0.5), ('a"q', None, "suspicion", None)], files.RULE_LEDGER)
    documents.write_rule_ledger(ledger, path)
    with open(path) as f:
        assert json.load(f) == {"b": {"status": "shadow", "precision_estimate": 0.5}, 'a"q': {"min_evidence_level": "suspicion"}}
    assert {tuple(r) for r in files.read_rule_ledger(spark, path).collect()} == {tuple(r) for r in ledger.collect()}
    edit = lambda k, why: (k, "rule", "r", "enabled", "shadow", why)
    for n, (outcome, edits) in enumerate([("reverted", [edit("k1", ""), edit("k2", "new reason"), edit(None, "")]), ("accepted", [edit("k3", "")]), ("reverted", [edit("k4", None)])], 1):
        files.append_round(spark.createDataFrame([(n, outcome, outcome, edits, 0.9, 0.9 + n / 100, 0.0, 0.1 * n, 70, 70 + n)], files.JOURNAL), folder)
    journal = files.read_journal(spark, folder)
    assert {r["key"] for r in lifecycle.reverted_keys(journal).collect()} == {"k1", "k4"}
    steps = [(r["round"], r["recall_change"] and round(r["recall_change"], 4), r["score_change"], r["best_score"]) for r in lifecycle.rounds(journal).orderBy("round").collect()]
    assert steps == [(1, None, None, 71), (2, 0.01, 1, 72), (3, 0.01, 1, 73)]
    (tmp_path / "j.json").write_text(json.dumps([{"round": 1, "outcome": "reverted", "edits": [{"key": "z"}]}], indent=1))
    assert [r["key"] for r in lifecycle.reverted_keys(files.read_journal(spark, str(tmp_path / "j.json"))).collect()] == ["z"]


def test_life_of_a_rule(spark):
    rules = spark.createDataFrame([("a", "enabled", "CWE-1"), ("b", "shadow", "CWE-1"), ("c", "enabled", "CWE-1"), ("d", "enabled", "CWE-9"), ("e", "enabled", "CWE-1"), ("f", "enabled", "CWE-1")], "rule_id string, status string, cwe string")
    counts = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2), ("c", 2), ("d", 1), ("e", 0), ("f", 4), ("other", 3)], "rule_id string, false_positives int")
    ledger = spark.createDataFrame([("c", "disabled", 0.25), ("b", "enabled", None)], "rule_id string, status string, precision_estimate double")
    reverted = spark.createDataFrame([("rule:f:enabled->shadow",)], "key string")
    edits = lifecycle.proposed_edits(counts, rules, ledger, reverted)
    assert {(r["rule_id"], r["key"]) for r in edits.collect()} == {(x, f"rule:{x}:enabled->shadow") for x in "abd"}
    table = spark.createDataFrame([("CWE-1",)], "cwe string")
    more = edits.unionByName(spark.createDataFrame([("k", "enabled", "shadow", "", ""), ("a", "enabled", "disabled", "", ""), ("a", "enabled", "odd", "", "")], "rule_id string, from_status string, to_status string, rationale string, key string"))
    breaches = {(r["rule_id"], r["to_status"]): r["breach"] for r in lifecycle.checked_edits(more, rules, table).collect()}
    assert breaches[("a", "shadow")] is None and "unknown rule_id 'k'" in breaches[("k", "shadow")] and "jump is forbidden" in breaches[("a", "disabled")] and "invalid status 'odd'" in breaches[("a", "odd")] and "CWE CWE-9 does not resolve" in breaches[("d", "shadow")]
    after = lifecycle.next_ledger(ledger, lifecycle.checked_edits(edits, rules, table))
    assert {tuple(r) for r in after.select("rule_id", "status", "precision_estimate").collect()} == {("a", "shadow", None), ("b", "shadow", None), ("c", "disabled", 0.25)}
    constants = spark.createDataFrame([("K", 60.0), ("K", 10.0), ("MIN_SCORE", 101.0), ("severity", 3.0)], "name string, to_value double")
    assert [r["breach"] is None for r in lifecycle.checked_constants(constants).collect()] == [True, False, False, False]
    rows = spark.createDataFrame([(0.9, 0.05, 70, 5), (0.89, 0.0, 99, 9), (0.95, 0.1, 99, 9), (0.95, 0.0, 69, 9), (0.95, 0.0, 70, 4)], "r double, f double, s int, m int")
    assert [x[0] for x in rows.select(lifecycle.accepted(F.col("r"), F.col("f"), F.col("s"), F.col("m"), F.lit(70), F.lit(5))).collect()] == [True, False, False, False, False]


LEDGER = "k int, v string, t int"


def test_a_ledger_survives_restarts_and_replays(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "ledger")

    def arrive(*rows):
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(source)

    run = lambda: events.upserted_ledger(spark.readStream.schema(LEDGER).parquet(source), LEDGER, "k", folder, "t")
    arrive((1, "old", 1), (1, "new", 2), (2, "two", 1))
    assert {tuple(r) for r in run().collect()} == {(1, "new", 2), (2, "two", 1)}
    arrive((2, "later", 5), (3, "three", 5))
    assert {tuple(r) for r in run().collect()} == {(1, "new", 2), (2, "later", 5), (3, "three", 5)}  # another run goes on from the first
    assert events.ledger_versions(spark, folder) == [0, 1]
    # The batch is replayed: its commit is lost, and its version is half written.
    import os
    import shutil

    for name in ("1", ".1.crc"):
        os.remove(f"{folder}/_checkpoint/commits/{name}")
    os.remove(f"{folder}/version=1/_SUCCESS")
    assert {tuple(r) for r in run().collect()} == {(1, "new", 2), (2, "later", 5), (3, "three", 5)}
    assert events.ledger_versions(spark, folder) == [0, 1]
    shutil.rmtree(f"{folder}/version=1")
    assert {tuple(r) for r in events.read_ledger_versions(spark, folder, LEDGER).collect()} == {(1, "new", 2), (2, "two", 1)}
    assert events.read_ledger_versions(spark, str(tmp_path / "none"), LEDGER).count() == 0


def test_late_events_no_longer_change_a_window(spark, tmp_path):
    schema = "event_id long, t string, event_type string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).select("event_id", F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))

    arrive((1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"))
    arrive((3, "2024-01-01 09:00:00", "a"))
    arrive((7, "2024-01-01 09:10:00", "a"))
    arrive((4, "2024-01-01 00:20:00", "a"), (5, "2024-01-01 08:30:00", "a"), (6, "2024-01-01 12:00:00", "a"))  # the first of these is too late
    files_ = sorted((tmp_path / "e").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    import os

    for i, p in enumerate(files_):
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    got = events.drained(events.windowed_counts(events.read_events(spark, str(tmp_path / "e"), 1)), "append").collect()
    assert {(r["start"].hour, r["events"]) for r in got} == {(0, 2), (8, 1), (9, 2)}


def test_json_in_texts(spark):
    texts = [
        ("a", 'Found:\n```json\n[{"line": 9, "title": "SQLi", "cwe": "CWE-89", "rationale": "concat"}]\n``` ok'), ("b", "no findings here"), ("c", "[not, valid, json]"), ("d", '[{"line": "7"}, {"line": true}, {"line": 2.5, "cwe": 79}, {}]'),
        ("e", '[{"a": [1, {"b": "]"}]}, 3 , {"line": null}]'), ("f", None), ("g", "[]"), ("h", 'x [ {"line": 1} ] y [ {"line": 2} ]'),
    ]
    got = [(r["path"], r["item"], r["line"], r["title"], r["cwe"]) for r in model_output.findings_in_text(spark.createDataFrame(texts, "path string, text string")).orderBy("path", "item").collect()]
    assert got == [("a", 0, 9, "SQLi", "CWE-89"), *[("d", i, n, "model finding", c) for i, n, c in ((0, None, None), (1, 1, None), (2, None, "79"), (3, None, None))], ("e", 0, None, "model finding", None), ("e", 2, None, "model finding", None)]


def test_rankings_are_strict(spark):
    ok = {"path": "p", "surface": 5, "influence": 4, "reachability": 3}
    payloads = [[ok, {**ok, "surface": 1, "static_boosts": ["b", "a"]}], {"rankings": [{**ok, "path": "q", "rationale": "why"}]}, {"rankings": {}}, "text", [{**ok, "surface": True}], [{**ok, "influence": 6}], [{**ok, "reachability": "3"}], [{**ok, "path": ""}], [{**ok, "rationale": ""}], [{**ok, "static_boosts": "x"}], [7], [{k: v for k, v in ok.items() if k != "influence"}], []]
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(90, '```json\n{"rankings": []}\n```'), (91, "not json"), (92, None)]
    good, refused = model_output.ranking_rows(spark.createDataFrame(rows, "payload_id int, payload string"))
    assert {(r["payload_id"], r["path"], r["priority"], r["rationale"], tuple(r["boosts"])) for r in good.collect()} == {(0, "p", 2.2, "model ranking", ("a", "b")), (1, "q", 4.2, "why", ())}
    reasons = {r["payload_id"]: r["reason"] for r in refused.collect()}
    assert set(reasons) == {2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 91, 92}
    assert reasons[4] == "ranking item for p requires integer surface from 1 to 5" and reasons[11] == "ranking item for p requires integer influence from 1 to 5" and reasons[7] == "ranking item requires non-empty path"
    assert reasons[8] == "ranking item for p requires rationale" and reasons[9] == "ranking item for p has invalid static_boosts" and reasons[10] == "each ranking item must be an object" and "list or object" in reasons[91]


def test_packages_from_a_stored_index(spark, tmp_path):
    rows = [(i, f"f{i}", 1, 2, "x" * 10 * (i + 1), [1.0, float(i)], "n0" if i % 2 else "n1") for i in range(8)]
    path = str(tmp_path / "index")
    assert files.read_vectors(spark, path).count() == 0
    files.write_vectors(spark.createDataFrame(rows, files.VECTORS), path)
    index = files.read_vectors(spark, path)
    assert index.count() == 8 and index.where("namespace = 'n0'").inputFiles()
    queries = spark.createDataFrame([(1, [1.0, 0.0], "n1"), (2, [0.0, 1.0], "n0")], "query_id int, q_embedding array<float>, namespace string")
    hits = retrieve.top_for_queries(index, queries, 3)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in hits.orderBy("query_id", "rank").collect()] == [(1, 1, 0), (1, 2, 2), (1, 3, 4), (2, 1, 7), (2, 2, 5), (2, 3, 3)]
    packed = {r["query_id"]: r for r in retrieve.packages(hits, 80).collect()}
    assert packed[1]["text"] == "[n1] f0:1-2\n" + "x" * 10 + "\n\n[n1] f2:1-2\n" + "x" * 30 and packed[1]["truncated"] and packed[1]["hits"] == 2
    assert packed[2]["hits"] == 0 and packed[2]["text"] == "" and packed[2]["truncated"]
    assert not any(r["truncated"] for r in retrieve.packages(hits, 10_000).collect())


def test_snapshots_contexts_and_limits(spark, found):
    targets = spark.createDataFrame([("a.c", "c", "x" * 9), ("b.py", "python", None), ("d.c", "c", "")], "path string, language string, text string")
    row = files.snapshot(targets, "/r", "abc").first()
    assert (row["file_count"], row["languages"]) == (3, {"c": 2, "python": 1})
    key = retrieve.reuse_key(files.snapshot(targets, "/r"), "m").first()["reuse_key"]
    assert key == hashlib.sha256(json.dumps({"root": "/r", "commit": None, "file_count": 3, "languages": {"c": 2, "python": 1}, "embedding_model": "m"}, sort_keys=True).encode()).hexdigest()[:24]
    assert [tuple(r) for r in model_output.source_contexts(targets, 4).collect()] == [("a.c", "[repo_code] a.c\nxxxx")]
    kept, told = findings.limited(found, 2)
    assert [r["rule_id"] for r in kept.collect()] == ["r1", "r2"] and tuple(told.first()) == ("budget", "max_findings_exceeded", 2, 42)
    assert findings.limited(found, 0)[0].count() == 42 and findings.limited(found, 0)[1].count() == 0 and findings.limited(found, 50)[1].count() == 0
    twice = found.unionByName(found.withColumn("line", F.lit(1)))
    assert findings.per_target(twice, 1).count() == 42
    weights = policy.category_counts(policy.with_penalty(found.withColumn("cwe", F.when(F.col("rule_id") == "r2", "CWE-1").otherwise("CWE-2")), spark.createDataFrame([("CWE-1", "One", 4, True, False), ("CWE-2", "Two", 5, False, True)], "cwe string, category string, severity int, static boolean, dynamic boolean")))
    assert [tuple(r) for r in weights.collect()] == [("One", 40, 1000.0, 4)]


def test_mapping_records(spark):
    hints = spark.createDataFrame([("parser.c", 7, "sg.rule", "semgrep", "high", "m"), ("app.py", 7, "py/inj", "codeql", "high", None), ("x", 1, "r", "other", "low", "n")], "path string, line int, rule_id string, analyzer string, severity string, message string")
    assert [(r["kind"], r["task"]) for r in sarif.mapping_tasks(hints).orderBy("kind").collect()] == [("codeql", "source_sink_sanitizer_path_review"), ("semgrep", "pattern_variant_review")]
    assert [tuple(r) for r in sarif.evidence_candidates(hints, "app.py").collect()] == [("codeql", "py/inj", "app.py", 7, "high", "py/inj", "sarif:codeql:py/inj")]


def test_python_entries_over_several_lines(spark):
    text = '@app.route(\n    "/a",\n    methods=["POST"],\n)\n@requires(\n    "admin",  # )\n)\ndef one(\n    x,\n):\n    """if beta: (\n    """\n    if (flag_a and\n            x):\n        return [\n            x]\n\nclass C:\n  class D:\n    @click.command()\n    def run(self): return 1\n'
    rows = {(r["name"], r["kind"]): r for r in entrypoints.entry_points(spark.createDataFrame([("m.py", "python", text, []), ("bad.py", "python", "@app.route('/')\ndef x(:\n", []), ("nul.py", "python", "@a.get\ndef x(): 1\0", [])], "path string, language string, text string, tags array<string>")).collect()}
    one, run = rows["one", "route"], rows["run", "cli"]
    assert (one["line"], one["end_line"], one["access_level"], one["access_evidence"], one["conditions"]) == (8, 16, "role-restricted", ["requires('admin')"], ["flag_a and x"])
    assert (run["line"], run["end_line"], run["access_level"]) == (21, 21, "local-only") and run["provenance"] == "entrypoint:cli:local-only"
    assert set(rows) == {("one", "route"), ("run", "cli"), ("cli_parser", "cli")}


def test_sarif_is_read_by_lines_and_no_result_carries_all_others(spark, found, tmp_path):
    path, other = str(tmp_path / "own.sarif"), str(tmp_path / "other.sarif")
    documents.write_sarif(found, path, tool='My "Sem" Tool')
    with open(path) as f, open(other, "w") as g:
        doc = json.load(f)
        json.dump(doc, g)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    own, whole = sarif.read_hints(spark, [path]), sarif.read_hints(spark, [other])
    assert " json" not in plan(own) and "Generate" not in plan(own)
    # What a Generate leaves out is listed by number; before, it left out nothing and each result's row held its whole run.
    assert all(re.search(r"\), \[\d+\], ", x) for x in plan(whole).splitlines() if "Generate explode(" in x)
    rows = [tuple(r) for r in own.collect()]
    assert len(rows) == 42 and rows == [tuple(r) for r in whole.collect()] and {r[3] for r in rows} == {'my_"sem"_tool'}
    both = [tuple(r) for r in sarif.read_hints(spark, [path, other]).collect()]
    assert sorted(both, key=str) == sorted(rows + rows, key=str)
    assert sarif.read_hints(spark, [str(tmp_path / "none.sarif")]).count() == 0


def test_search_sorts_no_texts(spark, monkeypatch):
    """What is scored and sorted for each query is ids; texts are looked up for the hits, rows that are the same or share an id included."""
    rows = [(i, "n", f"text {i}", [1.0, float(i)]) for i in range(20)] + [(3, "n", "text 3", [1.0, 3.0]), (3, "n", "other", [1.0, 3.0]), (None, "n", "none", [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, namespace string, text string, embedding array<float>")
    queries = spark.createDataFrame([(q, [1.0, float(q)], "n") for q in (1, 3)], "query_id int, q_embedding array<float>, namespace string")
    plans, written = [], retrieve.stored
    monkeypatch.setattr(retrieve, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    hits = retrieve.top_for_queries(vectors, queries, 4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hits if r["query_id"] == 3] == [(3, 1, 3, 1.0), (3, 2, 3, 1.0), (3, 3, 3, 1.0), (3, 4, 4, 0.997054)]
    assert sorted(r["text"] for r in hits if r["query_id"] == 3) == ["other", "text 3", "text 3", "text 4"]
    window = next(x for x in plans[0].splitlines() if "Window" in x)
    below = plans[0].split(window)[1].split("Join")[0]
    assert "text" not in below
    every = retrieve.top_for_queries(vectors, queries, 100)
    assert every.count() == 2 * len(rows) and every.where("vec_id is null").count() == 2
