"""The finding, ranking, policy, feedback and evaluation operators on small frames: one case per trap."""

import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions.text import chunk_id, clean_text, language_of, lines_of_code, normalised, redacted, tags_of
from tracewright.functions.vectors import cosine
from tracewright.operators import evaluate, feedback, findings, policy, ranking, retrieve, verify
from tracewright.operators.findings import Rule

TARGETS = "path string, language string, text string"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


def test_match_spans_newlines_and_ids_collide(spark):
    text = "a eval\n(x); eval(1) eval(2)\n# eval(3)\nx = 1 # eval(4)\nsubprocess.run(y, shell=True)"
    rules = [Rule("r-eval", r"\b(eval)\s*\("), Rule("r-sub", r"subprocess\.[a-z]+\s*\([^\n]*shell\s*=\s*True", token_group=0), Rule("r-off", "eval", status="disabled"), Rule("r-c", "eval", ("c",))]
    rows = findings.find_matches(spark.createDataFrame([("p.py", "python", text), ("q.py", "python", None)], TARGETS), rules).orderBy("rule_id", "ord").collect()
    assert [(r["rule_id"], r["line"], r["token"], r["offset"]) for r in rows] == [("r-eval", 1, "eval", 2), ("r-eval", 2, "eval", 12), ("r-eval", 2, "eval", 20), ("r-sub", 5, "subprocess.run", text.index("subprocess"))]


def test_comments_of_slash_languages(spark):
    text = "// f(1)\n  * f(2)\nx /* f(3)\nu = 'http://a' + f(4)\nf(5) // f(6)"
    rows = findings.find_matches(spark.createDataFrame([("a.c", "c", text)], TARGETS), [Rule("r", r"(f)\(")]).collect()
    assert sorted(r["line"] for r in rows) == [3, 5]


@pytest.mark.parametrize("pattern", [r"\b(ab)", r"(a)[^\n]*b", r"([0-9]+)", r"(a|b)+c"])
def test_places_equal_python_finditer(spark, pattern):
    text = "ab a1b22\n\nabc bbc aac é ab\n 9 ab12"
    rows = findings.find_matches(spark.createDataFrame([("a", "x", text)], TARGETS), [Rule("r", pattern)]).orderBy("ord").collect()
    want = [(m.start(), text.count("\n", 0, m.start()) + 1, m[1]) for m in re.finditer(pattern, text)]
    assert [(r["offset"], r["line"], r["token"]) for r in rows] == want


HINT = "path string, line int, end_line int, function_name string, kind string, access_level string, conditions array<string>"


def test_reachability_precedence(spark):
    hints = spark.createDataFrame([("a", 1, 2, "", "route", "public", ["z"]), ("a", 2, None, "f", "route", "public", ["b", "a"]), ("a", None, None, "g", "cli", "local-only", ["n"]), ("b", None, None, None, "cli", "local-only", ["n"]), ("c", 9, None, "h", "cli", "local-only", None)], HINT)
    paths = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    matches = spark.createDataFrame([("a", 2), ("a", 3), ("b", 7), ("c", 9), ("c", 1), ("d", 1)], "path string, line int")
    got = {(r["path"], r["line"]): (r["reachability"], r["function_name"], r["conditions"]) for r in findings.with_reachability(matches, findings.attach_hints(paths, hints)).collect()}
    assert got == {("a", 2): ("reachable", "f", ["a", "b", "z"]), ("a", 3): ("unknown", None, []), ("b", 7): ("inferred-file-surface", None, ["n"]), ("c", 9): ("reachable", "h", []), ("c", 1): ("unknown", None, []), ("d", 1): ("unknown", None, [])}


def test_ranking_scores_and_tiers(spark):
    rows = spark.createDataFrame([("a", ["parser", "network_entry"], 10, False), ("b", [], 600, False), ("c", ["memory_unsafe"], 1, True), ("d", [], 1, False)], "path string, tags array<string>, loc int, has_fuzz boolean")
    got = {r["path"]: (r["surface"], r["influence"], r["reachability"], r["priority"]) for r in ranking.heuristic_rank(rows).collect()}
    assert got == {"a": (4, 1, 4, 3.4), "b": (1, 3, 1, 1.4), "c": (5, 1, 4, 3.9), "d": (1, 1, 1, 1.0)}
    plan = ranking.schedule(ranking.heuristic_rank(rows), rows, {"A": 1, "B": 1, "C": 5}).collect()
    assert sorted((r["tier"], r["path"]) for r in plan) == [("A", "c"), ("C", "b"), ("C", "d")]
    merged = ranking.merge_rankings(ranking.heuristic_rank(rows), spark.createDataFrame([("d", 2, 7, 1, ["m"])], "path string, surface int, influence int, reachability int, boosts array<string>"))
    assert {r["path"]: (r["influence"], r["priority"], r["boosts"]) for r in merged.collect()}["d"] == (7, 2.3, ["m"])


def test_policy_table_penalty_and_score(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("cat\tid\tname\tsev\ts\td\nA\t 89 \tSQL\t5\tX\t\nB\tx1\tbad\t3\tX\t\nC\t16\tConf\t9\t\tx\nD\t89\tSQL again\t4\tx\tX\nE\t7\n")
    table = policy.load_policy(spark, str(tmp_path / "p.tsv"))
    assert {r["cwe"]: (r["category"], r["severity"], r["static"], r["dynamic"]) for r in table.collect()} == {"CWE-89": ("D", 4, True, True), "CWE-16": ("C", 5, False, True)}
    rows = spark.createDataFrame([("f1", "CWE-89", "reachable"), ("f2", "CWE-89", "unknown"), ("f3", "CWE-16", "reachable"), ("f4", "", "reachable")], "finding_id string, cwe string, reachability string")
    over = spark.createDataFrame([("f2", 0.16), ("f2", 0.16)], "finding_id string, factor double")
    scored = policy.with_penalty(rows, table, over)
    assert {r["finding_id"]: r["penalty"] for r in scored.collect()} == {"f1": 25.0, "f2": 4.0, "f3": 0.0, "f4": 0.0}
    r = policy.score_gate(policy.project_score(scored), blocking=True).first()
    assert (r["score"], r["max_severity"], r["dynamic_only"], r["unmapped"], r["passed"]) == (62, 4, 1, ["unknown"], False)
    assert policy.score_gate(policy.project_score(scored)).first()["passed"]  # a report-only gate doesn't fail for the score
    scores = policy.project_score(spark.createDataFrame([("CWE-89", "unknown")], "cwe string, reachability string").transform(lambda f: policy.with_penalty(f, table)))
    far, near = (policy.score_gate(x, hard_severity=4).first() for x in (scores, policy.project_score(scored)))
    assert (far["max_severity"], far["max_reachable_severity"], far["hard_failure"], far["passed"]) == (4, 0, False, True)  # severe, but unreached
    assert near["hard_failure"] and not near["passed"]
    assert policy.project_score(scored.where("false")).first()["score"] == 100
    rules = spark.createDataFrame([("r1", "CWE-89", "enabled"), ("r2", "CWE-1", "enabled"), ("r3", "CWE-2", "shadow")], "rule_id string, cwe string, status string")
    with pytest.raises(policy.PolicyError, match="r2"):
        policy.assert_resolved(rules, table)
    assert one(spark, "50.0", lambda v: policy.decayed_score(v.cast("double"))) == 43


def test_verification_triggers_and_decisions(spark):
    rows = spark.createDataFrame([("a", "reachable", "critical", "static_corroboration"), ("b", "unknown", "high", "static_corroboration"), ("c", "reachable", "high", "suspicion"), ("d", "inferred-file-surface", "low", "crash_reproduced")], "finding_id string, reachability string, severity string, evidence_level string")
    got = {r["finding_id"]: (r["verdict"], r["triggers"], r["decision"], r["panel_a"]["disposition"], r["panel_b"]["disposition"]) for r in verify.fused(verify.fusion_triggers(verify.verified(rows))).collect()}
    assert got["a"] == ("accepted", ["gates_risky_fix", "severity:critical"], "accepted", "accepted", "accepted")
    assert got["b"] == ("rejected", ["severity:high"], "rejected", "deferred", "rejected")
    assert got["c"] == ("needs_evidence", ["gates_risky_fix", "severity:high", "verifier_disagreement"], "blocked", "blocked", "deferred")
    assert got["d"] == ("accepted", [], "deferred", "deferred", "rejected")
    assert [verify.exit_status(verify.verified(rows.where("finding_id = 'b'")), p).first()[0] for p in ("never", "findings", "verified")] == [0, 1, 0]
    steps = verify.transitions(spark.createDataFrame([("x", 1, 0), ("x", 2, 1), ("x", 3, 3), ("x", 4, 2), ("x", 5, 2)], "k string, t int, level int"), "k", "t", "level").orderBy("t")
    assert [r["allowed"] for r in steps.collect()] == [True, True, False, False, True]


def test_calibration_scopes_and_ledger(spark):
    ranks = spark.createDataFrame([("a/b/x", 3.0), ("a/bc/y", 2.0), ("top", 0.3), ("a/b/c/z", 0.4)], "path string, priority double")
    ledger = spark.createDataFrame([("i1", "a/b/x", "t", "unreachable", "a/b:t", 0.5), ("i2", "a/b/q", "t", "unreachable", "a/b:t", 0.5), ("i3", "top", "u", "unreachable", "top:u", 0.5), ("i4", "z", "t", "unreachable", "a/bc", 0.5), ("i5", "z", "t", "unreachable", ".:t", 0.5)], "finding_id string, path string, vulnerability_class string, reason string, scope string, demotion double")
    got = {r["path"]: (r["calibrated"], r["learnings"]) for r in feedback.calibrated(ranks, ledger).collect()}
    assert got == {"a/b/x": (2.0, 2), "a/bc/y": (2.0, 0), "top": (0.1, 1), "a/b/c/z": (0.1, 2)}
    rows = spark.createDataFrame([("f1", "a/b/k", ["t"], "reachable"), ("f2", "a/b/k", ["v"], "reachable"), ("f3", "top", ["u", "t"], "unknown"), ("f3", "top", ["u"], "unknown")], "finding_id string, path string, tags array<string>, reachability string")
    assert {tuple(r) for r in feedback.reachability_overrides(rows, ledger).collect()} == {("f1", 0.4), ("f3", 0.16)}
    merged = feedback.merged_ledger(ledger.select("finding_id", "reason"), spark.createDataFrame([("i2", "mitigated"), ("i9", "duplicate")], "finding_id string, reason string"))
    assert {tuple(r) for r in merged.collect()} == {("i1", "unreachable"), ("i2", "mitigated"), ("i3", "unreachable"), ("i4", "unreachable"), ("i5", "unreachable"), ("i9", "duplicate")}
    row = feedback.calibrated(ranks, ledger).where("path = 'a/b/x'").first()
    assert (row["learning_ids"], row["adjustments"]) == (["i1", "i2"], {"t": "a/b:t"}) and row["constraints"][0] == "Do not repeat unsupported t claim for scope a/b:t without new evidence."
    fields = "finding_id string, path string, tags array<string>, title string, reachability string, verdict string, counter_case string, required_next_step string"
    seen = spark.createDataFrame([("g1", "auth/s.py", ["syscall_entry"], "T", "reachable", "rejected", "constant input", "show a source"), ("g2", "main.py", [], "Some Title", "reachable", "needs_evidence", "", ""), ("g3", "a/m.py", ["x"], "T", "unknown", "rejected", "", "next"), ("g4", "a/m.py", ["x"], "T", "reachable", "accepted", "", "")], fields)
    learned = {r["finding_id"]: (r["scope"], r["reason"], r["evidence"]) for r in feedback.learnings(seen).collect()}
    assert learned == {"g1": ("auth:syscall_entry", "contradicted", "constant input show a source"), "g2": ("main.py:some_title", "unverified", ""), "g3": ("a:x", "unreachable_path", "next")}
    outcomes = spark.createDataFrame([("h1", "a/m.py", ["x"], "rejected", "why"), ("h2", "a/m.py", ["x"], "verified", None), ("h3", "a/m.py", ["x"], "duplicate", "same")], "finding_id string, path string, tags array<string>, outcome string, evidence string")
    assert {r["finding_id"]: r["reason"] for r in feedback.outcome_learnings(outcomes).collect()} == {"h1": "incorrect_model_assumption", "h3": "duplicate"}
    for bad in (("h4", "p", ["x"], "odd", "why"), ("h5", "p", ["x"], "rejected", " ")):
        with pytest.raises(Exception, match="unsupported finding outcome|needs evidence"):
            feedback.outcome_learnings(spark.createDataFrame([bad], outcomes.schema)).collect()


def test_greedy_matching_is_one_to_one_in_order(spark):
    expected = spark.createDataFrame([("m", 0, None, 5, "*a.py*", None, None, ""), ("m", 1, None, None, "a.py", None, "eval", "bad call"), ("m", 2, "r2", None, "a.py", None, None, "x"), ("n", 0, None, None, "a.py", None, None, "")], "key string, e_ord int, rule_id string, line int, path string, function string, sink string, evidence string")
    rows = spark.createDataFrame([("m", 0, "r1", 5, "s/a.py", None, "eval call here"), ("m", 1, "r1", 6, "s/a.py", None, "eval call there"), ("n", 0, "r1", 1, "s/b.py", None, "")], "key string, f_ord int, rule_id string, line int, path string, function string, text string")
    matches = evaluate.greedy_one_to_one(evaluate.expected_matches(expected, rows))
    assert sorted(tuple(r) for r in matches.collect()) == [("m", 0, 0), ("m", 1, 1)]
    assert sorted((r["key"], r["e_ord"]) for r in evaluate.misses(expected, matches).collect()) == [("m", 2), ("n", 0)]
    assert [(r["key"], r["f_ord"]) for r in evaluate.false_positives(rows, matches).collect()] == [("n", 0)]
    gate = evaluate.detection_gate(evaluate.detection_rollup(spark.createDataFrame([("c", 10, 9, 9, 0), ("py", 0, 0, 0, 0), ("js", 10, 10, 11, 2)], "lang string, expected long, matched long, actual long, false_positives long"), "lang"))
    assert {r["lang"]: (r["recall"], r["passed"]) for r in gate.collect()} == {"c": (0.9, True), "py": (1.0, True), "js": (1.0, False), None: (0.95, False)}


def test_retrieval_cosine_budget_chunks_and_routes(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [2.0, 0.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in retrieve.top_by_cosine(v, [3.0, 0.0], 4).collect()] == [(1, 1.0), (4, 1.0), (2, 0.0), (3, 0.0)]
    assert v.select(cosine(F.col("embedding"), F.array(F.lit(0.0), F.lit(0.0)))).distinct().first()[0] == 0.0
    blocks = spark.createDataFrame([(i, s) for i, s in enumerate((4, 5, 9, 1))], "i int, size int")
    assert [r["i"] for r in retrieve.within_budget(blocks, 12, F.col("size"), [F.col("i")]).collect()] == [0, 1]
    c = retrieve.chunks(spark.createDataFrame([("p", "a\nb\n\n\nc"), ("q", None)], "path string, text string"), 2).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"], r["text"]) for r in c] == [(1, 2, "a\nb"), (5, 5, "c")]
    assert c[0]["chunk_id"] == spark.range(1).select(chunk_id(F.lit("p"), F.lit(1), F.lit(2), F.lit("a\nb"))).first()[0]
    t = spark.createDataFrame([("x", "en", ["a", "b"], ["k"]), ("y", "en", [], [])], "path string, language string, tags array<string>, classes array<string>")
    s = spark.createDataFrame([("s1", "en", ["a"], []), ("s2", None, ["z"], ["k"]), ("s3", "en", ["z"], ["z"])], "skill_id string, language string, tags array<string>, classes array<string>")
    assert [(r["path"], r["skill_id"], r["score"]) for r in retrieve.routed(t, s).orderBy("place").collect()] == [("x", "s1", 4), ("x", "s2", 2)]


def test_text_functions(spark):
    assert one(spark, "a\n \n\tb\n ", lines_of_code) == 2
    assert one(spark, "/x/Main.HPP", lambda v: language_of(v, F.lit(None).cast("string"))) == "cpp"
    assert one(spark, "#!/usr/bin/env python3\n", lambda v: language_of(F.lit("bin/tool"), v)) == "python"
    assert one(spark, "call popen", lambda v: tags_of(F.lit("src/parser/x.c"), F.lit("c"), v)) == ["memory_unsafe", "parser", "syscall_entry"]
    assert one(spark, "Mem-cpy  memcpy_two copies", normalised) == "mem cpy memcpy memory copy two copy"
    assert spark.range(1).select(clean_text(F.unhex(F.lit("61ff620d0a63")))).first()[0] == "ab\nc"
    for text in ('api_key = "abcdefgh12"', "Bearer abcdefghijklmnop", "sk-abcdefghijklmnopqrst", "https://u:secretpw@host/x", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"):
        masked = one(spark, text, redacted)
        assert "***REDACTED***" in masked and one(spark, masked, redacted) == masked
    assert one(spark, "token = 'abcdefgh\"", redacted) == "token = 'abcdefgh\""


def test_judges_and_first_rows(spark):
    rows = spark.createDataFrame([("plausible", 0.6), ("plausible", 0.5), ("unsupported", 0.9), ("refused", 0.1), ("other", 1.0)], "label string, confidence double")
    assert [r[0] for r in rows.select(verify.judged(F.col("label"), F.col("confidence"))).collect()] == ["accepted", "needs_evidence", "rejected", "rejected", "needs_evidence"]
    first = feedback.first_per_key(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int"), ["k"], [F.col("n")])
    assert {tuple(r) for r in first.collect()} == {("a", 1), ("b", 3)}


def test_calibration_joins_sums_of_directories(spark):
    """Of 200 paths and 300 learnings of one directory no join makes a row per pair; repeated rows of the ledger count once."""
    ranks = spark.createDataFrame([(f"d/e/{i}", 2.0) for i in range(200)] + [("x", 2.0), ("x", 1.0)], "path string, priority double")
    rows = [(f"i{i:03}", f"d/e/{i}", "c", "d/e:c" if i % 2 else "d:c", 0.5 / 256) for i in range(300)]
    rows += [rows[0], ("own", "d/e/7", "c", "elsewhere:c", 0.25), ("bare", "d/e/7", "c", "no colon", None), ("x", "x", "c", "x:c", 0.5)]
    ledger = spark.createDataFrame(rows, "finding_id string, path string, vulnerability_class string, scope string, demotion double")
    found = feedback.calibrated(ranks, ledger)
    got = {(r["path"], r["priority"]): (r["demotion"], r["calibrated"], r["learnings"], len(set(r["learning_ids"]))) for r in found.collect()}
    assert len(got) == 202 and got["x", 2.0] == (0.5, 1.5, 1, 1) and got["x", 1.0] == (0.5, 0.5, 1, 1)
    assert got["d/e/7", 2.0] == (300 / 512 + 0.25, 1.16, 302, 302) and got["d/e/8", 2.0] == (300 / 512, 1.41, 300, 300)
    plan = found.select("path", "learnings")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" in plan
    made = found.select("path", "learnings", "demotion")
    made.collect()
    assert max(_rows_out(made._jdf.queryExecution().executedPlan())) < 2000


def _rows_out(plan) -> list[int]:
    """The rows that each node of an executed plan has made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _rows_out(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _rows_out(plan.plan())
    rows = [plan.metrics().apply("numOutputRows").value()] if plan.metrics().contains("numOutputRows") else [0]
    kids = plan.children()
    return rows + [n for i in range(kids.size()) for n in _rows_out(kids.apply(i))]
