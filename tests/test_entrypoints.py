"""Entry points by language, and the whole path from a source tree to a gated score."""

from pyspark.sql import functions as F

from tracewright.operators import entrypoints, findings, policy, ranking, verify
from tracewright.operators.findings import Rule

SCHEMA = "path string, language string, text string, tags array<string>"


def rows(spark, *data):
    return {(r["path"], r["line"], r["name"]): r for r in entrypoints.entry_points(spark.createDataFrame(list(data), SCHEMA)).collect()}


def test_lines_of_each_language(spark):
    got = rows(
        spark,
        ("a.js", "javascript", "app.get('/x', function list(a) {})\nrouter.use(r => featureFlag(r))\nfoo.get(1)\nprocess.argv[2]", []),
        ("b.c", "c", "int main(int a)\n  main(x)\nint LLVMFuzzerTestOneInput(x)\ndomain(x)", []),
        ("c.sol", "solidity", "function pay(uint a) public onlyOwner whenPaused {\nfunction see() public view {\nfunction onERC721(x) external {\nfunction go() internal {", []),
        ("d.py", "python", "if __name__ == '__main__':\n  p = argparse.ArgumentParser()", []),
    )
    assert set(got) == {("a.js", 1, "http_handler"), ("a.js", 2, "http_handler"), ("a.js", 4, "process.argv"), ("b.c", 1, "main"), ("b.c", 2, "main"), ("b.c", 3, "LLVMFuzzerTestOneInput"), ("c.sol", 1, "pay"), ("c.sol", 3, "onERC721"), ("d.py", 1, "__main__"), ("d.py", 2, "cli_parser")}
    assert got["a.js", 1, "http_handler"]["function_name"] == "list" and got["a.js", 2, "http_handler"]["function_name"] == "arrow_handler"
    assert len(got["a.js", 2, "http_handler"]["conditions"]) == 1
    assert got["c.sol", 1, "pay"]["access_level"] == "role-restricted" and got["c.sol", 1, "pay"]["conditions"] == ["whenPaused"]
    assert got["c.sol", 3, "onERC721"]["access_level"] == "contract-only/callback"


def test_python_routes_and_tags(spark):
    text = "@app.route('/x')\n@login_required\ndef show(a):\n    if beta_on(a):\n        pass\n\n    return a\n\nclass C:\n    @api.get('/y')\n    @require_role('admin')\n    @auth\n    async def two(self):\n        x\n    def three(self):\n        y\n"
    got = rows(spark, ("m.py", "python", text, ["parser", "syscall_entry"]), ("n", "unknown", None, []))
    show, two = got["m.py", 3, "show"], got["m.py", 13, "two"]
    assert (show["end_line"], show["access_level"], show["conditions"]) == (7, "authenticated", ["beta_on(a)"])
    assert (two["end_line"], two["access_level"]) == (14, "role-restricted")
    assert {k for k in got if k[1] is None} == {("m.py", None, "parser_input"), ("m.py", None, "local_privileged_boundary")}
    assert len(got) == 4


def test_from_source_to_score(spark):
    text = "@app.route('/run')\ndef run(q):\n    eval(q)\n\ndef other(q):\n    eval(q)\n"
    targets = spark.createDataFrame([("w.py", "python", text, ["network_entry"], 6, False)], SCHEMA + ", loc int, has_fuzz boolean")
    hinted = findings.attach_hints(targets, entrypoints.entry_points(targets))
    table = spark.createDataFrame([("CWE-95", "Code", 5, True, True)], "cwe string, category string, severity int, static boolean, dynamic boolean")
    matches = findings.find_matches(targets, [Rule("r-eval", r"\b(eval)\s*\(", ("python",), "CWE-95", ("syscall_entry",))])
    found = findings.in_report_order(findings.finding_rows(findings.with_reachability(matches, hinted.select("path", "hints")), ranking.heuristic_rank(hinted), table))
    got = [(r["finding_id"], r["reachability"], r["priority"], r["verdict"]) for r in verify.verified(found).orderBy("line").collect()]
    assert got == [("r-eval:w.py:3", "reachable", 2.2, "accepted"), ("r-eval:w.py:6", "unknown", 1.5, "rejected")]
    score = policy.score_gate(policy.project_score(policy.with_penalty(found, table))).first()
    assert score["penalty_total"] == 70.0 and score["hard_failure"] and score["score"] == 31
    assert verify.exit_status(verify.verified(found).where(F.col("line") == 6), "verified").first()[0] == 0
