"""Source files, ground truth and other tools' findings that follow from documents, and their SQL twins.

Each document becomes a file of one of five languages: a comment that looks like a finding, a line for each shipped rule of the
language, vulnerable or not by the document's number, and then the document's whole text as comments. Forty documents make a manifest.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.findings import SEVERITY_LABELS, find_matches, rationale
from tracewright.plans.frames import _QUOTED, table
from tracewright.rules import FOLDER, shipped_rules

LANGUAGES = (("c", ".c", "//"), ("python", ".py", "#"), ("javascript", ".js", "//"), ("java", ".java", "//"), ("groovy", ".tpl", "//"))
#: (rule, sink, a vulnerable line) by language; {v} is a name of the document's.
SNIPPETS = {
    "c": [("c-exec-family", "execlp", 'execlp("sh", "sh", {v}, NULL);'), ("c-shell-exec", "system", "system({v});"), ("c-unsafe-copy", "strcpy", "strcpy(out, {v});"), ("c-unsafe-format", "printf", "printf({v});"),
          ("c-unsafe-memory-copy", "memmove", "memmove(out, {v}, n);"), ("c-unsafe-scanf", "scanf", 'scanf("%s", {v});')],
    "python": [("python-flask-debug", "debug", "app.run({v}, debug=True)"), ("python-os-command", "os.system", "os.system({v})"), ("python-path-traversal", "open", "open(request.args[{v}])"),
               ("python-shell-true", "subprocess", "subprocess.run({v}, shell=True)"), ("python-sql-injection", "execute", 'db.execute("select " + {v})'), ("python-ssrf", "requests.get", "requests.get(request.args[{v}])"),
               ("python-ssti", "render_template_string", "render_template_string({v})"), ("python-unsafe-deserialization", "pickle.loads", "pickle.loads({v})"), ("python-unsafe-eval", "eval", "eval({v})"), ("python-weak-hash", "md5", "hashlib.md5({v})")],
    "javascript": [("js-command-exec", "execSync", "child.execSync({v});"), ("js-deserialize", "unserialize", "unserialize({v});"), ("js-dom-xss", "innerHTML", "el.innerHTML = req.{v};"), ("js-eval", "eval", "eval({v});"),
                   ("js-function-constructor", "Function", "new Function({v});"), ("js-path-traversal", "readFileSync", "fs.readFileSync(req.{v});"), ("js-spawn-shell", "spawn", "spawn({v}, { shell: true });"),
                   ("js-sql-injection", "query", 'db.query("select " + {v});'), ("js-ssrf", "axios", "axios.get(req.{v});"), ("js-weak-hash", "md5", 'createHash("md5").update({v});'), ("js-xss-response", "send", "res.send(req.query.{v});")],
    "java": [("java-command-exec", "exec", "Runtime.getRuntime().exec({v});"), ("java-deserialization", "readObject", "{v}.readObject();"), ("java-sql-injection", "select", 'String q = "select a from t where id=" + {v};'), ("java-weak-hash", "MD5", 'MessageDigest.getInstance("MD5").digest({v});')],
    "groovy": [("groovy-xss-unescaped", "yieldUnescaped", "yieldUnescaped {v}")],
}


def _by_language(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, key, path, language, v and the snippets of a document's file."""
    cwe = {r.rule_id: r.cwe for r in shipped_rules()}
    one = lambda r, s, line: F.struct(F.lit(r).alias("rule_id"), F.lit(cwe[r]).alias("cwe"), F.lit(s).alias("sink"), F.lit(line).alias("line"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select(
        "doc_id", "text", F.concat(F.lit("m"), F.expr("doc_id div 40").cast("string")).alias("key"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), _by_language([F.lit(x[1]) for x in LANGUAGES])).alias("path"),
        _by_language([F.lit(x[0]) for x in LANGUAGES]).alias("language"), _by_language([F.lit(x[2]) for x in LANGUAGES]).alias("mark"), F.concat(F.lit("v"), (F.col("doc_id") % 97).cast("string")).alias("v"),
        _by_language([F.array(*[one(*s) for s in SNIPPETS[x[0]]]) for x in LANGUAGES]).alias("snippets"),
    )


def _planted(i: Column) -> Column:
    return (F.expr("doc_id div 5") + i) % 3 != 0


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, doc_id, path, language, text)."""
    d = _docs(spark, sf_dir)
    lines = F.transform("snippets", lambda s, i: F.when(_planted(i), F.replace(s["line"], F.lit("{v}"), F.col("v"))).otherwise(F.concat(F.lit("x = "), "v")))
    head = F.concat("mark", F.lit(" "), F.element_at("snippets", 1)["line"])
    rest = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat("mark", F.lit(" "), x))
    return d.select("key", "doc_id", "path", "language", F.array_join(F.concat(F.array(head), lines, rest), "\n").alias("text"))


def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped rules' findings with key and f_ord, a number that goes by document, rule and line."""
    rules = shipped_rules()
    no = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.rule_id, i)])
    m = rationale(find_matches(code_files(spark, sf_dir), rules, carry=("key", "doc_id")))
    return m.withColumns({"finding_id": F.concat_ws(":", "rule_id", "path", F.col("line").cast("string")), "f_ord": F.col("doc_id") * 10000 + no[F.col("rule_id")] * 100 + F.col("line"), "tags": F.col("rule_tags")})


def code_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: most planted lines, some without their rule; some rows that nothing can match; pairs of equal wildcards."""
    rows = _docs(spark, sf_dir).select("doc_id", "key", "language", "path", "v", F.posexplode("snippets").alias("i", "s"))
    none = lambda kind="string": F.lit(None).cast(kind)
    planted = rows.where(_planted(F.col("i")) & ((F.col("doc_id") + F.col("i")) % 7 != 0)).select(
        "key", "language", (F.col("doc_id") * 100 + F.col("i")).alias("e_ord"), F.when(F.col("i") % 4 != 3, F.col("s.rule_id")).alias("rule_id"), (F.col("i") + 2).alias("line"), F.concat(F.lit("*"), "path").alias("path"), F.col("s.sink").alias("sink"),
        F.concat("s.sink", F.lit(" reaches "), "v").alias("evidence"), F.col("s.cwe").alias("cwe"), none().alias("function"),
    )
    docs = _docs(spark, sf_dir).select("doc_id", "key", "language", "path")
    other = lambda no, rule, line, sink: F.struct((F.col("doc_id") * 100 + no).alias("e_ord"), rule.alias("rule_id"), line.alias("line"), sink.alias("sink"))
    lost = F.when(F.col("doc_id") % 6 == 0, other(90, F.lit("no-such-rule"), F.lit(1), F.lit("nothing")))
    wild = [F.when(F.col("doc_id") % 4 == 0, other(n, none(), none("int"), none())) for n in (91, 92)]
    more = docs.select("key", "language", "path", F.explode(F.array_compact(F.array(lost, *wild))).alias("x")).select("key", "language", "x.e_ord", "x.rule_id", "x.line", "path", "x.sink", F.lit("").alias("evidence"), F.lit("CWE-1").alias("cwe"), none().alias("function"))
    return planted.unionByName(more)


def code_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tools: one finds every second document's, one doesn't name rules, one names no lines and sometimes another weakness."""
    f = code_findings(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    tool = lambda name, n, rule, line, cwe: f.where(F.col("doc_id") % n == 0).select(F.col("key").alias("manifest"), F.lit(name).alias("tool"), "f_ord", "path", line.alias("line"), rule.alias("rule_id"), cwe.alias("cwe"), F.concat_ws(" ", "token", F.lit("matched")).alias("evidence"))
    rows = tool("alpha", 2, F.col("rule_id"), F.col("line"), F.col("cwe")).unionByName(tool("beta", 3, none("string"), F.col("line"), none("string")))
    return rows.unionByName(tool("gamma", 5, F.col("rule_id"), none("int"), F.when(F.col("line") % 2 == 0, F.lower("cwe")).otherwise("CWE-0")))


def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, text, tags): Python files with decorators and signatures over several lines, a class, and the document's text as comments."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), F.concat(F.lit("v"), (F.col("doc_id") % 97).cast("string")).alias("v"))
    guard = F.element_at(F.array(F.lit("@login_required"), F.lit("@require_role('admin')"), F.lit("# none")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    lines = [
        F.lit("@app.route("), F.concat(F.lit("    '/"), "v", F.lit("',")), F.lit("    methods=['GET'],"), F.lit(")"), guard, F.concat(F.lit("def "), "v", F.lit("(")), F.lit("    a,"), F.lit("):"), F.lit('    """if feature:'), F.lit('    """'),
        F.concat(F.lit("    if feature_"), "v", F.lit("(a):")), F.lit("        return (a +"), F.lit("            1)"), F.lit("class K:"), F.lit("    @cli.command()"), F.concat(F.lit("    async def run_"), "v", F.lit("(self):")), F.lit("        if self.beta and \\"),
        F.lit("                self.x:"), F.lit("            pass"),
    ]
    rest = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("# "), F.regexp_replace(x, r"[\x00-\x1f\x7f]", " ")))
    return d.select("path", F.lit("python").alias("language"), F.array_join(F.concat(F.array(*lines), rest), "\n").alias("text"), F.expr("cast(array() as array<string>)").alias("tags"))


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each document with an array of findings behind it, one in four of them broken."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    array = F.concat(F.lit('[ {"line": '), n, F.lit(', "title": "T'), n, F.lit('", "cwe": "CWE-'), (F.col("doc_id") % 7).cast("string"), F.lit('"}, 5, '), F.when(F.col("doc_id") % 4 == 0, "oops").otherwise(""), F.lit(' {"line": "x", "rationale": "r"} ]'))
    return d.select(n.alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(" so: "), array, F.lit(" done")).alias("text"))


def ranking_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload_id, payload): a ranking per document and one more, some of them malformed."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    text = lambda c: c.cast("string")
    one = F.concat(F.lit('{"path": "p'), text(F.col("doc_id")), F.lit('", "surface": '), text(F.col("doc_id") % 7), F.lit(', "influence": '), F.when(F.col("doc_id") % 11 == 0, "true").otherwise("3"), F.lit(', "reachability": 2, "static_boosts": ["b", "a"]}'))
    whole = F.when(F.col("doc_id") % 13 == 0, '{"other": []}').when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).otherwise(F.concat(F.lit('{"rankings": ['), one, F.lit(', {"path": "", "surface": 1}]}')))
    return d.select(F.col("doc_id").alias("payload_id"), whole.alias("payload"))


# --- SQL twins ---------------------------------------------------------------------------------


def norm(x: str) -> str:
    return rf"trim(regexp_replace(translate(replace(replace(lower({x}), 'memcpy', 'memcpy memory copy'), 'copies', 'copy'), '-_', '  '), '\s+', ' ', 'g'))"


def _rule_sql(no: int, rule) -> str:
    token = f"unnest(regexp_extract_all(body, {_QUOTED(rule.pattern)}, {rule.token_group}))"
    token = token if rule.token_group else f"trim(split_part({token}, '(', 1))"
    tags = " ".join(rule.tags)
    return f"select key, doc_id, path, line, {no} as no, {_QUOTED(rule.rule_id)} as rule_id, {_QUOTED(rule.cwe)} as cwe, {_QUOTED(rule.title)} as title, {_QUOTED(tags)} as tags, {token} as token from placed where planted and language in ({', '.join(map(_QUOTED, rule.languages))})"


def _severities() -> dict[str, str]:
    """The severity of the shipped rules' weaknesses, from the shipped table's lines."""
    with open(os.path.join(FOLDER, "policy.tsv"), encoding="utf-8") as f:
        cells = [line.rstrip("\n").split("\t") for line in f]
    level = {f"CWE-{c[1]}": int(c[3]) for c in cells if len(c) > 4 and c[1].isdigit() and c[4] == "X"}
    return {r.cwe: SEVERITY_LABELS[level.get(r.cwe, 0)] for r in shipped_rules()}


SEVERITIES = _severities()
_LIST = lambda i: "[" + ", ".join(_QUOTED(x[i]) for x in LANGUAGES) + "][doc_id % 5 + 1]"
_CWE = {r.rule_id: r.cwe for r in shipped_rules()}
CODE = (
    "snips(language, i, rule_id, cwe, sink, vulnerable) as (values " + ", ".join(f"({_QUOTED(x)}, {i}, {_QUOTED(r)}, {_QUOTED(_CWE[r])}, {_QUOTED(s)}, {_QUOTED(line)})" for x, some in SNIPPETS.items() for i, (r, s, line) in enumerate(some)) + f"""),
 docs as (select doc_id, 'm' || (doc_id // 40) as key, {_LIST(0)} as language, source || '/' || doc_id || {_LIST(1)} as path, 'v' || (doc_id % 97) as v from documents),
 placed as (select d.*, s.i, s.rule_id as own_rule, s.cwe as own_cwe, s.sink, s.i + 2 as line, (d.doc_id // 5 + s.i) % 3 <> 0 as planted, replace(s.vulnerable, '{{v}}', d.v) as body from docs d join snips s using (language)),
 hits as (""" + " union all ".join(_rule_sql(i, r) for i, r in enumerate(shipped_rules())) + f"""),
 named as (select *, rule_id || ':' || path || ':' || line as finding_id, doc_id * 10000 + no * 100 + line as f_ord from hits),
 found as (select *, {norm("concat_ws(' ', finding_id, title, 'Static pattern ' || rule_id || ' (' || cwe || ') matched ' || token || ' on line ' || line || '; manual verification still required.', tags)")} as text from named),
 expected as (select key, language, doc_id * 100 + i as e_ord, case when i % 4 <> 3 then own_rule end as rule_id, line, path, sink, sink || ' reaches ' || v as evidence, own_cwe as cwe from placed where planted and (doc_id + i) % 7 <> 0
  union all select key, language, doc_id * 100 + 90, 'no-such-rule', 1, path, 'nothing', '', 'CWE-1' from docs where doc_id % 6 = 0
  union all select key, language, doc_id * 100 + n, null, null, path, null, '', 'CWE-1' from docs, (values (91), (92)) w(n) where doc_id % 4 = 0),
 pairs as (select e.key, e_ord, f_ord from expected e join found f on e.key = f.key and (e.line is null or e.line = f.line) and (e.rule_id is null or e.rule_id = f.rule_id) and contains(f.path, e.path) and (e.sink is null or contains(f.text, {norm("e.sink")}))
  and (len(list_filter(string_split({norm("e.evidence")}, ' '), lambda w: length(w) > 2)) = 0 or len(list_filter(string_split({norm("e.evidence")}, ' '), lambda w: length(w) > 2 and contains(f.text, w))) > 0))"""
)


def sequence(pairs: str = "pairs") -> str:
    """The rows of a recursive query in which, key by key, each row takes the first candidate that's left."""
    return f"""ranked as (select key, e_ord, row_number() over (partition by key order by e_ord) as i, list(distinct f_ord order by f_ord) as options from {pairs} group by key, e_ord),
 steps as (select key, 0::bigint as i, []::bigint[] as taken, null::bigint as e_ord, null::bigint as f_ord from (select distinct key from ranked)
  union all select key, i, case when f is null then taken else list_append(taken, f) end, e_ord, f from (select s.key, r.i, s.taken, r.e_ord, list_filter(r.options, lambda o: not list_contains(s.taken, o))[1] as f from steps s join ranked r on r.key = s.key and r.i = s.i + 1) n),
 matches as (select key, e_ord, f_ord from steps where f_ord is not null)"""


EVALUATED = "with recursive " + CODE + ", " + sequence()
