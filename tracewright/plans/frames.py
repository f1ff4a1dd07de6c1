"""Frames over the driver's tables that the registered queries share, and their SQL twins.

documents are files (path source/doc_id, language lang), pages are web files, and the line ranges
of `entry_points` follow from a document's size, so that all three reachability outcomes occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import TAG_TOKENS, lines_of_code, tags_of
from tracewright.operators.findings import Rule, find_matches, finding_rows, with_reachability
from tracewright.operators.ranking import heuristic_rank
from tracewright.operators.verify import judged, verified

RULES = [
    Rule("text-token-assign", r'token = "([^"]*)"', (), "CWE-798", ("credential",)),
    Rule("text-email", r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)", (), "CWE-359", ("personal",)),
    Rule("text-dotted-quad", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", (), "CWE-200", ("network_entry",), status="shadow"),
    Rule("text-licence", r"(Licensed|License)", ("en", "fr", "de"), "CWE-1104", ("legal",)),
    Rule("text-shouting", r"([A-Z]{12,}!!)", ("en", "es"), "CWE-9999", ("noise",)),
    Rule("text-unused", r"(the)", (), "CWE-1", ("noise",), status="disabled"),
]
POLICY = [("CWE-798", "Credentials", 5, True, True), ("CWE-359", "Privacy", 4, True, False), ("CWE-200", "Exposure", 2, True, True), ("CWE-1104", "Upkeep", 3, False, True), ("CWE-79", "Injection", 3, True, True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), "text", "n_chars", "doc_id", "source")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("path", "language", lines_of_code(F.col("text")).alias("loc"), tags_of(F.col("path"), F.col("language"), F.col("text")).alias("tags"))


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("path", "language", "n_chars").where("n_chars % 3 <> 2")
    placed = F.col("n_chars") % 3 == 0
    return f.select(
        "path", F.when(placed, 1).alias("line"), F.when(placed & (F.col("n_chars") % 2 == 0), 2).alias("end_line"), F.when(placed, "intro").alias("function_name"), F.lit("route").alias("kind"),
        F.when(F.col("language") == "en", "public").when(F.col("language") == "fr", "authenticated").otherwise("role-restricted").alias("access_level"), F.array(F.concat(F.lit("lang:"), "language")).alias("conditions"),
    )


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "cwe string, category string, severity int, static boolean, dynamic boolean")


def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with size, tags and the entry points of entry_points() as an array, in one projection."""
    placed = F.col("n_chars") % 3 == 0
    access = F.when(F.col("language") == "en", "public").when(F.col("language") == "fr", "authenticated").otherwise("role-restricted")
    hint = F.struct(
        F.when(placed, 1).alias("line"), F.when(placed & (F.col("n_chars") % 2 == 0), 2).alias("end_line"), F.when(placed, "intro").alias("function_name"), F.lit("route").alias("kind"),
        access.alias("access_level"), F.array(F.concat(F.lit("lang:"), "language")).alias("conditions"),
    )
    hints = F.when(F.col("n_chars") % 3 != 2, F.array(hint)).otherwise(F.filter(F.array(hint), lambda _: F.lit(False)))
    return files(spark, sf_dir).select("path", "language", "text", lines_of_code(F.col("text")).alias("loc"), tags_of(F.col("path"), F.col("language"), F.col("text")).alias("tags"), hints.alias("hints"))


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristic_rank(hinted(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str, rules: list[Rule] = RULES) -> DataFrame:
    """One scan: what a file's row tells of its entry points and rank goes along with its matches."""
    ranked = heuristic_rank(hinted(spark, sf_dir), ("language", "text", "hints"))
    return finding_rows(with_reachability(find_matches(ranked, rules, carry=("hints", "priority", "tags"))), None, policy(spark))


def verified_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(findings(spark, sf_dir))


def judged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified findings of which three in four lines went to a judge, who may disagree."""
    label = F.element_at(F.array(F.lit("unsupported"), F.lit("plausible"), F.lit("refused"), F.lit(None)), (F.col("line") % 4 + 1).cast("int"))
    own = judged(label, F.col("line") % 10 / 10)
    return verified_findings(spark, sf_dir).withColumn("verdict", F.when(label.isNotNull(), own).otherwise(F.col("verdict")))


# --- SQL twins ---------------------------------------------------------------------------------

_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"


def _rule_sql(rule: Rule) -> str:
    scope = "true" if not rule.languages else f"language in ({', '.join(map(_QUOTED, rule.languages))})"
    return f"select path, language, {_QUOTED(rule.rule_id)} as rule_id, no as line, unnest(regexp_extract_all(body, {_QUOTED(rule.pattern)}, 1)) as token, {_QUOTED(rule.cwe)} as cwe, {_QUOTED(rule.status)} as status, [{', '.join(map(_QUOTED, rule.tags))}] as rule_tags from lines where {scope} and not contains(body, '//') and not regexp_matches(ltrim(body), '^(/\\*|\\*)')"


FILES = "files as (select source || '/' || doc_id as path, lang as language, coalesce(text, '') as text, n_chars, doc_id, source from documents)"
LINES = FILES + ", cut as (select path, language, string_split(text, chr(10)) as parts from files), lines as (select path, language, unnest(parts) as body, generate_subscripts(parts, 1) as no from cut)"
MATCHES = LINES + ", matches as (" + " union all ".join(_rule_sql(r) for r in RULES if r.status != "disabled") + ")"
TAGS = "list_sort(list_filter([case when language in ('c', 'cpp') then 'memory_unsafe' end, " + ", ".join(f"case when {' or '.join(f'contains(hay, {_QUOTED(t)})' for t in tokens)} then {_QUOTED(tag)} end" for tag, tokens in TAG_TOKENS.items()) + "], lambda x: x is not null))"
TARGETS = FILES + f", hays as (select *, lower(path || chr(10) || text) as hay from files), targets as (select path, language, source, doc_id, n_chars, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) as loc, {TAGS} as tags from hays)"
POINTS = """points as (select path, case when n_chars % 3 = 0 then 1 end as line, case when n_chars % 6 = 0 then 2 end as end_line, case when n_chars % 3 = 0 then 'intro' end as function_name,
 case when language = 'en' then 'public' when language = 'fr' then 'authenticated' else 'role-restricted' end as access_level, 'lang:' || language as condition from files where n_chars % 3 <> 2)"""
_HAS = lambda *names: "(" + " or ".join(f"list_contains(tags, '{n}')" for n in names) + ")"
RANKED = f"""marks as (select t.*, coalesce(case access_level when 'public' then 5 when 'authenticated' then 4 when 'role-restricted' then 3 end, 0) as entry from targets t left join points p using (path)),
ranked as (select path, language, tags, doc_id,
 greatest(1, case when {_HAS("memory_unsafe", "auth_boundary", "syscall_entry", "filesystem_entry")} then 3 else 1 end, case when {_HAS("parser", "deserialization")} then 4 else 1 end, case when {_HAS("fuzzable")} then 5 else 1 end) as surface,
 greatest(case when {_HAS("crypto")} then 4 else 1 end, case when loc >= 500 then 3 else 1 end) as influence,
 greatest(case when {_HAS("parser", "deserialization", "auth_boundary")} then 3 else 1 end, case when {_HAS("network_entry", "fuzzable")} then 4 else 1 end, entry) as reachability,
 list_sort(list_filter([case when {_HAS("memory_unsafe")} then 'memory_unsafe' end, case when {_HAS("parser", "deserialization")} then 'input_parser' end, case when {_HAS("network_entry")} then 'network_entry' end,
  case when {_HAS("auth_boundary")} then 'auth_boundary' end, case when {_HAS("crypto")} then 'crypto' end, case when {_HAS("syscall_entry", "filesystem_entry")} then 'privileged_boundary' end,
  case when {_HAS("fuzzable")} then 'fuzzable' end, case when loc >= 500 then 'large_file' end, case when entry > 0 then 'entry_point_reachable' end], lambda x: x is not null)) as boosts from marks),
rankings as (select *, round(surface * 0.5 + influence * 0.2 + reachability * 0.3, 2) as priority from ranked)"""
POLICY_SQL = "policy(cwe, category, severity, static, dynamic) as (values " + ", ".join(f"('{c}', '{k}', {s}, {str(a).lower()}, {str(d).lower()})" for c, k, s, a, d in POLICY) + ")"
REACHED = """reached as (select m.*, case when p.line <= m.line and m.line <= coalesce(p.end_line, p.line) then 'reachable' when p.path is not null and p.line is null then 'inferred-file-surface' else 'unknown' end as reachability,
 case when p.line <= m.line and m.line <= coalesce(p.end_line, p.line) then p.function_name end as function_name, case when (p.line <= m.line and m.line <= coalesce(p.end_line, p.line)) or (p.path is not null and p.line is null) then p.condition else '' end as conditions from matches m left join points p using (path))"""
FINDINGS = (
    "with " + MATCHES + ", " + TARGETS.removeprefix(FILES + ", ") + ", " + POINTS + ", " + RANKED + ", " + POLICY_SQL + ", " + REACHED
    + """, findings as (select rule_id || ':' || r.path || ':' || line as finding_id, rule_id, r.path, line, token, r.cwe,
 case when static then case severity when 5 then 'critical' when 4 then 'high' when 3 then 'medium' when 2 then 'low' when 1 then 'low' else 'info' end else 'info' end as severity,
 r.reachability, function_name, conditions, case when r.reachability = 'unknown' then least(priority, 1.5) else priority end as priority, list_sort(list_distinct(list_concat(k.tags, rule_tags))) as tags, status,
 p.severity as p_severity, static, dynamic from reached r left join rankings k on r.path = k.path left join policy p on r.cwe = p.cwe),
verified as (select *, case when reachability = 'unknown' then 'rejected' else 'accepted' end as verdict from findings)"""
)
LEARNINGS = FINDINGS + """, judged as (select * exclude (verdict), case line % 4 when 0 then 'rejected' when 1 then case when (line % 10) / 10.0 >= 0.6 then 'accepted' else 'needs_evidence' end when 2 then 'rejected' else verdict end as verdict from verified),
learnings as (select distinct finding_id, path, coalesce(tags[1], 'unknown') as vulnerability_class, case when reachability = 'unknown' then 'unreachable_path' when verdict = 'needs_evidence' then 'unverified' else 'contradicted' end as reason, verdict as evidence,
 regexp_extract(path, '^(.*)/[^/]*$', 1) || ':' || coalesce(tags[1], 'unknown') as scope, 0.5 as demotion from judged where verdict <> 'accepted')"""
