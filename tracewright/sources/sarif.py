"""SARIF: static hints from reports, and reports from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.scratch import path_exists

LEVELS = {"critical": "error", "high": "error", "medium": "warning"}
_RESULT = "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,partialFingerprints:map<string,string>,fingerprints:map<string,string>>"
_RULE = "struct<id:string,name:string,properties:map<string,string>>"
SCHEMA = f"version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<{_RULE}>>>,results:array<{_RESULT}>>>"
#: The lines that write_sarif() puts around results and rules, of which each has a line of its own: such a document is read by lines, in as many tasks as it has splits.
HEAD = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"results": ['
BETWEEN, RULES, TAIL = '], "tool": {"driver": {"name": ', ', "rules": [', ']}}}], "version": "2.1.0"}'


def _by_lines(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc, run, tool, r) of the results and (doc, run, no, rule) of the rules of documents of write_sarif()."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("doc"), F.lit(0).alias("run"), "value")

    def parsed(starts: str, schema: str) -> DataFrame:
        element = F.from_json(F.rtrim("value", F.lit(",")), schema)
        return lines.where(F.col("value").startswith(starts)).select("doc", "run", element.alias("r"))

    name = F.col("value").substr(F.lit(len(BETWEEN) + 1), F.length("value") - len(BETWEEN + RULES))
    tools = lines.where(F.col("value").startswith(BETWEEN)).select("doc", "run", F.from_json(F.concat(F.lit('{"name": '), name, F.lit("}")), "name string")["name"].alias("tool"))
    results = parsed('{"level":', _RESULT).join(F.broadcast(tools.distinct()), ["doc", "run"], "left")  # a row per document
    return results.select("doc", "run", "tool", "r"), parsed('{"id":', _RULE).select("doc", "run", F.lit(0).alias("no"), F.col("r").alias("rule"))


def _whole(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of any reports, of which Spark parses each in one task. What is spread leaves its run behind: a result's row doesn't carry all the others."""
    runs = reports.select("doc", F.posexplode("runs").alias("run", "of"))
    results = runs.select("doc", "run", F.col("of.tool.driver.name").alias("tool"), F.col("of.results").alias("results")).select("doc", "run", "tool", F.explode("results").alias("r"))
    rules = runs.select("doc", "run", F.col("of.tool.driver.rules").alias("rules")).select("doc", "run", F.posexplode("rules").alias("no", "rule"))
    return results, rules


def read_hints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line, rule_id, analyzer, title, severity, message, fingerprint) of all results of the reports.

    Leading dots and slashes of a path go. Severity: level error is high, warning medium; else a
    rule's security-severity from 7 on is high, any other, a number or not, medium, and without one it's low.
    Reports that aren't there are skipped. Analyzers of the families semgrep and codeql have these names, others their own with underscores, or sarif.
    """
    there = [p for p in paths if path_exists(spark, p)]
    own = [p for p in there if not spark.read.text(p).where(F.col("value") == HEAD).isEmpty()]
    rest = [p for p in there if p not in own]
    parts = [_by_lines(spark, own)] if own else []
    if rest or not own:
        reports = spark.read.schema(SCHEMA).option("multiLine", True).json(rest).withColumn("doc", F.col("_metadata.file_path")) if rest else spark.createDataFrame([], SCHEMA).withColumn("doc", F.lit(""))
        parts.append(_whole(reports))
    results, rules = (side[0] if len(side) == 1 else side[0].unionByName(side[1]) for side in zip(*parts))
    first_rules = rules.groupBy("doc", "run", F.col("rule.id").alias("rule_id")).agg(F.min_by("rule", "no").alias("rule"))
    rows = results.withColumn("rule_id", F.col("r.ruleId")).join(first_rules, ["doc", "run", "rule_id"], "left")
    rule = F.col("rule")
    place = F.try_element_at(F.col("r.locations"), F.lit(1))["physicalLocation"]
    security = F.try_element_at(rule["properties"], F.lit("security-severity")).try_cast("double")
    severity = F.when(F.col("r.level") == "error", "high").when(F.col("r.level") == "warning", "medium").when(security >= 7, "high").when(F.coalesce(F.map_contains_key(rule["properties"], "security-severity"), F.lit(False)), "medium").otherwise("low")
    low = F.lower(F.coalesce("tool", F.lit("")))
    analyzer = F.when(low.contains("semgrep"), "semgrep").when(low.contains("codeql"), "codeql").when(low == "", "sarif").otherwise(F.replace(low, F.lit(" "), F.lit("_")))
    first = lambda c: F.try_element_at(F.map_values(c), F.lit(1))
    hints = rows.select(
        F.regexp_replace(place["artifactLocation"]["uri"], "^[./]+", "").alias("path"), place["region"]["startLine"].alias("line"), "rule_id",
        analyzer.alias("analyzer"), F.coalesce(rule["name"], "rule_id").alias("title"), severity.alias("severity"),
        F.col("r.message.text").alias("message"), F.coalesce(first("r.partialFingerprints"), first("r.fingerprints")).alias("fingerprint"),
    )
    return hints.where("path is not null").orderBy("path", F.coalesce("line", F.lit(0)), "rule_id")


def level_of(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), severity), F.lit("note"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Findings as the rows of a SARIF results array."""
    region = F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region"))
    return findings.select(F.col("rule_id").alias("ruleId"), level_of(F.col("severity")).alias("level"), F.struct(F.concat_ws(" ", "rule_id", F.lit("matched"), "token").alias("text")).alias("message"), F.array(F.struct(region.alias("physicalLocation"))).alias("locations"), F.create_map(F.lit("findingId"), "finding_id").alias("partialFingerprints"))


def write_results(findings: DataFrame, path: str) -> None:
    """Results as JSON lines, one part per task; a report's `results` are their concatenation."""
    sarif_results(findings).write.mode("overwrite").json(path)


# What an analyzer's hint asks for.
TASKS = {
    "semgrep": ("pattern_variant_review", "Use Semgrep evidence to check variants and rule precision before verifier promotion."),
    "codeql": ("source_sink_sanitizer_path_review", "Use CodeQL evidence to inspect source, sink, sanitizer, and path explanation."),
}


def provenance(hints: DataFrame) -> Column:
    return F.concat(F.lit("sarif:"), "analyzer", F.lit(":"), "rule_id")


def evidence_candidates(hints: DataFrame, path: str | None = None) -> DataFrame:
    """(source, rule_id, path, line, severity, message, provenance) of hints, of one path if it's given."""
    rows = hints if path is None else hints.where(F.col("path") == path)
    return rows.select(F.col("analyzer").alias("source"), "rule_id", "path", "line", "severity", F.coalesce("message", "rule_id").alias("message"), provenance(rows).alias("provenance"))


def mapping_tasks(hints: DataFrame) -> DataFrame:
    """(kind, path, rule_id, task, rationale): what the hints of the analyzers in TASKS ask for."""
    kind = F.col("analyzer")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in TASKS.items() for x in (k, v[i])]), kind)
    return hints.where(kind.isin(*TASKS)).select(kind.alias("kind"), "path", "rule_id", pick(0).alias("task"), pick(1).alias("rationale"))
