"""Sources and sinks: source trees, rule files, ledgers, ground truth, vector tables, redacted reports."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import clean_text, language_of, lines_of_code, tags_of
from tracewright.operators.findings import STATUSES, Rule
from tracewright.sources.scratch import path_exists

# Directories that are never scanned.
IGNORED_DIRECTORIES = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv")


class SourceError(ValueError):
    """A rule, ledger or manifest that can't be used."""


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: no blanks, comments or negations; a trailing slash goes."""
    lines = (x.strip() for x in text.splitlines())
    return [x.rstrip("/") for x in lines if x and x[0] not in "#!"]


def is_ignored(path: Column, patterns: list[str]) -> Column:
    parts = F.split(path, "/")
    ignored = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    name = F.element_at(parts, -1)
    return reduce(lambda a, b: a | b, (path.rlike(f"^{p}$") | name.rlike(f"^{p}$") for p in (re.sub(r"^\(\?s:(.*)\)(\\Z|\\z)$", r"(?s:\1)", fnmatch.translate(x)) for x in patterns)), ignored)


def read_tree(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, text, language, loc, tags, has_fuzz) of the tree's source files, as one lazy scan.

    Ignored paths go before contents are decoded; files of unknown language go after. Invalid
    UTF-8 is dropped and line ends are newlines.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(F.regexp_replace("path", f"^(?:file:)?/*{re.escape(base.removeprefix('file://'))}/", "").alias("path"), "content")
    kept = raw.where(~is_ignored(F.col("path"), patterns or []))
    rows = kept.select("path", clean_text(F.col("content")).alias("text")).withColumn("language", language_of(F.col("path"), F.col("text")))
    rows = rows.where("language <> 'unknown'")
    return rows.withColumns({"loc": lines_of_code(F.col("text")), "tags": tags_of(F.col("path"), F.col("language"), F.col("text")), "has_fuzz": F.col("text").contains("LLVMFuzzerTestOneInput")})


def snapshot(targets: DataFrame, root: str, commit: str | None = None) -> DataFrame:
    """One row: root, commit, file_count and the files of each language, by name."""
    counts = targets.groupBy("language").count()
    languages = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("language").alias("key"), F.col("count").alias("value")))))
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("file_count"), languages.alias("languages")).select(F.lit(root).alias("root"), F.lit(commit).cast("string").alias("commit"), "file_count", "languages")


def language_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("language").count().orderBy("language")


def _rule(item: dict, file: str) -> Rule:
    missing = [c for c in ("rule_id", "cwe", "pattern") if c not in item]
    if missing:
        raise SourceError(f"a rule of {file} has no {missing[0]}")
    name, pattern, status = str(item["rule_id"]), str(item["pattern"]), str(item.get("status", "enabled"))
    if status not in STATUSES:
        raise SourceError(f"rule {name} has the unknown status {status!r}")
    if not pattern:
        raise SourceError(f"rule {name} has an empty pattern")
    groups = re.compile(pattern).groups
    return Rule(name, pattern, tuple(item.get("languages", ())), str(item["cwe"]), tuple(item.get("tags", ())), min(groups, 1), status, float(item.get("precision_estimate", 0.0)), str(item.get("title", name)), str(item.get("min_evidence_level", "static_corroboration")))


def read_rules(directory: str) -> list[Rule]:
    """Rules of all .toml files below a directory, by id; an id that occurs twice, and a rule without its fields, are errors."""
    rules: dict[str, Rule] = {}
    for folder, _, names in sorted(os.walk(directory)):
        for name in sorted(n for n in names if n.endswith(".toml")):
            with open(os.path.join(folder, name), "rb") as f:
                for item in tomllib.load(f).get("rule", []):
                    rule = _rule(item, name)
                    if rule.rule_id in rules:
                        raise SourceError(f"rule {rule.rule_id} occurs twice")
                    rules[rule.rule_id] = rule
    return [rules[k] for k in sorted(rules)]


EXPECTED = "key string, language string, e_ord int, cwe string, class string, path string, evidence string, rule_id string, line int, function string, sink string"


def _manifest(path: str) -> dict:
    with open(path, "rb") as f:
        data = tomllib.load(f)
    kind = data.get("source", {}).get("type", "local")
    if kind != "local":
        raise SourceError(f"the source type {kind!r} of {path} isn't known")
    return data


def read_expected(spark: SparkSession, *manifests: str) -> DataFrame:
    """Ground truth of manifests, EXPECTED: key (a manifest's name), e_ord and the optional wildcards of each expected row."""
    rows = []
    for path in manifests:
        data = _manifest(path)
        for i, e in enumerate(data.get("expected", [])):
            cls = e.get("class", e.get("vulnerability_class", "unknown"))
            rows.append((data["name"], data.get("language"), i, e.get("cwe"), cls, e.get("path", ""), e.get("evidence", ""), e.get("rule_id"), e.get("line"), e.get("function"), e.get("sink")))
    return spark.createDataFrame(rows, EXPECTED)


def manifest_source(manifest: str) -> tuple[str, str]:
    """A manifest's name and the folder of its sources, which stands relative to the manifest."""
    data = _manifest(manifest)
    return data["name"], os.path.normpath(os.path.join(os.path.dirname(manifest), data["source"]["path"]))


BASELINE = "array<struct<tool:string,finding_id:string,id:string,path:string,line:string,rule_id:string,cwe:string,class:string,vulnerability_class:string,evidence:string>>"


def read_baselines(spark: SparkSession, manifest: str, paths: list[str]) -> DataFrame:
    """(manifest, tool, f_ord, finding_id, path, line, rule_id, cwe, vulnerability_class, evidence) of other tools' findings.

    Each file is a JSON array of findings, or an object that holds it as `findings`; missing files are skipped. A finding without a
    tool gets its file's stem, `id` and `vulnerability_class` are other names of `finding_id` and `class`, and f_ord is
    the place in the files' order.
    """
    there = [p for p in paths if path_exists(spark, p)]
    schema = "manifest string, tool string, f_ord long, finding_id string, path string, line int, rule_id string, cwe string, vulnerability_class string, evidence string"
    if not there:
        return spark.createDataFrame([], schema)
    files = spark.read.text(there, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"))
    number = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(there) for x in (re.sub(r"\.[^./]*$", "", os.path.basename(p)), i)]), F.col("stem"))
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", BASELINE)).otherwise(F.from_json("value", f"struct<findings:{BASELINE}>")["findings"])
    rows = files.select("stem", number.alias("file"), F.posexplode(items).alias("pos", "f"))
    text = lambda *names: F.coalesce(*[F.col(f"f.{n}") for n in names])
    return rows.select(
        F.lit(manifest).alias("manifest"), F.coalesce("f.tool", "stem").alias("tool"), (F.col("file").cast("long") * (1 << 32) + F.col("pos")).alias("f_ord"), F.coalesce(text("finding_id", "id"), F.lit("")).alias("finding_id"), F.coalesce("f.path", F.lit("")).alias("path"),
        F.col("f.line").try_cast("int").alias("line"), text("rule_id").alias("rule_id"), text("cwe").alias("cwe"), F.nullif(F.coalesce(text("class", "vulnerability_class"), F.lit("")), F.lit("")).alias("vulnerability_class"), F.coalesce("f.evidence", F.lit("")).alias("evidence"),
    )


LEDGER = "finding_id string, path string, vulnerability_class string, reason string, evidence string, scope string, demotion double"
# Why a finding was a false positive.
REASONS = ("unreachable_path", "missing_attacker_control", "sanitizer_disproved", "static_rule_mismatch", "incorrect_model_assumption", "duplicate", "insufficient_impact", "unsupported", "contradicted", "unverified")


def read_ledger(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Learnings as JSON lines, or as a document with an array `learnings`; a missing path is an empty ledger.

    A missing demotion is 0.5, an unknown reason an error when it's read.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    if document:
        fields = ", ".join(f"{f.split()[0]}:{f.split()[1]}" for f in LEDGER.split(", ")).replace(", ", ",")
        rows = spark.read.schema(f"learnings array<struct<{fields}>>").option("multiLine", True).json(path).select(F.explode("learnings").alias("l")).select("l.*")
    else:
        rows = spark.read.schema(LEDGER).json(path)
    checked = F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise(F.raise_error(F.concat(F.lit("unknown reason "), F.coalesce("reason", F.lit("null")))))
    return rows.withColumns({"reason": checked, "demotion": F.coalesce("demotion", F.lit(0.5))})


def write_calibrations(calibrated: DataFrame, path: str) -> None:
    """The calibrations that a learning caused, as JSON lines."""
    calibrated.where(F.size("learning_ids") > 0).select("path", "priority", "calibrated", "learning_ids", "constraints", "adjustments").write.mode("overwrite").json(path)


def write_ledger(ledger: DataFrame, folder: str, version: str) -> str:
    """A new version beside the old ones: a ledger that a plan reads isn't overwritten."""
    path = f"{folder.rstrip('/')}/version={version}"
    ledger.write.json(path)
    return path


VECTORS = "vec_id long, path string, start_line int, end_line int, text string, embedding array<float>, namespace string"


def read_vectors(spark: SparkSession, path: str, schema: str = VECTORS) -> DataFrame:
    """A vector table that write_vectors() stored; a filter or join on the namespace prunes its folders. A missing table is empty."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def write_vectors(vectors: DataFrame, path: str, by: str = "namespace") -> None:
    vectors.write.mode("overwrite").partitionBy(by).parquet(path)


RULE_LEDGER = "rule_id string, status string, min_evidence_level string, precision_estimate double"
JOURNAL = "round int, outcome string, reason string, edits array<struct<key:string,lever:string,rule_id:string,`from`:string,`to`:string,rationale:string>>, recall_before double, recall_after double, fp_before double, fp_after double, score_before int, score_after int"


def read_rule_ledger(spark: SparkSession, path: str) -> DataFrame:
    """RULE_LEDGER of a JSON object by rule; what isn't an object goes, a missing file is an empty ledger."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RULE_LEDGER)
    whole = F.from_json("value", "map<string,string>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(whole).alias("rule_id", "entry")).where(F.ltrim("entry").startswith("{"))
    return rows.select("rule_id", F.from_json("entry", "status string, min_evidence_level string, precision_estimate double").alias("e")).select("rule_id", "e.*")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JOURNAL of a folder of JSON lines, or of one JSON array; a missing path is an empty journal."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(JOURNAL).option("multiLine", path.endswith(".json")).json(path)


def append_round(entry: DataFrame, folder: str) -> None:
    """A round's row beside the earlier ones: the journal only grows."""
    entry.write.mode("append").json(folder)


FINDINGS = "finding_id string, path string, title string, severity string, confidence string, evidence_level string, rationale string, line int, function_name string, reachability_status string, reachability_conditions array<string>, tags array<string>, ranking_priority double, status string"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """finding_rows()' columns of a document with an array `findings`; a missing status is enabled, a missing file has no rows. `ord` is the place in the document."""
    fields = re.sub(r"(\w+) ([a-z<>]+)", r"\1:\2", FINDINGS)
    there = path_exists(spark, path)
    found = spark.read.schema(f"findings array<struct<{fields}>>").option("multiLine", True).json(path) if there else spark.createDataFrame([], f"findings array<struct<{fields}>>")
    rows = found.select(F.posexplode("findings").alias("ord", "f")).select("ord", "f.*")
    renamed = rows.withColumnsRenamed({"reachability_status": "reachability", "reachability_conditions": "conditions", "ranking_priority": "priority"})
    return renamed.withColumns({"rule_id": F.substring_index("finding_id", ":", 1), "status": F.coalesce("status", F.lit("enabled"))})


def write_rules(rules: list[Rule], path: str) -> None:
    """Rules as TOML; a pattern that holds three single quotes can't be written."""
    blocks = []
    for r in rules:
        if "'''" in r.pattern:
            raise SourceError(f"the pattern of rule {r.rule_id} holds three single quotes")
        text = {"rule_id": r.rule_id, "title": r.title or r.rule_id, "languages": list(r.languages), "cwe": r.cwe, "tags": list(r.tags), "status": r.status, "min_evidence_level": r.min_evidence_level, "precision_estimate": r.precision}
        blocks.append("[[rule]]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in text.items()) + f"pattern = '''{r.pattern}'''\n")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(blocks))
