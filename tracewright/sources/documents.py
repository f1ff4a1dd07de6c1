"""Single documents from distributed rows: SARIF, reports and rule ledgers, written by tasks as parts and joined in order."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tracewright.functions.text import redacted
from tracewright.operators.findings import severity_order
from tracewright.operators.verify import latest_verification
from tracewright.sources.sarif import BETWEEN, HEAD, RULES, TAIL, level_of

FORMAT = "tracewright_document"


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: a file for each section that it had rows of."""

    partition: int
    files: dict[int, str]


def _opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class DocumentWriter(DataSourceWriter):
    """Rows (section, text), sorted, as one document: frame[0], section 0, frame[1], section 1 and so on, rows apart by the separator.

    Tasks write files of their own; the commit copies those of the attempts that succeeded, in the order of
    partitions, a buffer at a time, and removes them.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.frame, self.separator = options["path"], json.loads(options["frame"]), options["separator"]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        fs, base = _opened(self.parts)
        partition, out, files = TaskContext.get().partitionId(), {}, {}
        for row in iterator:
            section = row["section"]
            if section in out:
                out[section].write(self.separator.encode())
            else:
                fs.create_dir(base, recursive=True)
                files[section] = f"{base}/{partition}-{section}-{uuid.uuid4().hex}"
                out[section] = fs.open_output_stream(files[section])
            out[section].write(row["text"].encode())
        for stream in out.values():
            stream.close()
        return Part(partition, files)

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = _opened(self.path)
        with fs.open_output_stream(path) as out:
            for section in range(len(self.frame) - 1):
                out.write(self.frame[section].encode())
                files = [m.files[section] for m in sorted((m for m in messages if m), key=lambda m: m.partition) if section in m.files]
                for i, file in enumerate(files):
                    if i:
                        out.write(self.separator.encode())
                    with fs.open_input_stream(file) as part:
                        shutil.copyfileobj(part, out, 1 << 20)
            out.write(self.frame[-1].encode())
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, base = _opened(self.parts)
        if fs.get_file_info(base).type == FileType.Directory:
            fs.delete_dir(base)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "section int, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(rows: DataFrame, order: list[Column], path: str, frame: list[str], separator: str) -> None:
    """One document of rows (section, text) by section and order; nothing is collected."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    sorted_ = rows.orderBy("section", *order).select(F.col("section").cast("int").alias("section"), "text")
    sorted_.write.format(FORMAT).option("path", path).option("frame", json.dumps(frame)).option("separator", separator).mode("append").save()


def with_verification(findings: DataFrame, verifications: DataFrame | None) -> DataFrame:
    """findings with `verification`, the last row of their id, as a struct; null without one."""
    if verifications is None:
        return findings.withColumn("verification", F.lit(None).cast("struct<finding_id:string,status:string>"))
    last = latest_verification(verifications)
    rest = [c for c in last.columns if c != "finding_id"]
    return findings.join(last.select("finding_id", F.struct("finding_id", *rest).alias("verification")), "finding_id", "left")


def _order() -> list[Column]:
    return [severity_order(F.col("severity")), F.desc("priority"), F.col("path"), F.col("line"), F.col("rule_id"), F.col("ord")]


def sarif_rows(findings: DataFrame, verifications: DataFrame | None = None) -> DataFrame:
    """(section, text, ...) of a SARIF document: results in the order of the report, then each rule once, by its first result."""
    f = with_verification(findings, verifications)
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    properties = F.struct("confidence", "evidence_level", "finding_id", F.col("priority").alias("ranking_priority"), F.col("conditions").alias("reachability_conditions"), F.col("reachability").alias("reachability_status"), "severity", "verification")
    result = F.struct(level_of(F.col("severity")).alias("level"), F.array(place).alias("locations"), F.struct(F.col("rationale").alias("text")).alias("message"), F.struct(F.col("finding_id").alias("findingId")).alias("partialFingerprints"), properties.alias("properties"), F.col("rule_id").alias("ruleId"))
    keep = ["severity", "priority", "path", "line", "rule_id", "ord"]
    results = f.select(F.lit(0).alias("section"), F.to_json(result, {"ignoreNullFields": "false"}).alias("text"), *keep)
    first = findings.groupBy("rule_id").agg(F.min_by(F.struct(*keep, "title", "tags"), F.struct(severity_order(F.col("severity")), -F.col("priority"), "path", "line", "ord")).alias("r"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("r.title").alias("name"), F.struct(F.col("r.tags").alias("tags")).alias("properties"), F.struct(F.col("r.title").alias("text")).alias("shortDescription"))
    rules = first.select(F.lit(1).alias("section"), F.to_json(rule).alias("text"), *[F.col(f"r.{c}").alias(c) for c in keep])
    return results.unionByName(rules)


def write_sarif(findings: DataFrame, path: str, verifications: DataFrame | None = None, tool: str = "tracewright") -> None:
    """One SARIF document of finding_rows() with the last verification of each finding joined; results and rules have a line each, so that read_hints() can split it."""
    frame = [HEAD + "\n", "\n" + BETWEEN + json.dumps(tool) + RULES + "\n", "\n" + TAIL + "\n"]
    write_document(sarif_rows(findings, verifications), _order(), path, frame, ",\n")


def report_rows(findings: DataFrame, verifications: DataFrame | None = None, redact: bool = True) -> DataFrame:
    """(section, text, ...) of a Markdown report: a part per finding, secrets masked."""
    f = with_verification(findings, verifications)
    none = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    points = [
        ("ID", F.col("finding_id")), ("Path", F.col("path")), ("Line", F.coalesce(F.col("line").cast("string"), F.lit("None"))), ("Function", none(F.col("function_name"), "unknown")), ("Severity", F.col("severity")), ("Confidence", F.col("confidence")),
        ("Evidence level", F.col("evidence_level")), ("Verification", F.coalesce("verification.status", F.lit("not_run"))), ("Reachability", F.col("reachability")), ("Conditions", none(F.array_join("conditions", ", "), "none")),
        ("Ranking priority", F.col("priority").cast("string")), ("Tags", F.array_join("tags", ", ")),
    ]
    lines = [F.concat(F.lit("## "), "title"), F.lit(""), *[F.concat(F.lit(f"- {n}: `"), c, F.lit("`")) for n, c in points], F.lit(""), F.col("rationale")]
    text = F.concat_ws("\n", *lines)
    return f.select(F.lit(0).alias("section"), (redacted(text) if redact else text).alias("text"), "severity", "priority", "path", "line", "rule_id", "ord")


def write_report(findings: DataFrame, path: str, verifications: DataFrame | None = None, redact: bool = True, title: str = "Report") -> None:
    """One Markdown document in the order of the report."""
    n = findings.count()
    head = f"# {title}\n\nFindings: {n}\n\n" + ("" if n else "No quick-mode findings were emitted.")
    write_document(report_rows(findings, verifications, redact), _order(), path, [head, "\n"], "\n\n")


def write_rule_ledger(ledger: DataFrame, path: str) -> None:
    """(rule_id, status, min_evidence_level, precision_estimate) as one JSON object by rule; nulls are left out."""
    entry = F.to_json(F.struct("min_evidence_level", "precision_estimate", "status"))
    rows = ledger.select(F.lit(0).alias("section"), F.concat(F.to_json(F.array("rule_id")).substr(F.lit(2), F.length(F.to_json(F.array("rule_id"))) - 2), F.lit(": "), entry).alias("text"), "rule_id")
    write_document(rows, [F.col("rule_id")], path, ["{", "}\n"], ",\n")
