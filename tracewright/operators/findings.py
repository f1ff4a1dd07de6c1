"""Pattern findings: rules over texts, places of matches, reachability from interval hints, finding rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tracewright.functions.text import HASH_COMMENTS

SEVERITY_LABELS = {5: "critical", 4: "high", 3: "medium", 2: "low", 1: "low", 0: "info"}
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
UNREACHED_PRIORITY = 1.5
STATUSES = ("enabled", "shadow", "disabled")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    languages: tuple[str, ...] = ()
    cwe: str = ""
    tags: tuple[str, ...] = ()
    token_group: int = 1
    status: str = "enabled"
    precision: float = 0.0
    title: str = ""
    min_evidence_level: str = "static_corroboration"


def overlaid(rules: list[Rule], ledger: dict[str, dict]) -> list[Rule]:
    """Rules with a ledger's status, evidence floor and precision where it has them; an unknown status is ignored."""
    out = []
    for r in rules:
        own = ledger.get(r.rule_id, {})
        status = own.get("status")
        out.append(replace(r, status=status if status in STATUSES else r.status, precision=float(own.get("precision_estimate", r.precision)), min_evidence_level=str(own.get("min_evidence_level", r.min_evidence_level))))
    return out


class Places:
    """Lines of a text and where their comments start, found once for all of the text's matches."""

    def __init__(self, text: str, language: str | None):
        self.text, self.hashed = text, language in HASH_COMMENTS
        self.ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
        self._comments: dict[int, int] = {}

    def line(self, offset: int) -> int:
        """The line of a character offset, from 1."""
        return int(np.searchsorted(self.ends, offset)) + 1

    def commented(self, offset: int, line: int) -> bool:
        """Whether an offset stands behind a comment mark of its line, or the line starts as a comment."""
        if line not in self._comments:
            start = int(self.ends[line - 2]) + 1 if line > 1 else 0
            end = int(self.ends[line - 1]) if line <= len(self.ends) else len(self.text)
            head = re.compile(r"\s*").match(self.text, start, end).end()
            mark = self.text.find("#" if self.hashed else "//", start, end)
            opens = self.text.startswith(("#",) if self.hashed else ("//", "/*", "*"), head, end)
            self._comments[line] = -1 if opens else mark if mark >= 0 else end
        return self._comments[line] < offset


_MATCH = pa.list_(pa.struct([("rule", pa.int32()), ("ord", pa.int32()), ("offset", pa.int32()), ("line", pa.int32()), ("token", pa.string())]))


def _scanned(rules: list[Rule]):
    """For mapInArrow: language and text become `matches`, other columns stay; texts without matches go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(no, re.compile(r.pattern), frozenset(r.languages), r.token_group) for no, r in enumerate(rules)]

        def matches(text: str, language: str | None) -> list[dict]:
            out, places = [], None
            for no, pattern, languages, group in compiled:
                if languages and language not in languages:
                    continue
                at = 0
                for m in pattern.finditer(text):
                    places = places or Places(text, language)
                    line = places.line(m.start())
                    if not places.commented(m.start(), line):
                        out.append({"rule": no, "ord": at, "offset": m.start(), "line": line, "token": (m[group] or "") if group else m[0].split("(", 1)[0].strip()})
                        at += 1
            return out

        for batch in batches:
            found = [matches(t or "", x) for t, x in zip(batch.column("_text").to_pylist(), batch.column("language").to_pylist())]
            kept = pa.array([bool(f) for f in found], pa.bool_())
            rest = batch.drop_columns(["_text"]).append_column("matches", pa.array(found, _MATCH))
            yield rest.filter(kept)

    return run


def find_matches(targets: DataFrame, rules: list[Rule], least_precision: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, rule_id, ord, offset, line, token, status, rule_tags, cwe, title, *carry): every match outside comments.

    Rules are Python expressions. All rules of a text's language (no languages: any) are searched in one pass over the texts
    that leaves only places; lines come from the text's newline offsets by binary search, so the time is linear in text and
    matches. Disabled rules and rules below least_precision don't take part. `ord` numbers a rule's matches in a
    text from 0. `carry` names further columns of targets that their matches keep.
    """
    active = [r for r in rules if r.status != "disabled" and r.precision >= least_precision]
    rows = targets.select("path", "language", *carry, F.col("text").alias("_text"))
    if active and all(r.languages for r in active):
        rows = rows.where(F.col("language").isin(sorted({x for r in active for x in r.languages})))
    schema = rows.drop("_text").schema.add("matches", DataType.fromDDL("array<struct<rule:int,ord:int,offset:int,line:int,token:string>>"))
    rows = rows.mapInArrow(_scanned(active), schema).select("path", "language", *carry, F.explode("matches").alias("m"))

    def of(values: list, default: Column) -> Column:
        return F.element_at(F.array(*values), F.col("m.rule") + 1) if values else default

    empty = F.expr("cast(array() as array<string>)")
    return rows.select(
        "path", "language", of([F.lit(r.rule_id) for r in active], F.lit("")).alias("rule_id"), "m.ord", "m.offset", "m.line", "m.token",
        of([F.lit(r.status) for r in active], F.lit("")).alias("status"), of([F.concat(empty, F.array(*map(F.lit, r.tags))) if r.tags else empty for r in active], empty).alias("rule_tags"), of([F.lit(r.cwe) for r in active], F.lit("")).alias("cwe"),
        of([F.lit(r.title or r.rule_id) for r in active], F.lit("")).alias("title"), *carry,
    )


def rationale(matches: DataFrame) -> DataFrame:
    """matches with the sentence that explains each of them."""
    text = F.concat(F.lit("Static pattern "), "rule_id", F.lit(" ("), "cwe", F.lit(") matched "), "token", F.lit(" on line "), F.col("line").cast("string"), F.lit("; manual verification still required."))
    return matches.withColumn("rationale", text)


def covers(hint: Column, line: Column) -> Column:
    return (hint["line"] <= line) & (line <= F.coalesce(hint["end_line"], hint["line"]))


def with_reachability(matches: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """matches with reachability, function_name and conditions from their file's entry points.

    hints: path and an array of struct(line, end_line, function_name, conditions), one row per path
    (attach_hints makes it); without it, matches carry their file's hints. A file with line-bearing hints of which none covers the match is
    'unknown'; hints without lines count only where there are no others.
    """
    joined = matches if hints is None else matches.join(hints.select("path", "hints"), "path", "left")
    concrete = F.filter("hints", lambda h: h["line"].isNotNull())
    covering = F.filter(concrete, lambda h: covers(h, F.col("line")))
    unplaced = F.filter("hints", lambda h: h["line"].isNull())
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    status = F.when(some(covering), "reachable").when(some(concrete), "unknown").when(some(unplaced), "inferred-file-surface").otherwise("unknown")
    evidence = F.when(some(covering), covering).when(~some(concrete) & some(unplaced), unplaced)
    names = F.filter(covering, lambda h: h["function_name"].isNotNull() & (h["function_name"] != ""))
    conditions = F.array_sort(F.array_distinct(F.flatten(F.transform(evidence, lambda h: F.coalesce(h["conditions"], F.expr("cast(array() as array<string>)"))))))
    return joined.withColumns({"reachability": status, "function_name": F.try_element_at(F.transform(names, lambda h: h["function_name"]), F.lit(1)), "conditions": F.coalesce(conditions, F.expr("cast(array() as array<string>)"))}).drop("hints")


def attach_hints(targets: DataFrame, hints: DataFrame, fields: tuple[str, ...] = ("line", "end_line", "function_name", "kind", "access_level", "conditions")) -> DataFrame:
    """targets with `hints`, their rows of the hints table as a sorted array; an empty array without any."""
    grouped = hints.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hints"))
    kind = grouped.schema["hints"].dataType.simpleString()
    return targets.join(grouped, "path", "left").withColumn("hints", F.coalesce("hints", F.expr(f"cast(array() as {kind})")))


def severity_label(severity: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SEVERITY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.coalesce(severity, F.lit(0))), F.lit("info"))


def severity_order(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SEVERITY_ORDER.items() for x in pair]), label), F.lit(5))


def finding_rows(matches: DataFrame, rankings: DataFrame | None, policy: DataFrame) -> DataFrame:
    """Findings: id rule:path:line, severity of the rule's CWE, priority of the file (1.5 at most if not reached), united tags.

    rankings: path, priority; policy: cwe, severity, static. A file without ranking has priority 1;
    a CWE missing from the policy or not static has severity 0. Ids need not be unique. Without rankings, matches carry
    their file's priority and tags.
    """
    small = F.broadcast(policy.where("static").select("cwe", F.col("severity").alias("policy_severity")))  # a fixed list of weaknesses
    ranked = matches if rankings is None else matches.join(rankings.select("path", "priority", "tags"), "path", "left")
    joined = rationale(ranked.join(small, "cwe", "left"))
    priority = F.coalesce("priority", F.lit(1.0))
    return joined.select(
        F.concat_ws(":", "rule_id", "path", F.col("line").cast("string")).alias("finding_id"), "ord", "rule_id", "path", "line", "token", "cwe", severity_label(F.col("policy_severity")).alias("severity"),
        "reachability", "function_name", "conditions", F.when(F.col("reachability") == "unknown", F.least(priority, F.lit(UNREACHED_PRIORITY))).otherwise(priority).alias("priority"),
        F.array_sort(F.array_union(F.coalesce("tags", F.expr("cast(array() as array<string>)")), "rule_tags")).alias("tags"), "status",
        "title", "rationale", F.lit("medium").alias("confidence"), F.lit("static_corroboration").alias("evidence_level"),
    )


def in_report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_order(F.col("severity")), F.desc("priority"), "path", "line", "rule_id", "ord")


def reported(findings: DataFrame, least_priority: float = 0.0) -> DataFrame:
    return findings.where((F.col("status") != "shadow") & (F.col("priority") >= least_priority))


def shadowed(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status") == "shadow")


def per_target(findings: DataFrame, most: int) -> DataFrame:
    """The first `most` findings of each path in the order of the report: a limit that callers ask for."""
    order = (severity_order(F.col("severity")), F.desc("priority"), "line", "rule_id", "ord")
    return findings.withColumn("_place", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def limited(findings: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, disclosure): the first `most` findings of the report, and a row (stage, reason, requested, actual) if there are more; 0 is no limit."""
    told = findings.agg(F.count("*").alias("actual")).select(F.lit("budget").alias("stage"), F.lit("max_findings_exceeded").alias("reason"), F.lit(most).alias("requested"), "actual")
    if not most:
        return findings, told.where("false")
    return in_report_order(findings).limit(most), told.where(F.col("actual") > most)
