"""CWE policy: loading, resolution of rules, penalties, project score and its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_PENALTY = {5: 50.0, 4: 25.0, 3: 10.0, 2: 2.0, 1: 1.0, 0: 0.0}
MULTIPLIER = {"reachable": 1.0, "inferred-file-surface": 0.6, "unknown": 0.4}
FALSE_POSITIVE_FACTOR = 0.4
DECAY = 60.0


class PolicyError(ValueError):
    """A rule's weakness has no policy row."""


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """(cwe, category, severity, static, dynamic) of a tab-separated table, by position.

    Cells are trimmed, rows of fewer than five cells and rows with a weakness number that isn't digits go, severities are held to 0..5,
    an X sets a flag, and of rows with one number the last in the file counts.
    """
    return policy_rows(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def policy_rows(lines: DataFrame) -> DataFrame:
    """The policy of a table's lines (ord, value)."""
    names = ["category", "number", "name", "severity", "static", "dynamic"]
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = lines.where(F.size(cells) >= 5)
    rows = rows.withColumns({n: F.regexp_replace(F.coalesce(F.get(cells, F.lit(i)), F.lit("")), "^\"|\"$", "") for i, n in enumerate(names)})
    cell = lambda c: F.trim(F.col(c))
    level = F.coalesce(F.expr("try_cast(trim(severity) as int)"), F.lit(0))
    kept = rows.where(cell("number").rlike("^[0-9]+$"))
    flags = [(F.upper(cell(c)) == "X").alias(c) for c in ("static", "dynamic")]
    out = kept.select("ord", F.concat(F.lit("CWE-"), cell("number")).alias("cwe"), cell("category").alias("category"), F.greatest(F.lit(0), F.least(F.lit(5), level)).alias("severity"), *[F.coalesce(f, F.lit(False)).alias(n) for f, n in zip(flags, ("static", "dynamic"))])
    return out.groupBy("cwe").agg(F.max_by(F.struct("category", "severity", "static", "dynamic"), "ord").alias("p")).select("cwe", "p.*")


def unresolved(rules: DataFrame, policy: DataFrame) -> DataFrame:
    """Enabled rules whose CWE has no policy row."""
    return rules.where("status = 'enabled'").join(policy, "cwe", "left_anti")


def assert_resolved(rules: DataFrame, policy: DataFrame) -> None:
    missing = [r["rule_id"] for r in unresolved(rules, policy).select("rule_id").orderBy("rule_id").take(20)]
    if missing:
        raise PolicyError("rules without policy: " + ", ".join(missing))


def with_penalty(findings: DataFrame, policy: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """findings with mapped, static_severity and penalty.

    penalty = weight of the policy severity x the override, or else the multiplier of the
    reachability (0.4 if it isn't known by name); 0 for weaknesses that are unmapped or not static.
    overrides: finding_id, factor, at most one row per id.
    """
    small = F.broadcast(policy.select("cwe", "category", F.col("severity").alias("p_severity"), "static", "dynamic"))  # a fixed list of weaknesses
    joined = findings.join(small, "cwe", "left")
    factor = F.coalesce(F.try_element_at(_map(MULTIPLIER), F.col("reachability")), F.lit(0.4))
    if overrides is not None:
        joined = joined.join(overrides.dropDuplicates(["finding_id"]), "finding_id", "left")
        factor = F.coalesce("factor", factor)
    level = F.when(F.coalesce("static", F.lit(False)), F.col("p_severity")).otherwise(0)
    weight = F.coalesce(F.try_element_at(_map(SEVERITY_PENALTY), level), F.lit(0.0))
    return joined.withColumns({"mapped": F.col("p_severity").isNotNull(), "static_severity": level, "penalty": weight * factor})


def decayed_score(total: Column, k: float = DECAY) -> Column:
    return F.round(100 * F.exp(-F.coalesce(total, F.lit(0.0)) / k)).cast("int")


def project_score(scored: DataFrame, keys: tuple[str, ...] = (), k: float = DECAY) -> DataFrame:
    """Per group (or in all) the score 100 e^(-sum of penalties / k), the highest severity of all and of reachable findings, totals and unmapped weaknesses (unnamed ones as 'unknown'); no findings score 100."""
    out = scored.groupBy(*keys).agg(
        F.sum("penalty").alias("penalty_total"), F.max("static_severity").alias("max_severity"), F.count("*").alias("findings"),
        F.count_if(F.col("mapped") & ~F.coalesce("static", F.lit(False)) & F.coalesce("dynamic", F.lit(False))).alias("dynamic_only"), F.array_sort(F.collect_set(F.when(~F.col("mapped"), F.coalesce(F.nullif("cwe", F.lit("")), F.lit("unknown"))))).alias("unmapped"),
        F.coalesce(F.max(F.when(F.col("reachability") == "reachable", F.col("static_severity"))), F.lit(0)).alias("max_reachable_severity"),
    )
    return out.withColumns({"score": decayed_score(F.col("penalty_total"), k), "penalty_total": F.coalesce("penalty_total", F.lit(0.0)), "max_severity": F.coalesce("max_severity", F.lit(0))})


def score_gate(scores: DataFrame, hard_severity: int = 5, least_score: int = 80, blocking: bool = False) -> DataFrame:
    """scores with hard_failure (a reachable static weakness of hard_severity or more, in any mode) and passed.

    A score below least_score fails only where the gate is blocking.
    """
    hard = F.col("max_reachable_severity") >= hard_severity
    soft = (F.col("score") < least_score) & F.lit(blocking)
    return scores.withColumns({"hard_failure": hard, "passed": ~(hard | soft)})


def category_counts(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per group and category the findings of static weaknesses, their penalties and highest severity, from rows of with_penalty()."""
    return scored.where("mapped and static").groupBy(*keys, "category").agg(F.count("*").alias("findings"), F.sum("penalty").alias("penalty_total"), F.max("static_severity").alias("max_severity"))
