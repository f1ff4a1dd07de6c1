"""Verification and fusion: evidence ladder, deterministic verdicts, triggers, two-panel decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import chosen

# The ladder from the weakest evidence to the strongest.
LADDER = ("suspicion", "static_corroboration", "crash_reproduced", "root_cause_explained", "exploit_demonstrated", "patch_validated")
HIGH = ("critical", "high")
LEAST_CONFIDENCE = 0.6


def ladder_level(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ((n, i) for i, n in enumerate(LADDER)) for x in pair]), name)


def verified(findings: DataFrame) -> DataFrame:
    """findings with verdict and is_verified: too little evidence needs more; what can't be reached is rejected; the rest is accepted."""
    low = F.coalesce(ladder_level(F.col("evidence_level")), F.lit(0)) < 1 if "evidence_level" in findings.columns else F.lit(False)
    verdict = F.when(low, "needs_evidence").when(F.col("reachability") == "unknown", "rejected").otherwise("accepted")
    return findings.withColumns({"verdict": verdict, "is_verified": verdict == "accepted"})


def judged(label: Column, confidence: Column) -> Column:
    """A judge's label and confidence as a verdict."""
    return F.when((label == "plausible") & (confidence >= LEAST_CONFIDENCE), "accepted").when(label.isin("unsupported", "refused"), "rejected").otherwise("needs_evidence")


def latest_verification(verifications: DataFrame, order: str = "ord") -> DataFrame:
    """The last row of each finding_id by `order`, which goes."""
    rest = [c for c in verifications.columns if c not in ("finding_id", order)]
    return verifications.groupBy("finding_id").agg(F.max_by(F.struct(*rest), order).alias("v")).select("finding_id", "v.*")


def transitions(history: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """history with `previous` level per key and `allowed`: a step may stay or go up by one, never back or past a rung."""
    previous = F.lag(level).over(Window.partitionBy(key).orderBy(order))
    step = F.col(level) - F.col("previous")
    return history.withColumn("previous", previous).withColumn("allowed", F.col("previous").isNull() | step.between(0, 1))


def fusion_triggers(findings: DataFrame, high_assurance: bool = False) -> DataFrame:
    """findings with `triggers`, the sorted conditions that call for a second look, and should_fuse."""
    reached, high = F.col("reachability") == "reachable", F.col("severity").isin(*HIGH)
    fired = {f"severity:{s}": F.col("severity") == s for s in HIGH}
    fired |= {"verifier_disagreement": F.col("verdict") == "needs_evidence", "evidence_conflict": (F.col("verdict") == "rejected") & reached, "gates_risky_fix": reached & high, "high_assurance_request": F.lit(high_assurance)}
    return findings.withColumn("triggers", chosen(fired)).withColumn("should_fuse", F.size("triggers") > 0)


def fused(findings: DataFrame, mitigated: Column | None = None) -> DataFrame:
    """findings with the panels' dispositions and confidences, the votes and the decision."""
    reached, high = F.col("reachability") == "reachable", F.col("severity").isin(*HIGH)
    ok, rejected = F.coalesce("is_verified", F.lit(False)), F.coalesce(F.col("verdict") == "rejected", F.lit(False))
    gate = reached & high & ~ok
    a = F.when(gate, F.struct(F.lit("blocked").alias("disposition"), F.lit(0.7).alias("confidence"))).when(reached, F.struct(F.lit("accepted").alias("disposition"), F.when(ok, 0.75).otherwise(0.6).alias("confidence"))).otherwise(F.struct(F.lit("deferred").alias("disposition"), F.lit(0.5).alias("confidence")))
    b = F.when(rejected | ~reached, F.struct(F.lit("rejected").alias("disposition"), F.when(rejected, 0.7).otherwise(0.55).alias("confidence"))).when(ok, F.struct(F.lit("accepted").alias("disposition"), F.lit(0.6).alias("confidence"))).otherwise(F.struct(F.lit("deferred").alias("disposition"), F.lit(0.5).alias("confidence")))
    decision = (
        F.when(mitigated if mitigated is not None else F.lit(False), "mitigated")
        .when(rejected & ~reached, "rejected")
        .when(ok & reached, "accepted")
        .when(gate, "blocked")
        .otherwise("deferred")
    )
    return findings.withColumns({"panel_a": a, "panel_b": b, "decision": decision})


def votes(decided: DataFrame) -> DataFrame:
    """Panels' votes by decision and disposition."""
    return decided.select("decision", F.explode(F.array("panel_a.disposition", "panel_b.disposition")).alias("disposition")).groupBy("decision", "disposition").agg(F.count("*").alias("votes"))


def exit_status(findings: DataFrame, policy: str) -> DataFrame:
    """One row: 1 if the policy ('never', 'findings', 'verified') says that these findings fail a run."""
    if policy not in ("never", "findings", "verified"):
        raise ValueError(policy)
    some = {"never": F.lit(False), "findings": F.count("*") > 0, "verified": F.count_if("is_verified") > 0}[policy]
    return findings.agg(some.cast("int").alias("exit_status"))
