"""The life of rules: status edits from metrics, checks of what may be edited, ledgers, and a journal of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.evaluate import FALSE_POSITIVE_CEILING, RECALL_FLOOR
from tracewright.operators.findings import STATUSES

# The constants that may be tuned, and their bounds.
BOUNDS = {"K": (20.0, 200.0), "MIN_SCORE": (0.0, 100.0)}


def edit_key(rule_id: Column, from_status: Column, to_status: Column) -> Column:
    return F.concat(F.lit("rule:"), rule_id, F.lit(":"), from_status, F.lit("->"), to_status)


def reverted_keys(journal: DataFrame) -> DataFrame:
    """(key) of the edits of reverted rounds that gave no rationale: they aren't proposed again."""
    edits = journal.where("outcome = 'reverted'").select(F.explode("edits").alias("e")).select("e.key", "e.rationale")
    return edits.where("key is not null and coalesce(rationale, '') = ''").select("key").distinct()


def proposed_edits(counts: DataFrame, rules: DataFrame, ledger: DataFrame, reverted: DataFrame) -> DataFrame:
    """(rule_id, from_status, to_status, rationale, key): enabled rules with false positives go to shadow, but for reverted edits.

    counts: rule_id, false_positives (summed over its rows); rules: rule_id, status, cwe; ledger: rule_id, status?, which overrides
    the rule's. Counts of unknown rules propose nothing.
    """
    wrong = counts.groupBy("rule_id").agg(F.sum("false_positives").alias("n")).where("n > 0")
    known = rules.select("rule_id", "status").join(ledger.select("rule_id", F.col("status").alias("now")), "rule_id", "left")
    rows = wrong.join(known, "rule_id").where(F.coalesce("now", "status") == "enabled")
    edits = rows.select("rule_id", F.lit("enabled").alias("from_status"), F.lit("shadow").alias("to_status"), F.lit("").alias("rationale"))
    return edits.withColumn("key", edit_key(F.col("rule_id"), F.col("from_status"), F.col("to_status"))).join(reverted, "key", "left_anti")


def checked_edits(edits: DataFrame, rules: DataFrame, policy: DataFrame) -> DataFrame:
    """edits with `breach`, why an edit may not be made, or null: its status, its rule, a jump past shadow, its weakness."""
    known = edits.join(rules.select("rule_id", "cwe", F.lit(True).alias("known")), "rule_id", "left")
    known = known.join(F.broadcast(policy.select("cwe", F.lit(True).alias("resolved"))), "cwe", "left")  # a fixed list of weaknesses
    breach = (
        F.when(~F.col("to_status").isin(*STATUSES), F.concat(F.lit("invalid status '"), "to_status", F.lit("' for "), "rule_id"))
        .when(F.col("known").isNull(), F.concat(F.lit("edit targets unknown rule_id '"), "rule_id", F.lit("' (loop cannot add rules)")))
        .when((F.col("from_status") == "enabled") & (F.col("to_status") == "disabled"), F.concat("rule_id", F.lit(": enabled->disabled jump is forbidden; stage via shadow first")))
        .when(F.col("resolved").isNull(), F.concat("rule_id", F.lit(": CWE "), F.coalesce("cwe", F.lit("None")), F.lit(" does not resolve in the policy")))
    )
    return known.withColumn("breach", breach).drop("cwe", "known", "resolved")


def checked_constants(edits: DataFrame) -> DataFrame:
    """edits of constants (name, to_value) with `breach`: only those in BOUNDS, and only within them."""
    breach = F.when(~F.col("name").isin(*BOUNDS), F.concat(F.lit("policy constant '"), "name", F.lit("' is not loop-tunable (severity is upstream-owned)")))
    for name, (low, high) in BOUNDS.items():
        breach = breach.when((F.col("name") == name) & ~F.col("to_value").between(low, high), F.concat(F.lit(f"{name}="), F.col("to_value").cast("string"), F.lit(f" out of bounds ({low:g}, {high:g})")))
    return edits.withColumn("breach", breach)


def next_ledger(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """The ledger with the status of each edit that has no breach; its other columns stay, new rules come with the status alone."""
    good = (edits.where("breach is null") if "breach" in edits.columns else edits).groupBy("rule_id").agg(F.max("to_status").alias("to_status"))
    return ledger.join(good, "rule_id", "full").withColumn("status", F.coalesce("to_status", "status")).drop("to_status")


def accepted(recall: Column, fp_rate: Column, score: Column, matched: Column, score_before: Column, matched_before: Column, floor: float = RECALL_FLOOR, ceiling: float = FALSE_POSITIVE_CEILING) -> Column:
    """Whether a round's edits stay: both rates clear the gate, and neither score nor matches fell."""
    return (recall >= floor) & (fp_rate < ceiling) & (score >= score_before) & (matched >= matched_before)


def rounds(journal: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """journal with each round's changes of recall, false-positive rate and score against the round before (null for the first), and the best score so far."""
    by = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("round")
    change = {f"{c}_change": F.col(f"{c}_after") - F.lag(f"{c}_after").over(by) for c in ("recall", "fp", "score")}
    return journal.withColumns({**change, "best_score": F.max("score_after").over(by.rowsBetween(Window.unboundedPreceding, 0))})
