"""Feedback: learnings from rejected findings, demotion of rankings by path scope, score overrides, outcome metrics, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import directory_of
from tracewright.operators.policy import FALSE_POSITIVE_FACTOR, MULTIPLIER

FLOOR, DEMOTION = 0.1, 0.5


def class_of(findings: DataFrame) -> Column:
    """The first tag, or else the title in lower case with underscores; unknown without either."""
    titled = F.substring(F.replace(F.lower("title"), F.lit(" "), F.lit("_")), 1, 64) if "title" in findings.columns else F.lit("unknown")
    return F.coalesce(F.try_element_at("tags", F.lit(1)), titled, F.lit("unknown"))


# What an outcome says about a finding that isn't verified.
OUTCOME_REASONS = {"duplicate": "duplicate", "unsupported": "unsupported", "contradicted": "contradicted", "unverified": "unverified", "false_positive": "incorrect_model_assumption", "rejected": "incorrect_model_assumption"}


def default_scope(path: Column, vulnerability_class: Column) -> Column:
    """The directory and the class, with a colon between; the file itself stands for the root."""
    parent = directory_of(path)
    return F.concat(F.when(parent == "", path).otherwise(parent), F.lit(":"), vulnerability_class)


def learnings(verified: DataFrame) -> DataFrame:
    """(finding_id, path, vulnerability_class, reason, evidence, scope, demotion) of the findings that weren't accepted.

    What no entry point reaches is an unreachable path; else a finding that needs evidence is unverified, and one that was
    rejected contradicted. The class is the first tag or else the title; the scope is default_scope(). The evidence is the
    verdict's counter case and next step, where verified has them, or else the verdict.
    """
    reason = F.when(F.col("reachability") == "unknown", "unreachable_path").when(F.col("verdict") == "needs_evidence", "unverified").otherwise("contradicted")
    rows = verified.where("verdict <> 'accepted'")
    said = [F.col(c) for c in ("counter_case", "required_next_step") if c in verified.columns]
    evidence = F.trim(F.concat_ws(" ", *said)) if said else F.col("verdict")
    cls = class_of(verified)
    return rows.select("finding_id", "path", cls.alias("vulnerability_class"), reason.alias("reason"), evidence.alias("evidence"), default_scope(F.col("path"), cls).alias("scope"), F.lit(DEMOTION).alias("demotion")).distinct()


def outcome_learnings(outcomes: DataFrame) -> DataFrame:
    """learnings() of findings with an `outcome`, `evidence` and an optional `reason` of their own; verified ones teach nothing.

    Another outcome, and a learning without evidence, is an error when it's read.
    """
    names = F.create_map(*[F.lit(x) for pair in OUTCOME_REASONS.items() for x in pair])
    by_outcome = F.coalesce(F.try_element_at(names, F.col("outcome")), F.raise_error(F.concat(F.lit("unsupported finding outcome "), F.coalesce("outcome", F.lit("null")))))
    reason = F.coalesce("reason", by_outcome) if "reason" in outcomes.columns else by_outcome
    cls = class_of(outcomes)
    evidence = F.when(F.trim(F.coalesce("evidence", F.lit(""))) != "", F.col("evidence")).otherwise(F.raise_error(F.lit("a learning needs evidence")))
    rows = outcomes.where("outcome is distinct from 'verified'")
    return rows.select("finding_id", "path", cls.alias("vulnerability_class"), reason.alias("reason"), evidence.alias("evidence"), default_scope(F.col("path"), cls).alias("scope"), F.lit(DEMOTION).alias("demotion"))


def ancestors(path: Column) -> Column:
    """All directories above a path."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scope_directory(scope: Column) -> Column:
    """What stands before a scope's last colon; null, which applies to nothing, without a colon and for the root."""
    directory = F.regexp_extract(scope, "(?s)^(.*):", 1)
    return F.when(scope.contains(":") & ~directory.isin("", "."), directory)


def calibrated(rankings: DataFrame, ledger: DataFrame) -> DataFrame:
    """rankings with demotion, calibrated priority max(0.1, min(priority, priority - demotions)) and the learnings' count, ids, constraints and adjustments.

    A learning applies to its own path and to everything below its scope's directory. Learnings are summed per directory
    and per path first, where a learning whose directory holds its own path counts for the directory alone; then each path
    meets its ancestors and itself, so a directory's learnings aren't joined to its paths one by one. The constraints are a
    sentence per learning, the adjustments the scope of each class; where a class has several, the last by id counts.
    """
    keyed = ledger.select("finding_id", F.col("path").alias("l_path"), "vulnerability_class", "scope", scope_directory(F.col("scope")).alias("l_directory"), "demotion").distinct()
    each = [F.sum("demotion").alias("demotion"), F.count("*").alias("learnings"), F.collect_list(F.struct("finding_id", "vulnerability_class", "scope")).alias("learned")]
    of_directories = keyed.where("l_directory is not null").groupBy(F.col("l_directory").alias("place")).agg(*each)
    of_paths = keyed.where(~F.coalesce(F.col("l_path").startswith(F.concat("l_directory", F.lit("/"))), F.lit(False))).groupBy(F.col("l_path").alias("place")).agg(*each)
    paths = rankings.select("path").distinct()
    below = paths.select("path", F.explode(ancestors(F.col("path"))).alias("place")).join(of_directories, "place")
    own = paths.withColumn("place", F.col("path")).join(of_paths, "place")
    learned = F.array_sort(F.flatten(F.collect_list("learned"))).alias("learned")
    sums = below.unionByName(own).groupBy("path").agg(F.sum("demotion").alias("demotion"), F.sum("learnings").alias("learnings"), learned)
    joined = rankings.join(sums, "path", "left")
    lower = F.round(F.col("priority") - F.coalesce("demotion", F.lit(0.0)), 2)
    said = lambda x: F.concat(F.lit("Do not repeat unsupported "), x["vulnerability_class"], F.lit(" claim for scope "), x["scope"], F.lit(" without new evidence."))
    some = F.coalesce("learned", F.expr("cast(array() as array<struct<finding_id:string,vulnerability_class:string,scope:string>>)"))
    classes = F.array_distinct(F.transform(some, lambda x: x["vulnerability_class"]))
    last = F.transform(classes, lambda c: F.struct(c.alias("key"), F.element_at(F.filter(some, lambda x: x["vulnerability_class"] == c), -1)["scope"].alias("value")))
    return joined.withColumns({
        "calibrated": F.greatest(F.lit(FLOOR), F.least("priority", lower)), "demotion": F.coalesce("demotion", F.lit(0.0)), "learnings": F.coalesce("learnings", F.lit(0)),
        "learning_ids": F.transform(some, lambda x: x["finding_id"]), "constraints": F.transform(some, said), "adjustments": F.map_from_entries(last),
    }).drop("learned")


def reachability_overrides(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """(finding_id, factor): 0.4 x the reachability's multiplier for findings with a learning of their class whose path is theirs or whose scope covers them."""
    multiplier = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MULTIPLIER.items() for x in pair]), F.col("reachability")), F.lit(0.4))
    rows = findings.withColumn("class", class_of(findings))
    place = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    places = F.concat(F.array(place("file", F.col("path"))), F.transform(ancestors(F.col("path")), lambda a: place("below", a)))
    spread = rows.select("finding_id", "class", "reachability", F.explode(places).alias("place"))
    files = ledger.select(F.col("vulnerability_class").alias("class"), place("file", F.col("path")).alias("place"))
    below = ledger.select(F.col("vulnerability_class").alias("class"), scope_directory(F.col("scope")).alias("directory")).where("directory is not null").select("class", place("below", F.col("directory")).alias("place"))
    return spread.join(files.unionByName(below).distinct(), ["class", "place"], "left_semi").select("finding_id", F.round(multiplier * FALSE_POSITIVE_FACTOR, 3).alias("factor")).distinct()


def merged_ledger(old: DataFrame, new: DataFrame, key: str = "finding_id") -> DataFrame:
    """Both ledgers by key; the new side's row wins."""
    columns = [c for c in old.columns if c != key]
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), "_side").alias("r")).select(key, "r.*")


def latest_per_key(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate rather than a sort of the group."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def outcome_metrics(events: DataFrame, positive: str, negative: str) -> DataFrame:
    """Per tier the counts of outcomes, the mean of the values rounded to cents (0 without any) and their sum."""
    return events.groupBy("tier").agg(
        F.count("*").alias("outcomes"), F.count_if(F.col("outcome") == positive).alias("accepted"), F.count_if(F.col("outcome") == negative).alias("rejected"),
        F.coalesce(F.round(F.avg("seconds"), 2), F.lit(0.0)).alias("mean_seconds"), F.coalesce(F.round(F.sum("seconds"), 2), F.lit(0.0)).alias("total_seconds"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
